"""Reading delimited text literally: every cell stays the text it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualframe.functions import values as V
from qualframe.operators.facts import HIDDEN
from qualframe.sources.blocks import records

SUFFIXES = (".csv", ".tsv", ".txt")
# Endings of compressed files that Spark reads by itself; only bzip2 is read in blocks.
PACKED = (".gz", ".bz2", ".zst", ".lz4", ".snappy")
BOM = "\ufeff"
# Known delimiters, in order of preference on a tie.
DELIMITERS = (",", "\t", ";", "|")
# No cell ends like this.
END = "\u0001end of line 7f3c1b52\u0001"


class LoadError(ValueError):
    pass


def sniff_delimiter(header: str) -> str:
    """The known delimiter seen most often in the header line, a comma if there is none."""
    best = max(DELIMITERS, key=header.count)
    return best if header.count(best) else ","


def clean_names(names: list[str]) -> list[str]:
    """Names without surrounding space; nameless columns are numbered."""
    cleaned = [name.strip() or f"column_{i + 1}" for i, name in enumerate(names)]
    twice = {n for n in cleaned if cleaned.count(n) > 1}
    if twice:
        raise LoadError(f"Column names occur twice: {sorted(twice)}")
    return cleaned


def _first_lines(spark: SparkSession, path: str) -> list[str]:
    """The header line and one more, of all lines that are not blank."""
    lines = spark.read.text(path).where(F.trim("value") != "").limit(2).collect()
    if not lines:
        raise LoadError("That file is empty.")
    if len(lines) == 1:
        raise LoadError("That file has no rows.")
    return [line["value"].lstrip(BOM) for line in lines]


def _line_ending(spark: SparkSession, path: str, header: str) -> str:
    """A line feed, unless the header is followed by a carriage return alone."""
    head = F.substring("value", 1, len(BOM) + len(header) + 2)
    found = spark.read.option("lineSep", "\n").text(path).where(F.trim("value") != "").select(head.alias("head")).first()
    rest = found["head"].lstrip(BOM).removeprefix(header)
    return "\r" if len(rest) > 1 and rest[0] == "\r" and rest[1] != "\r" else "\n"


def _is_supported(path: str) -> bool:
    """A file by its suffix, compressed or not; folders and patterns are looked into by Spark."""
    if path.endswith("/"):
        return True
    name = path.lower().rsplit("/", 1)[-1]
    for packed in PACKED:
        name = name.removesuffix(packed)
    return name.endswith(SUFFIXES) or "." not in name or any(c in name for c in "*?[{")


def read_delimited(
    spark: SparkSession,
    path: str,
    delimiter: str | None = None,
    multi_line: bool = True,
    surplus_column: str | None = None,
) -> DataFrame:
    """All columns as text, blanks as '', with the hidden number of each row over all files.

    path: a file, a folder or a pattern; each file has the same header. A lazy scan of any size, cut into blocks by
    Spark: only two lines are read here. Quoted cells may hold line breaks; with ``multi_line=False`` every line is
    a record, whatever its quotes. A line with more cells than the header stops the scan that meets it, but
    ``surplus_column`` names a column that holds such lines whole.
    """
    if not _is_supported(path):
        raise LoadError(f"Unsupported file type; expected one of {', '.join(SUFFIXES)}.")
    header = _first_lines(spark, path)[0]
    if delimiter is None:
        delimiter = "\t" if ".tsv" in path.lower() else sniff_delimiter(header)
    names = _header_names(spark, header, delimiter)
    if surplus_column in names:
        raise LoadError(f"There is a column {surplus_column} already.")
    found = records(spark, path, delimiter, multi_line, _line_ending(spark, path, header))
    text, count = F.col("text"), len(names)
    other = F.col("header") & (F.ltrim(text, F.lit(BOM)) != header)
    refusal = F.raise_error(F.concat(F.lit("The header differs in "), F.col("file")))
    found = found.where(F.when(other, refusal.cast("boolean")).otherwise(~F.col("header")))

    schema = ", ".join(f"c{i} string" for i in range(count + 1))
    options = {"sep": delimiter, "quote": '"', "escape": '"', "multiLine": "true", "maxColumns": str(max(20480, 2 * count))}
    found = found.withColumn("cells", F.from_csv(F.concat(text, F.lit(delimiter + END)), schema, options))
    cells = [F.col(f"cells.c{i}") for i in range(count + 1)]
    # the mark ends the line; a quote that stays open takes it into the last cell
    ended = [F.coalesce(c.endswith(END), F.lit(False)) for c in cells[:-1]]
    wider = ~F.array_contains(F.array(*ended, F.coalesce(cells[-1] == END, F.lit(False))), True)
    if surplus_column is None:
        said = F.concat(F.lit("A line has more cells than the header: "), F.left(text, F.lit(200)))
        found = found.where(F.when(wider, F.raise_error(said).cast("boolean")).otherwise(True))
    out = []
    for cell, end, name in zip(cells, ended, names):
        left = F.when(cell == END, "").otherwise(F.left(cell, F.length(cell) - len(delimiter + END)))
        out.append(F.coalesce(F.when(end, left).otherwise(cell), F.lit("")).alias(name))
    if surplus_column is not None:
        out.append(F.when(wider, text).otherwise("").alias(surplus_column))
    return found.select(F.struct("row").alias(HIDDEN), *out)


def _header_names(spark: SparkSession, header: str, delimiter: str) -> list[str]:
    """Split one header line with the reader's own rules for quotes."""
    count = header.count(delimiter) + 1
    schema = ", ".join(f"c{i} string" for i in range(count))
    options = {"sep": delimiter, "quote": '"', "escape": '"'}
    row = spark.range(1).select(F.from_csv(F.lit(header), schema, options).alias("h")).first()["h"]
    # A delimiter inside quotes makes fewer columns than counted.
    names = [name for name in row]
    while len(names) > 1 and names[-1] is None and not header.rstrip("\r\n").endswith(delimiter):
        names.pop()
    return clean_names([name or "" for name in names])


def preview(df: DataFrame, rows: int = 20, order_by: list[str] | None = None, total: bool = False) -> DataFrame:
    """The first rows with every cell as text, blanks as ''; ``total`` adds ``total_rows``, the rows of df."""
    order = [HIDDEN] if HIDDEN in df.columns else list(order_by or [])
    head = df.orderBy(*order).limit(rows) if order else df.limit(rows)
    shown = head.select(*[V.as_text(V.quoted(c)).alias(c) for c in head.columns if c != HIDDEN])
    return shown.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("total_rows")))) if total else shown
