"""Value counts of many columns, a shuffle for each kind of key.

Cells travel as (column, key) and are counted map-side first, so a value that fills a third of a
column leaves each task as one row. Long texts are counted by their SHA-256 digest, whole numbers by bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualframe.functions import values as V
from qualframe.operators.facts import data_columns, text_cells

# Doubtful hashes up to this many (16 MB with the number of their column) may be sent to every executor.
BROADCAST_HASHES = 1_000_000
# Texts longer than this travel as a digest of the same length.
DIGEST_LENGTH = 64


def compact(c: Column) -> Column:
    return F.when(F.length(c) > DIGEST_LENGTH, F.sha2(c, 256)).otherwise(c)


def stripped_cells(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, value, s, blank) of text columns; ``s`` is the stripped value.

    Blank cells are left in and flagged: a filter on ``blank`` here would be pushed below the
    projections and repeat their work. They collapse in the counts below and are dropped there.
    """
    cells = V.with_stripped(text_cells(df, names))
    blank = F.coalesce(V.stripped_is_placeholder(F.col("s")), F.lit(True))
    return cells.withColumn("blank", blank).select("column", "value", "s", "blank")


def _whole(c: Column, dtype: T.DataType) -> Column | None:
    """The one 64-bit number that stands for a value, for types that have such."""
    if isinstance(dtype, T.IntegralType):
        return c.cast("bigint")
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("bigint")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(dtype, T.DecimalType) and dtype.precision <= 18:
        return (c * F.lit(10**dtype.scale).cast(T.DecimalType(dtype.scale + 1, 0))).cast("bigint")
    return None


def distinct_counts(df: DataFrame, approx: bool = False) -> DataFrame:
    """(column, unique_count) of present values of every column that has values to compare.

    Whole numbers are exchanged as words of a bitmap: 64 neighbouring numbers are one row of 64 bits, whatever their
    range, and the bits are counted at the end. Floating numbers are exchanged as such, the rest as text.
    """
    whole, floating, text = {}, {}, {}
    for f in data_columns(df):
        if V.kind_of(f.dataType) == V.NESTED:
            continue
        c = V.quoted(f.name)
        present = lambda key: F.when(~V.is_blank(c, f.dataType), key)  # noqa: E731, B023
        number = _whole(c, f.dataType)
        if number is not None:
            whole[f.name] = present(number)
        elif V.is_floating(f.dataType):
            floating[f.name] = present(c.cast("double"))
        else:
            text[f.name] = present(compact(c.cast("string")))
    parts = []
    for keys in (whole, floating, text):
        if not keys:
            continue
        # named by number first: a column may bear the name of another's alias
        cells = df.select(*[key.alias(f"k{i}") for i, key in enumerate(keys.values())])
        cells = cells.select(*[F.col(f"k{i}").alias(name) for i, name in enumerate(keys)])
        cells = cells.unpivot([], [V.quoted(name) for name in keys], "column", "key").where("key is not null")
        if approx:
            parts.append(cells.groupBy("column").agg(F.approx_count_distinct("key").alias("n")))
        elif keys is whole:
            words = cells.groupBy("column", F.shiftright("key", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(key & 63 AS INT))")).alias("bits"))
            parts.append(words.groupBy("column").agg(F.sum(F.bit_count("bits").cast("bigint")).alias("n")))
        else:
            parts.append(cells.groupBy("column", "key").agg(F.lit(1)).groupBy("column").agg(F.count(F.lit(1)).alias("n")))
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, unique_count long")
    return reduce(DataFrame.union, parts).withColumnRenamed("n", "unique_count")


def spelling_hashes(df: DataFrame, names: list[str]) -> DataFrame:
    """(col, low, n, first, last): for each number of a column and 64-bit hash of a value in small letters its rows,
    and the least and greatest hash of the spellings. No text is exchanged."""
    numbered = df.select(*[V.quoted(n).cast("string").alias(str(i)) for i, n in enumerate(names)])
    cells = stripped_cells(numbered, [str(i) for i in range(len(names))])
    present = lambda c: F.when(~F.col("blank"), F.xxhash64(c))
    spelt = cells.select(
        F.col("column").cast("int").alias("col"), present(F.lower("s")).alias("low"), present(F.col("s")).alias("spelt"), "s"
    )
    return (
        spelt.groupBy("col", "low")
        .agg(F.count(F.lit(1)).alias("n"), F.min("spelt").alias("first"), F.max("spelt").alias("last"))
        .where("low IS NOT NULL")
    )


def case_clashes(
    df: DataFrame, names: list[str], present: dict[str, int], ratio: float, examples: int = 3, spellings: int = 4
) -> dict[str, dict]:
    """{column: groups, affected, examples} of the text columns in which spellings differ in capitals only.

    A group is a set of stripped values that are one in small letters; it clashes with more than one spelling.
    ``affected`` counts every row of the clashing groups. Columns with more spellings than ``ratio`` of their present
    values are left out. Values are counted by hash first; only hashes with two spellings and more are fetched as text
    and compared, so that different values of one hash do not count as a clash.
    """
    totals = spelling_hashes(df, names).groupBy("col").agg(
        F.count(F.lit(1)).alias("lows"), F.count_if(F.col("first") != F.col("last")).alias("doubtful")
    )
    told = {names[r["col"]]: r for r in totals.collect()}
    asked = [n for n, r in told.items() if r["doubtful"] and r["lows"] <= ratio * present[n]]
    if not asked:
        return {}
    doubtful = spelling_hashes(df, asked).where(F.col("first") != F.col("last")).select("col", "low")
    if sum(told[n]["doubtful"] for n in asked) <= BROADCAST_HASHES:
        doubtful = F.broadcast(doubtful)
    numbered = df.select(*[V.quoted(n).cast("string").alias(str(i)) for i, n in enumerate(asked)])
    cells = stripped_cells(numbered, [str(i) for i in range(len(asked))])
    cells = cells.select(F.col("column").cast("int").alias("col"), F.when(~F.col("blank"), F.xxhash64(F.lower("s"))).alias("low"), "s")
    spelt = (
        cells.join(doubtful, ["col", "low"], "left_semi")
        .groupBy("col", F.lower("s").alias("value"), "s")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    groups = spelt.groupBy("col", "value").agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("n"))
    clash = F.col("spellings") > 1
    counts = groups.groupBy("col").agg(
        F.sum("spellings").alias("spellings"),
        F.count_if(clash).alias("groups"),
        F.sum(F.when(clash, F.col("n"))).alias("affected"),
    )
    nth = F.row_number().over(Window.partitionBy("col").orderBy("value"))
    shown = groups.where(clash).withColumn("nth", nth).where(F.col("nth") <= examples).select("col", "value")
    nth = F.row_number().over(Window.partitionBy("col", "value").orderBy("s"))
    few = spelt.join(F.broadcast(shown), ["col", "value"]).withColumn("nth", nth).where(F.col("nth") <= spellings)
    few = few.groupBy("col", "value").agg(F.array_join(F.array_sort(F.collect_list("s")), " / ").alias("example"))
    few = few.groupBy("col").agg(F.array_sort(F.collect_list(F.struct("value", "example"))).alias("examples"))
    out = {}
    for r in counts.join(F.broadcast(few), "col", "left").collect():
        name = asked[r["col"]]
        everything = told[name]["lows"] - told[name]["doubtful"] + r["spellings"]
        if r["groups"] and everything <= ratio * present[name]:
            out[name] = {"groups": r["groups"], "affected": r["affected"], "examples": [e["example"] for e in r["examples"]]}
    return out


def date_shapes(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, shape, n) over the date-like cells of text columns."""
    cells = stripped_cells(df, names).withColumn("is_date", F.col("s").rlike(V.DATE_LAYOUT))
    shape = F.when(F.col("is_date"), V.date_shape(F.col("s")))
    return (
        cells.groupBy("column", shape.alias("shape"))
        .agg(F.count(F.lit(1)).alias("n"), F.bool_or("is_date").alias("is_date"))
        .where("is_date")
        .select("column", "shape", "n")
    )


def most_common(df: DataFrame, name: str) -> DataFrame:
    """The most common present value of one column, the lowest one on a tie; at most one row."""
    dtype = df.schema[name].dataType
    c = V.quoted(name)
    return (
        df.where(~V.is_blank(c, dtype))
        .groupBy(c.alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("value"))
        .limit(1)
    )
