"""Whole-row duplicates; large tables are not shuffled row by row for them.

A table of moderate size is grouped by all its columns. In a larger one rows are first counted by a 64-bit hash, so
16 bytes per row cross the network, not the row. Only rows whose hash occurs more than once can be copies; those alone
are compared in full. Every group by is preceded by a map-side count, so copies that make up a third of the table stay
cheap.

Rows are equal if their cells are: a map by its entries whatever their order, a variant by its type and JSON, and so on
down through structs and arrays; null equals null, NaN equals NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualframe.functions import values as V
from qualframe.operators.facts import HIDDEN, data_columns

# Repeated hashes up to this many (16 MB as longs) may be sent to every executor.
BROADCAST_HASHES = 1_000_000
# Tables up to this size are cheaper to shuffle once than to scan three times.
SHUFFLE_WHOLE = 1 << 30


def is_plain(dtype: T.DataType) -> bool:
    """Whether Spark compares values of this type as they are."""
    if isinstance(dtype, (T.MapType, T.VariantType, T.CalendarIntervalType)):
        return False
    if isinstance(dtype, T.ArrayType):
        return is_plain(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(is_plain(f.dataType) for f in dtype.fields)
    return True


def comparable(c: Column, dtype: T.DataType) -> Column:
    """The value in a form that can be hashed, grouped and sorted; equal values have equal forms."""
    if is_plain(dtype):
        return c
    if isinstance(dtype, T.VariantType):
        return F.when(c.isNotNull(), F.concat(F.schema_of_variant(c), F.lit(" "), F.coalesce(F.to_json(c), F.lit("null"))))
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: comparable(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        parts = [comparable(c.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(dtype.fields)]
        return F.when(c.isNotNull(), F.struct(*parts))
    if isinstance(dtype, T.MapType):

        def entry(e: Column) -> Column:
            return F.struct(comparable(e["key"], dtype.keyType).alias("k"), comparable(e["value"], dtype.valueType).alias("v"))

        return F.sort_array(F.transform(F.map_entries(c), entry))
    return c.cast("string")


def _keys(df: DataFrame) -> list[Column]:
    return [comparable(V.quoted(f.name), f.dataType).alias(f"k{i}") for i, f in enumerate(data_columns(df))]


def _row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[comparable(V.quoted(f.name), f.dataType) for f in data_columns(df)])


def _is_moderate(df: DataFrame, most_bytes: int | None) -> bool:
    """Whether the optimizer's size estimate, where there is one, allows shuffling the whole table."""
    most_bytes = SHUFFLE_WHOLE if most_bytes is None else most_bytes
    if not hasattr(df, "_jdf"):  # Spark Connect keeps its plans to itself
        return False
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most_bytes


def repeated_hashes(df: DataFrame) -> DataFrame:
    """(row_hash) of every hash that more than one row has."""
    return (
        df.select(_row_hash(df).alias("row_hash"))
        .groupBy("row_hash")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("row_hash")
    )


def suspects(df: DataFrame, hashes: DataFrame, how_many: int, kind: str = "left_semi") -> DataFrame:
    """Rows that may have a copy (or with ``left_anti`` those that cannot)."""
    if how_many <= BROADCAST_HASHES:
        hashes = F.broadcast(hashes)
    return df.withColumn("__hash", _row_hash(df)).join(hashes, F.col("__hash") == F.col("row_hash"), kind).drop("__hash")


def copy_groups(rows: DataFrame) -> DataFrame:
    """One row for each group of equal rows: the group's cells k0, k1, .. and their number in ``copies``."""
    return rows.groupBy(*_keys(rows)).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def count_copies(df: DataFrame, examples: int = 3, shuffle_whole: int | None = None) -> tuple[int, list[str]]:
    """How many rows repeat an earlier row, and the first few of them spelt out.

    Without a known row order the examples are the lowest repeated rows. ``shuffle_whole``: the bytes up to which the
    table is grouped in one go, SHUFFLE_WHOLE unless given.
    """
    rows, stored = df, []
    try:
        if not _is_moderate(df, shuffle_whole):
            hashes = repeated_hashes(df).persist()
            stored.append(hashes)
            how_many = hashes.count()
            if not how_many:
                return 0, []
            rows = suspects(df, hashes, how_many) if how_many <= BROADCAST_HASHES else df
        ordered = HIDDEN in df.columns
        groups = (_places(rows, examples) if ordered else _shown_groups(rows)).persist()
        stored.append(groups)
        found = groups.agg(F.sum(F.col("copies") - 1)).first()[0]
        if not found:
            return 0, []
        if ordered:
            few = _first_later(_up_to_later(rows, groups, examples), examples)
            few += _tied(rows, min(examples, found) - len(few))
        else:
            few = _lowest(groups, examples)
    finally:
        for table in stored:
            table.unpersist()
    names = [f.name for f in data_columns(df)]
    return found, [" | ".join(f"{n}={v}" for n, v in zip(names, row)) for row in few]


def _shown(df: DataFrame) -> list[Column]:
    return [F.left(V.as_text(V.quoted(f.name)), F.lit(20)).alias(f"s{i}") for i, f in enumerate(data_columns(df))]


def _shown_groups(rows: DataFrame) -> DataFrame:
    """The groups of equal rows with their number in ``copies`` and one of them spelt out."""
    cells = rows.select(*_keys(rows), F.struct(*_shown(rows)).alias("shown"))
    keys = [c for c in cells.columns if c != "shown"]
    return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.min("shown").alias("shown")).where("copies > 1")


def _lowest(groups: DataFrame, examples: int) -> list[tuple]:
    """The lowest repeated rows, each once."""
    keys = [c for c in groups.columns if c not in ("copies", "shown")]
    return [tuple(r["shown"]) for r in groups.orderBy(*keys).limit(examples).select("shown").collect()]


def _places(rows: DataFrame, examples: int) -> DataFrame:
    """(copies, first, later) of the groups of equal rows: the first place, and some of the places behind it.

    Rows are dealt into as many heaps and one more by a hash of their place; the lowest place of each heap is known, and
    the highest of all. Those that are not the first belong to later rows, low ones if there are many copies.
    """
    heaps = examples + 1
    cells = rows.select(*_keys(rows), F.col(HIDDEN).alias("at"))
    keys = [c for c in cells.columns if c != "at"]
    heap = F.pmod(F.xxhash64("at"), F.lit(heaps))
    lows = [F.min(F.when(heap == i, F.col("at"))) for i in range(heaps)]
    places = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.min("at").alias("first"), F.array(*lows, F.max("at")).alias("some"))
    later = F.filter(F.array_distinct("some"), lambda at: at > F.col("first"))
    return places.where("copies > 1").select("copies", "first", later.alias("later"))


def _up_to_later(rows: DataFrame, groups: DataFrame, examples: int) -> DataFrame:
    """The rows up to a place by which at least that many repeat an earlier one; none if no place is behind another."""
    low = groups.select(F.explode("later").alias("at")).orderBy("at").limit(examples)
    known = low.count()
    if known < examples:
        return rows if known else rows.limit(0)
    return rows.where(F.col(HIDDEN) <= low.agg(F.max("at")).scalar())


def _first_later(rows: DataFrame, examples: int) -> list[tuple]:
    """The first rows in row order that repeat an earlier one.

    Rows behind the first of their hash are candidates; the few that come first are compared in full, and more are
    fetched only where a hash turned out to belong to different rows.
    """
    hashed = rows.select(*_keys(rows), _row_hash(rows).alias("row_hash"), F.struct(*_shown(rows)).alias("shown"), HIDDEN)
    keys = [c for c in hashed.columns if c not in ("row_hash", "shown", HIDDEN)]
    firsts = hashed.groupBy("row_hash").agg(F.min(HIDDEN).alias("__first"), F.count(F.lit(1)).alias("copies"))
    later = hashed.join(firsts.where("copies > 1").drop("copies"), "row_hash").where(F.col(HIDDEN) > F.col("__first"))
    fetched = examples
    while True:
        some = later.orderBy(HIDDEN).limit(fetched).select("row_hash", F.col(HIDDEN).alias("__at"), "shown").collect()
        if not some:
            return []
        groups = hashed.where(F.col("row_hash").isin(*{r["row_hash"] for r in some})).groupBy(*keys)
        starts = {}
        for r in groups.agg(F.min(HIDDEN).alias("start"), F.min("row_hash").alias("row_hash")).collect():  # one row a hash, but for collisions
            starts.setdefault(r["row_hash"], set()).add(r["start"])
        repeated = [r["shown"] for r in some if r["__at"] not in starts[r["row_hash"]]]
        if len(repeated) >= examples or len(some) < fetched:
            return [tuple(r) for r in repeated[:examples]]
        fetched *= 4


def _tied(rows: DataFrame, examples: int) -> list[tuple]:
    """Copies that share the place of the first one in the row order."""
    if examples < 1:
        return []
    cells = rows.select(*_keys(rows), F.struct(*_shown(rows)).alias("shown"), HIDDEN)
    keys = [c for c in cells.columns if c not in ("shown", HIDDEN)]
    places = cells.groupBy(*keys, HIDDEN).agg(F.count(F.lit(1)).alias("n"), F.min("shown").alias("shown"))
    firsts = places.groupBy(*keys).agg(F.min_by(F.struct(HIDDEN, "n", "shown"), HIDDEN).alias("first")).select("first.*")
    few = firsts.where("n > 1").orderBy(HIDDEN).limit(examples).select("shown", "n").collect()
    return [tuple(r["shown"]) for r in few for _ in range(min(r["n"] - 1, examples))][:examples]


def drop_copies(df: DataFrame, shuffle_whole: int | None = None) -> DataFrame:
    """Keep one row of each group of equal rows: the first in row order where that is known.

    In a large table rows without a copy skip the shuffle, as long as the repeated hashes fit a broadcast.
    """
    if _is_moderate(df, shuffle_whole):
        return _first_of_each(df)
    hashes = repeated_hashes(df)
    how_many = hashes.count()
    if how_many and how_many <= BROADCAST_HASHES:
        return suspects(df, hashes, how_many, "left_anti").unionByName(
            _first_of_each(suspects(df, hashes, how_many))
        )
    return _first_of_each(df) if how_many else df


def _first_of_each(df: DataFrame) -> DataFrame:
    if all(is_plain(f.dataType) for f in data_columns(df)):
        if HIDDEN not in df.columns:
            return df.dropDuplicates()
        names = [V.quoted(f.name) for f in data_columns(df)]
        return df.groupBy(*names).agg(F.min(HIDDEN).alias(HIDDEN)).select(*[V.quoted(c) for c in df.columns])
    whole = F.struct(*[V.quoted(c) for c in df.columns])
    one = F.min_by(whole, HIDDEN) if HIDDEN in df.columns else F.first(whole)
    return df.groupBy(*_keys(df)).agg(one.alias("row")).select("row.*")
