"""Carrying the previous present value down, over tables of any size.

One window over the whole table would be one task. Instead the row order is cut into buckets at
fixed boundaries taken from a sample of the order keys; each bucket is filled by itself, and the
last present value of the buckets before it is handed in from a table of one row per bucket.
The boundaries are one constant array, so every job puts a row into the same bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualframe.functions import values as V
from qualframe.operators.facts import HIDDEN, data_columns

ROWS_PER_BUCKET = 2_000_000
MOST_BUCKETS = 4_096
SAMPLES_PER_BUCKET = 20
# Copies of one row that are written back by one task.
COPIES_PER_TASK = 1_000_000


def _key(df: DataFrame) -> Column:
    """Row order; rows the order leaves tied follow the hash of their cells."""
    cells = [V.quoted(f.name) for f in data_columns(df) if not isinstance(f.dataType, T.MapType)]
    return F.struct(F.col(HIDDEN).alias("o"), F.xxhash64(*cells).alias("h"))


def _boundaries(df: DataFrame, rows_per_bucket: int) -> tuple[list[Row], bool]:
    """Bucket boundaries, and whether one key fills more than a bucket."""
    rows = df.count()
    buckets = min(MOST_BUCKETS, math.ceil(rows / rows_per_bucket))
    if buckets < 2:
        return [], False
    share = min(1.0, SAMPLES_PER_BUCKET * buckets / rows)
    sample = df.select(_key(df).alias("k")).sample(share, seed=7).orderBy("k").collect()
    picked = [sample[len(sample) * i // buckets]["k"] for i in range(1, buckets)] if sample else []
    distinct = list(dict.fromkeys(picked))
    return distinct, len(distinct) < len(picked)


def _bucket(df: DataFrame, boundaries: list[Row]) -> Column:
    """Number of boundaries at or below the key of df, by binary search."""
    if not boundaries:
        return F.lit(0)
    kind = df.select(_key(df).alias("k")).schema["k"].dataType
    one_row = T.StructType([T.StructField("bounds", T.ArrayType(kind))])
    # one constant, not an expression for each boundary; what JSON rounds moves a boundary, alike for every row
    written = df.sparkSession.createDataFrame([(boundaries,)], one_row).select(F.to_json("bounds")).first()[0]
    bounds = F.sort_array(F.from_json(F.lit(written), one_row["bounds"].dataType))
    key, count = F.col("__key"), len(boundaries)

    def step(at: Column, _: Column) -> Column:
        middle = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        right = F.coalesce(F.get(bounds, middle) <= key, F.lit(True))
        return (
            F.when(at["lo"] >= at["hi"], at)
            .when(right, F.struct((middle + 1).alias("lo"), at["hi"].alias("hi")))
            .otherwise(F.struct(at["lo"].alias("lo"), middle.alias("hi")))
        )

    rounds = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(count + 1))))
    start = F.struct(F.lit(0).alias("lo"), F.lit(count).alias("hi"))
    return F.aggregate(rounds, start, step, lambda at: at["lo"])


def _fill(df: DataFrame, name: str, boundaries: list[Row]) -> DataFrame:
    field = df.schema[name]
    c = V.quoted(name)
    present = F.when(~V.is_blank(c, field.dataType), c)
    placed = df.withColumn("__key", _key(df)).withColumn("__bucket", _bucket(df, boundaries))
    window = Window.partitionBy("__bucket").orderBy("__key").rowsBetween(Window.unboundedPreceding, 0)
    filled = F.last(present, ignorenulls=True).over(window)
    if not boundaries:
        return placed.withColumn(name, filled).drop("__key", "__bucket")

    lasts = placed.groupBy("__bucket").agg(
        F.max_by(present, F.when(present.isNotNull(), F.col("__key"))).alias("last")
    )
    # One row per bucket, MOST_BUCKETS at most.
    by_bucket = {r["__bucket"]: r["last"] for r in lasts.collect()}
    handed, carried = [], None
    for bucket in range(len(boundaries) + 1):
        handed.append((bucket, carried))
        carried = by_bucket.get(bucket) if by_bucket.get(bucket) is not None else carried
    schema = T.StructType(
        [T.StructField("__bucket", T.IntegerType()), T.StructField("__carried", field.dataType)]
    )
    carry = F.broadcast(df.sparkSession.createDataFrame(handed, schema))
    return (
        placed.withColumn("__filled", filled)
        .join(carry, "__bucket", "left")
        .withColumn(name, F.coalesce(F.col("__filled"), F.col("__carried")))
        .select(*[V.quoted(n) for n in df.columns])
    )


def forward_fill(df: DataFrame, name: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Blank cells of one column take the previous present value; leading ones become null.

    The table must carry its row order. Rows equal in order and content are filled once and written
    out as often as they occurred, when one such row fills more than a bucket.
    """
    boundaries, crowded = _boundaries(df, rows_per_bucket)
    maps = any(isinstance(f.dataType, T.MapType) for f in data_columns(df))
    if not crowded or maps:
        return _fill(df, name, boundaries)
    names = df.columns
    single = df.groupBy(*[V.quoted(n) for n in names]).agg(F.count(F.lit(1)).alias("__copies"))
    boundaries, _ = _boundaries(single.select(*[V.quoted(n) for n in names]), rows_per_bucket)
    filled = _fill(single, name, boundaries)
    parts = F.sequence(F.lit(0), F.floor((F.col("__copies") - 1) / COPIES_PER_TASK).cast("int"))
    left = F.col("__copies") - F.col("__part") * COPIES_PER_TASK
    times = F.least(F.lit(COPIES_PER_TASK), left).cast("int")
    columns = [V.quoted(n) for n in names]
    spread = filled.select("*", F.explode(parts).alias("__part"))
    spread = spread.repartition(F.xxhash64(*columns, F.col("__part")))
    return spread.select(*columns, F.explode(F.sequence(F.lit(1), times)).alias("__i")).drop("__i")
