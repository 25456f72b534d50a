"""Dense row numbers of tables of any size, and joins whose hot keys are dealt to many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualframe.llm.scratch import small, store

HOT_KEYS = 1000  # at most so many keys are salted
SALTS = 64


def sorted_parts(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df, dealt out by ranges of keys, sorted and stored, with `part` and `nth` (from 0 in the part).

    Nulls come first, texts go by their UTF-8 bytes. Rows with equal keys may change places when a lost task is run
    again, before anything is stored, so keys have to tell apart all rows that differ in a column that matters.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    stored = store(dealt.withColumn("mid", F.monotonically_increasing_id()), name)
    low = (1 << 33) - 1  # monotonically_increasing_id: the partition, then 33 bits of the row in it
    return stored.select(
        "*", F.shiftright("mid", 33).alias("part"), F.col("mid").bitwiseAND(F.lit(low)).alias("nth")
    ).drop("mid")


def numbered(df: DataFrame, keys: list[str], name: str, at: str = "at") -> DataFrame:
    """df with the place of each row, from 0, in the order of keys. What is exchanged besides is one row a part."""
    rows = sorted_parts(df, keys, name)
    cells = rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    cells = cells.withColumn("before", F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).drop("rows")
    return rows.join(F.broadcast(cells), "part").withColumn(at, F.col("before") + F.col("nth")).drop("part", "nth", "before")


def numbered_by_group(df: DataFrame, group: str, keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows with g, n and rank (from 0 in the group), groups (group, g, n) numbered in their order.

    No group comes together in one task: a group is numbered part by part of the sorted table.
    """
    rows = sorted_parts(df, [group, *keys], name)
    cells = rows.groupBy("part", group).agg(F.min("nth").alias("first"), F.count(F.lit(1)).alias("rows"))
    cells = store(cells, f"{name}-cells")
    groups = store(numbered(cells.groupBy(group).agg(F.sum("rows").alias("n")), [group], f"{name}-order", "g"), f"{name}-groups")
    before = F.sum("rows").over(Window.partitionBy(group).orderBy("part")) - F.col("rows")
    named = groups.withColumnRenamed(group, "group_")
    cells = cells.join(small(named), F.col(group).eqNullSafe(F.col("group_")))
    cells = cells.select(F.col("part").alias("part_"), "group_", "g", "n", (before - F.col("first")).alias("shift"))
    same = (F.col("part") == F.col("part_")) & F.col(group).eqNullSafe(F.col("group_"))
    ranked = rows.join(small(store(cells, f"{name}-shifts")), same).withColumn("rank", F.col("nth") + F.col("shift"))
    return ranked.drop("part", "nth", "part_", "group_", "shift"), groups


def join_hot(rows: DataFrame, row_key: Column, table: DataFrame, table_key: Column, hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with table, whose keys are distinct; the keys in hot (column h, xxhash64 of the key) are salted.

    hot has at most HOT_KEYS rows, as `hot_hashes` makes it. Rows of a hot key go to SALTS tasks and its one row of
    the table is sent to each of them. Left and inner joins only.
    """
    hashes = F.broadcast(hot.select(F.col("h").alias("hot_h")))
    spread = F.when(F.col("hot_h").isNotNull(), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(F.lit(0))
    left = rows.withColumn("key_l", row_key).withColumn("h_l", F.xxhash64("key_l"))
    left = left.join(hashes, F.col("h_l") == F.col("hot_h"), "left").withColumn("salt_l", spread.cast("int")).drop("hot_h")
    copies = F.when(F.col("hot_h").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = table.withColumn("key_r", table_key).withColumn("h_r", F.xxhash64("key_r"))
    right = right.join(hashes, F.col("h_r") == F.col("hot_h"), "left").withColumn("salt_r", F.explode(copies)).drop("hot_h")
    same = (F.col("h_l") == F.col("h_r")) & (F.col("salt_l") == F.col("salt_r")) & (F.col("key_l") == F.col("key_r"))
    return left.join(right, same, how).drop("key_l", "h_l", "salt_l", "key_r", "h_r", "salt_r")


def hot_hashes(counts: DataFrame, key: Column, rows: str) -> DataFrame:
    """(h): the hashes of the keys with most rows, of 10,000 and more; counts has one row a key."""
    return counts.where(F.col(rows) >= 10_000).orderBy(F.desc(rows)).limit(HOT_KEYS).select(F.xxhash64(key).alias("h"))
