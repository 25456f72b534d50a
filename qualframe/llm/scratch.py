"""Intermediate tables in the folder that all executors share, and joins that broadcast only what was measured."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="run-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df once and read it back: later steps start from files that outlive any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def varying_bytes(field: T.StructField) -> Column | None:
    """Bytes of a cell, for types without a fixed size."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.octet_length(c)
    if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
        return F.octet_length(F.to_json(F.struct(c)))
    return None


def stored_bytes(stored: DataFrame) -> int:
    """Bytes of all cells, 8 for each of them and the contents of those without a fixed size."""
    total = 8 * len(stored.columns) * stored.count()
    varying = [F.coalesce(w, F.lit(0)) for w in map(varying_bytes, stored.schema) if w is not None]
    if varying and total <= BROADCAST_BYTES:
        total += stored.agg(F.sum(sum(varying[1:], varying[0]).cast("long"))).first()[0] or 0
    return total


def small(stored: DataFrame) -> DataFrame:
    """stored, marked for broadcast if its cells hold few bytes; beyond that Spark shuffles."""
    return F.broadcast(stored) if stored_bytes(stored) <= BROADCAST_BYTES else stored
