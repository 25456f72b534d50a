"""Typed tables in, cleaned tables out."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from qualframe.functions import values as V
from qualframe.operators.facts import HIDDEN


def without_order(df: DataFrame) -> DataFrame:
    return df.drop(HIDDEN)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Write with types kept, and return the written table: what a second scan should look at."""
    without_order(df).write.mode(mode).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_delimited(df: DataFrame, path: str, mode: str = "errorifexists", delimiter: str = ",") -> None:
    """Delimited text with header, nulls as empty cells; parts and rows follow the row order where it is known."""
    if HIDDEN in df.columns:
        df = df.orderBy(HIDDEN)
    cells = [V.as_text(V.quoted(c)).alias(c) for c in df.columns if c != HIDDEN]
    df.select(*cells).write.mode(mode).csv(
        path,
        sep=delimiter,
        header=True,
        quote='"',
        escape='"',
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def land(df: DataFrame, path: str) -> DataFrame:
    """Copy a delimited table to Parquet once, row order included.

    A scan reads its input several times, each time a few columns; a row format would be parsed in
    full every time.
    """
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that driver and executors share.")
    return f"{(shared or tempfile.mkdtemp(prefix='run-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"
