from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from qualframe.operators.facts import HIDDEN  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-")


@pytest.fixture(scope="session")
def table(spark):
    """table({"a": [...], ...}): text columns with their row order."""

    def build(columns: dict[str, list]):
        names = list(columns)
        rows = [(i, *cells) for i, cells in enumerate(zip(*columns.values()))]
        schema = "row_no int, " + ", ".join(f"`{n}` string" for n in names)
        df = spark.createDataFrame(rows, schema)
        return df.select(F.struct("row_no").alias(HIDDEN), *[F.col(f"`{n}`") for n in names])

    return build


@pytest.fixture(scope="session")
def flawed(table):
    """One planted flaw per detector: eleven rows, the last a copy of the tenth."""
    columns = {
        "Ticket": [*"123456789", "10", "10"],
        "Opened": ["2026-02-01", "03/02/2026", *[f"2026-02-{d:02d}" for d in range(3, 11)], "2026-02-10"],
        "Town": ["Turin", "  turin ", "TURIN", "Milan", "Milan", "Milan", *["Rome"] * 5],
        "ContactEmail": ["a@site.org", "b@site.org", "nobody", *[f"{c}@site.org" for c in "defghij"], "j@site.org"],
        "Cost": ["10.50", "20.00", "unknown yet", "n/a", "25.00", "", "27.50", "22.50", "26.00", "24.00", "24.00"],
        "Unit": ["EUR"] * 11,
        "Remark": ["fine", "", "", "", "", "", "late", "", "", "", ""],
    }
    return table(columns)
