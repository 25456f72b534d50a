"""A handful of example cells per finding, all findings in one job.

Candidates are numbered inside their finding and cut to the first few; Spark applies the cut inside
each task first, so a finding that covers a third of the table sends a handful of rows per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualframe.functions import values as V
from qualframe.functions.numbers import number_of
from qualframe.model import DATES, EMAIL, INVALID, MIXED, OUTLIERS, WHITESPACE
from qualframe.operators.facts import HIDDEN, data_columns

LIMIT = 5


def _order(df: DataFrame) -> list[Column]:
    return [F.col(HIDDEN)] if HIDDEN in df.columns else []


def _cells(df: DataFrame, names: list[str], as_type: str) -> DataFrame:
    """(column, value[, row order]) rows; the cast keeps one type under unpivot."""
    cells = df.select(*_order(df), *[V.quoted(n).cast(as_type).alias(n) for n in names])
    ids = [HIDDEN] if HIDDEN in df.columns else []
    return cells.unpivot(ids, [V.quoted(n) for n in names], "column", "value").where("value is not null")


def flagged_cells(
    df: DataFrame,
    padded: list[str],
    invalid: dict[str, str],
    dates: list[str],
    mixed: list[str],
    bounds: dict[str, tuple[float, float]],
) -> DataFrame | None:
    """(kind, column, value[, row order]) of every cell that shows one of the named findings."""
    dtypes = {f.name: f.dataType for f in data_columns(df)}
    parts = []
    value, s, present = F.col("value"), F.col("s"), F.col("present")
    kept = [*_order(df), "column", "value"]

    texts = list(dict.fromkeys([*padded, *invalid, *dates, *mixed]))
    if texts:
        cells = V.with_stripped(_cells(df, texts, "string"))
        cells = cells.withColumn("present", ~V.stripped_is_placeholder(s))

        def emails(wanted: bool) -> list[str]:
            return [n for n, rule in invalid.items() if (rule == EMAIL) == wanted]

        column = F.col("column")
        bad = (column.isin(emails(True)) & ~s.rlike(V.EMAIL_LAYOUT)) | (
            column.isin(emails(False)) & ~s.rlike(V.PHONE_LAYOUT)
        )
        kinds = F.array_compact(
            F.array(
                F.when(column.isin(padded) & (value != s) & present, F.lit(WHITESPACE)),
                F.when(bad & present, F.lit(INVALID)),
                F.when(column.isin(dates) & s.rlike(V.DATE_LAYOUT), F.lit(DATES)),
                F.when(column.isin(mixed) & present & ~s.rlike(V.NUMBER_LAYOUT), F.lit(MIXED)),
            )
        )
        parts.append(cells.select(F.explode(kinds).alias("kind"), *kept))

    if bounds:
        numbers = df.select(
            *_order(df), *[number_of(V.quoted(n), dtypes[n]).alias(n) for n in bounds]
        )
        far = reduce(
            Column.__or__,
            [
                (F.col("column") == n) & ((value < low) | (value > high))
                for n, (low, high) in bounds.items()
            ],
        )
        cells = _cells(numbers, list(bounds), "double").where(far)
        parts.append(
            cells.select(F.lit(OUTLIERS).alias("kind"), *kept).withColumn("value", value.cast("string"))
        )
    return reduce(DataFrame.unionByName, parts) if parts else None


def first_few(cells: DataFrame, mixed: bool) -> dict[tuple[str, str], list[str]]:
    """{(kind, column): values}: first in row order, or lowest where no order is known.

    Mixed-type findings, where there are any, show their lowest distinct values whatever the order.
    """
    in_order = Window.partitionBy("kind", "column").orderBy(*_order(cells), "value")
    others = cells.where(F.col("kind") != MIXED)
    ranked = [others.withColumn("nth", F.row_number().over(in_order))]
    if mixed:
        distinct = (
            cells.where(F.col("kind") == MIXED).groupBy("kind", "column", "value").agg(F.lit(0).alias("o"))
        )
        lowest = Window.partitionBy("kind", "column").orderBy("value")
        ranked.append(distinct.withColumn("nth", F.row_number().over(lowest)))
    few = [r.where(F.col("nth") <= LIMIT).select("kind", "column", "nth", "value") for r in ranked]
    out: dict[tuple[str, str], list[tuple[int, str]]] = {}
    for row in reduce(DataFrame.union, few).collect():
        out.setdefault((row["kind"], row["column"]), []).append((row["nth"], row["value"]))
    return {key: [v for _, v in sorted(found)] for key, found in out.items()}
