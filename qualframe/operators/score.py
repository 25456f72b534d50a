"""The 0-100 score as plain aggregates over an issues table of any number of runs."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualframe import model as M


def _lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])[key]


def weight(severity: Column | None = None) -> Column:
    return _lookup(M.SEVERITY_WEIGHT, F.col("severity") if severity is None else severity)


def dimension(issue_type: Column | None = None) -> Column:
    return _lookup(M.DIMENSION, F.col("issue_type") if issue_type is None else issue_type)


def penalty() -> Column:
    """Points one issue costs: its weight times a share that reaches 1 at 28.3 % of the rows."""
    return weight() * F.least(F.lit(1.0), F.col("affected_pct") / 100 * 3 + 0.15)


def grade(score: Column) -> Column:
    (floor, name), *rest = M.GRADE_FLOORS
    out = F.when(score >= floor, name)
    for floor, name in rest:
        out = out.when(score >= floor, name)
    return out.otherwise(M.LOWEST_GRADE)


def score_issues(issues: DataFrame, by: list[str] | None = None, rounded: bool = True) -> DataFrame:
    """One row per group of ``by`` (one row in all without it; 100 points for no issues)."""
    points = penalty()

    def shown(c: Column, places: int) -> Column:
        return F.round(c, places) if rounded else c

    def dimension_score(name: str) -> Column:
        lost = F.coalesce(F.sum(F.when(dimension() == name, points)), F.lit(0.0))
        return shown(F.greatest(F.lit(0.0), 100.0 - lost * 2.5), 1).alias(name)

    total = F.coalesce(F.sum(points), F.lit(0.0))
    out = issues.groupBy(*(by or [])).agg(
        shown(F.greatest(F.lit(0.0), 100.0 - total), 1).alias("score"),
        *[dimension_score(name) for name in M.DIMENSIONS],
        F.count(F.lit(1)).alias("issue_count"),
        shown(total, 2).alias("penalty"),
    )
    return out.withColumn("grade", grade(F.round("score", 1)))
