"""From a table to findings, from decisions to a cleaned table, and both in one go."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from qualframe import model as M
from qualframe.operators import advise, fixes, profile, score
from qualframe.operators.detect import detect_issues, with_row_order
from qualframe.sources.tables import write_parquet


@dataclass
class Analysis:
    """Everything a person needs for a decision; the data is untouched."""

    issues: list[M.Issue]
    issues_df: DataFrame
    score: DataFrame
    advice: DataFrame
    profile: DataFrame
    warnings: DataFrame


@dataclass
class Result:
    cleaned: DataFrame
    applied: list[M.AppliedFix]
    applied_df: DataFrame
    issues_after: list[M.Issue]
    issues_after_df: DataFrame
    score_after: DataFrame


def analyze(
    df: DataFrame,
    thresholds: M.Thresholds | None = None,
    order_by: list[str] | None = None,
    outside_advice: DataFrame | None = None,
) -> Analysis:
    """Profile, detect, score and advise. ``outside_advice`` is advice checked by ``check_replies``."""
    limits = thresholds or M.Thresholds()
    df = with_row_order(df, order_by)
    issues = detect_issues(df, limits)
    issues_df = M.issues_frame(df.sparkSession, issues)
    advice = advise.combined_advice(issues_df, outside_advice, limits.max_issues_advised)
    return Analysis(
        issues,
        issues_df,
        score.score_issues(issues_df),
        advice,
        profile.profile_columns(df),
        advise.fallback_warnings(advice),
    )


def apply(
    df: DataFrame,
    issues: list[M.Issue],
    decisions: list[M.Decision],
    out_path: str | None = None,
    thresholds: M.Thresholds | None = None,
    order_by: list[str] | None = None,
) -> Result:
    """Apply the approved repairs and measure again with the same detectors.

    With ``out_path`` the cleaned table is written once as Parquet and the second scan reads that copy;
    otherwise the second scan runs over the plan.
    """
    spark = df.sparkSession
    cleaned = fixes.apply_all(with_row_order(df, order_by), issues, decisions)
    table = cleaned.df if out_path is None else write_parquet(cleaned.df, out_path)
    after = detect_issues(table, thresholds)
    after_df = M.issues_frame(spark, after)
    return Result(
        table,
        cleaned.applied,
        M.applied_frame(spark, cleaned.applied),
        after,
        after_df,
        score.score_issues(after_df),
    )


def clean(
    df: DataFrame,
    out_path: str | None = None,
    thresholds: M.Thresholds | None = None,
    order_by: list[str] | None = None,
) -> tuple[Analysis, Result]:
    """Analyze, approve every recommendation that changes something, apply and measure again."""
    found = analyze(df, thresholds, order_by)
    decisions = [M.decision_from_row(r) for r in advise.auto_decisions(found.advice).collect()]
    places = {issue.issue_id: i for i, issue in enumerate(found.issues)}
    decisions.sort(key=lambda d: places[d.issue_id])
    return found, apply(df, found.issues, decisions, out_path, thresholds, order_by)
