"""Recommendations as projections and joins over issues tables of any number of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualframe import model as M
from qualframe import registry
from qualframe.operators.score import weight

# Fixed values of the built-in advice.
MOSTLY_EMPTY_PCT = 60
FEW_BLANKS_PCT = 5
RULE_CONFIDENCE = 0.6
PLAIN_ADVICE = {
    M.DUPLICATES: "drop_duplicates",
    M.MIXED: "coerce_numeric",
    M.DATES: "normalize_dates",
    M.OUTLIERS: "none",
    M.WHITESPACE: "trim_whitespace",
    M.CASING: "standardize_case_title",
    M.INVALID: "blank_invalid",
    M.CONSTANT: "none",
}
REASONS = {
    M.DUPLICATES: "Every repeated row is counted again by all later sums; one copy is enough.",
    M.MIXED: "Most values are numbers already. As a numeric column they can be summed; the rest become "
    "blanks that show up as missing values.",
    M.DATES: "Dates in YYYY-MM-DD sort rightly and every tool reads them.",
    M.OUTLIERS: "Extreme values are often true. Look at the examples, and change them only if they are "
    "known to be slips.",
    M.WHITESPACE: "Trimming loses nothing and lets equal values join and group again.",
    M.CASING: "One spelling per value merges the split groups; leading capitals suit names.",
    M.INVALID: "Emptying the bad cells keeps the rest of each row, which deleting it would not.",
    M.CONSTANT: "A column of one value does no harm; drop it when nothing downstream asks for it.",
}


def _keys(*frames: DataFrame) -> list[str]:
    """issue_id, and run_id where all the frames have it."""
    shared = all("run_id" in f.columns for f in frames)
    return ["run_id", "issue_id"] if shared else ["issue_id"]


def rule_strategy() -> Column:
    numeric = F.coalesce(F.col("numeric"), F.lit(False))
    pct = F.col("affected_pct")
    out = F.when(
        F.col("issue_type") == M.MISSING,
        F.when(pct >= MOSTLY_EMPTY_PCT, "none")
        .when((pct <= FEW_BLANKS_PCT) & ~numeric, "fill_mode")
        .when(numeric, "fill_median")
        .otherwise("fill_mode"),
    )
    for kind, strategy in PLAIN_ADVICE.items():
        out = out.when(F.col("issue_type") == kind, strategy)
    for kind, detector in registry.DETECTORS.items():
        out = out.when(F.col("issue_type") == kind, detector.advice)
    return out.otherwise("none")


def _rule_reason() -> Column:
    numeric = F.coalesce(F.col("numeric"), F.lit(False))
    pct = F.col("affected_pct")
    out = F.when(
        F.col("issue_type") == M.MISSING,
        F.when(
            pct >= MOSTLY_EMPTY_PCT,
            F.concat(
                F.format_number(pct, 0),
                F.lit("% of the cells are blank. Filling them would invent most of the column."),
            ),
        )
        .when(
            (pct <= FEW_BLANKS_PCT) & ~numeric,
            F.concat(
                F.lit("Just "),
                F.format_number(pct, 1),
                F.lit("% is missing; the most common value changes little."),
            ),
        )
        .when(numeric, F.lit("The column is numeric, and a few extremes do not move its median."))
        .otherwise(F.lit("The column is text, for which the most common value is the usual filler.")),
    )
    for kind, reason in REASONS.items():
        out = out.when(F.col("issue_type") == kind, reason)
    for kind, detector in registry.DETECTORS.items():
        out = out.when(F.col("issue_type") == kind, detector.reason)
    return out.otherwise("No rule covers this type of issue.")


def rule_advice(issues: DataFrame) -> DataFrame:
    """The conservative built-in recommendation for every issue."""
    return issues.select(
        *_keys(issues),
        rule_strategy().alias("strategy"),
        _rule_reason().alias("reasoning"),
        F.lit(RULE_CONFIDENCE).alias("confidence"),
        F.lit(None).cast("string").alias("fill_value"),
        F.lit("rule").alias("source"),
    )


def issue_payload(issues: DataFrame) -> DataFrame:
    """(.., payload): what an outside recommender is shown per issue, menu included, as JSON."""
    menu = F.create_map(
        *[
            x
            for kind, strategies in M.MENU.items()
            for x in (
                F.lit(kind),
                F.array(
                    *[
                        F.struct(F.lit(s).alias("strategy"), F.lit(M.HELP[s]).alias("means"))
                        for s in strategies
                    ]
                ),
            )
        ]
    )
    payload = F.struct(
        F.col("issue_id").alias("id"),
        F.col("title").alias("problem"),
        F.col("detail").alias("explanation"),
        "column",
        "severity",
        "affected_rows",
        F.col("affected_pct").alias("affected_percent"),
        F.slice("evidence", 1, 5).alias("examples"),
        menu[F.col("issue_type")].alias("allowed"),
    )
    return issues.select(*_keys(issues), F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"))


def worst_issues(issues: DataFrame, cap: int) -> DataFrame:
    """Keys of the ``cap`` worst issues of each run; the rest of a run is cut before the shuffle."""
    by = ["run_id"] if "run_id" in issues.columns else []
    worst = Window.partitionBy(*by).orderBy(weight().desc(), F.desc("affected_pct"), F.asc("issue_id"))
    placed = issues.withColumn("place", F.row_number().over(worst))
    return placed.where(F.col("place") <= cap).select(*_keys(issues))


def combined_advice(issues: DataFrame, outside: DataFrame | None, cap: int = 40) -> DataFrame:
    """Outside advice for the ``cap`` worst issues of each run, built-in rules for all others.

    ``by_cap`` and ``by_failure`` say why a row fell back to the rules.
    """
    if outside is None:
        return rule_advice(issues).withColumns({"by_cap": F.lit(False), "by_failure": F.lit(False)})
    keys = _keys(issues)
    rules = issues.select(*keys, rule_strategy().alias("r_strategy"), _rule_reason().alias("r_reasoning"))
    asked = worst_issues(issues, cap).withColumn("asked", F.lit(True))
    given = outside.select(
        *keys, "strategy", "reasoning", "confidence", "fill_value", F.lit(True).alias("given")
    )
    joined = rules.join(asked, keys, "left").join(given, keys, "left")
    in_cap = F.coalesce(F.col("asked"), F.lit(False))
    use = F.coalesce(F.col("given"), F.lit(False)) & in_cap
    return joined.select(
        *keys,
        F.when(use, F.col("strategy")).otherwise(F.col("r_strategy")).alias("strategy"),
        F.when(use, F.col("reasoning")).otherwise(F.col("r_reasoning")).alias("reasoning"),
        F.when(use, F.col("confidence")).otherwise(RULE_CONFIDENCE).alias("confidence"),
        F.when(use, F.col("fill_value")).alias("fill_value"),
        F.when(use, "llm").otherwise("rule").alias("source"),
        (~in_cap).alias("by_cap"),
        (~use & in_cap).alias("by_failure"),
    )


def fallback_warnings(advice: DataFrame) -> DataFrame:
    """(.., warning): one line per run and reason for which the rules stood in."""
    by = ["run_id"] if "run_id" in advice.columns else []
    counted = advice.groupBy(*by).agg(
        F.count_if("by_failure").alias("failed"), F.count_if("by_cap").alias("capped")
    )
    lines = F.array_compact(
        F.array(
            F.when(
                F.col("failed") > 0,
                F.concat(F.col("failed").cast("string"), F.lit(" recommendations came from the built-in rules.")),
            ),
            F.when(
                F.col("capped") > 0,
                F.concat(
                    F.col("capped").cast("string"),
                    F.lit(" lower-priority issues were advised by the built-in rules."),
                ),
            ),
        )
    )
    return counted.select(*by, F.explode(lines).alias("warning"))


def auto_decisions(advice: DataFrame) -> DataFrame:
    """Approve every recommendation that changes something."""
    return advice.select(
        *_keys(advice), (F.col("strategy") != "none").alias("approved"), "strategy", "fill_value"
    )


def default_decisions(issues: DataFrame, advice: DataFrame, decisions: DataFrame) -> DataFrame:
    """Starting point of a review: an earlier decision, else the advice, else the detector's default."""
    keys = _keys(issues, advice, decisions)
    a = advice.select(*keys, F.col("strategy").alias("a_strategy"), F.col("fill_value").alias("a_fill"))
    d = decisions.select(
        *keys,
        F.col("approved").alias("d_approved"),
        F.col("strategy").alias("d_strategy"),
        F.col("fill_value").alias("d_fill"),
    )
    chosen = F.coalesce("d_strategy", "a_strategy", "default_strategy")
    fill = F.coalesce(F.nullif(F.col("d_fill"), F.lit("")), F.nullif(F.col("a_fill"), F.lit("")))
    return (
        issues.join(a, keys, "left")
        .join(d, keys, "left")
        .select(
            *keys,
            F.coalesce(F.col("d_approved"), chosen != "none").alias("approved"),
            chosen.alias("strategy"),
            fill.alias("fill_value"),
        )
    )


def bulk_decisions(decisions: DataFrame, mode: str) -> DataFrame:
    """Approve ``all``, ``none`` or only the ``safe`` (non-destructive) ones; 'none' is never approved."""
    rules = {
        "all": F.lit(True),
        "none": F.lit(False),
        "safe": ~F.col("strategy").isin(*M.DESTRUCTIVE),
    }
    return decisions.withColumn("approved", rules[mode] & (F.col("strategy") != "none"))


def result_view(
    issues: DataFrame, advice: DataFrame, decisions: DataFrame, applied: DataFrame | None = None
) -> DataFrame:
    """Issues with advice, decision and outcome side by side."""
    keys = _keys(issues, advice, decisions)
    out = issues.join(
        advice.select(*keys, F.struct("strategy", "reasoning", "confidence", "fill_value", "source").alias("advice")),
        keys,
        "left",
    ).join(
        decisions.select(*keys, F.struct("approved", "strategy", "fill_value").alias("decision")), keys, "left"
    )
    if applied is not None:
        outcome = F.struct("applied", "rows_changed", "rows_removed", "columns_removed", "detail")
        out = out.join(applied.select(*keys, outcome.alias("outcome")), keys, "left")
    return out
