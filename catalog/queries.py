"""One entry per operator: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views as W
from qualframe import model as M
from qualframe.functions import dates as D
from qualframe.functions import numbers as N
from qualframe.functions import values as V
from qualframe.operators import advise, duplicates, fixes, frequencies, intake, profile, score
from qualframe.operators.detect import detect_issues, sort_issues, with_row_order
from qualframe.operators.facts import HIDDEN, column_facts
from qualframe.operators.forward_fill import forward_fill
from qualframe.operators.quantiles import exact_quantiles
from qualframe.plans import history, report
from qualframe.plans.clean import clean
from qualframe.sources.delimited import DELIMITERS, preview, read_delimited
from qualframe.sources.tables import land, work_folder, write_delimited

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- sources and cell tests ----------------------------------------------------------------------


@query
def preview_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview(W.dirty_customers(spark, sf_dir), 20, ["cust_key"])


@query
def preview_orders_with_total(spark, sf_dir):
    return preview(W.dirty_orders(spark, sf_dir), 5, ["order_key", "unit_price"], total=True)


@query
def delimited_round_trip(spark, sf_dir):
    """Documents written as delimited text and read back in blocks, with the number of each row."""
    docs = with_row_order(W.table(spark, sf_dir, "documents"), ["doc_id"])
    path = work_folder(spark, "documents-text")
    write_delimited(docs, path)
    return read_delimited(spark, path + "/").select(F.col(f"{HIDDEN}.row").alias("row"), "*").drop(HIDDEN)


@query
def delimiter_choice(spark, sf_dir):
    """Customers written with each delimiter and read back without being told which, names tidied."""
    df = W.dirty_customers(spark, sf_dir).withColumnRenamed("segment", "  segment ")
    parts = []
    for delimiter in DELIMITERS:
        path = work_folder(spark, "customers-text")
        write_delimited(df, path, delimiter=delimiter)
        parts.append(read_delimited(spark, path + "/").drop(HIDDEN).withColumn("delimiter", F.lit(delimiter)))
    return reduce(DataFrame.unionByName, parts)


def _classes(df: DataFrame) -> DataFrame:
    names = ("blanks", "placeholders", "numeric_like", "date_like", "padded", "invalid", "strict_numbers")
    return column_facts(df).select(
        "column", "rows", *[F.coalesce(n, F.lit(0)).alias(n) for n in names]
    )


@query
def cell_classes_orders(spark, sf_dir):
    return _classes(W.dirty_orders(spark, sf_dir))


@query
def cell_classes_customers(spark, sf_dir):
    return _classes(W.dirty_customers(spark, sf_dir))


@query
def cell_classes_documents(spark, sf_dir):
    return _classes(W.table(spark, sf_dir, "documents").select("text", "lang", "source"))


@query
def number_readings(spark, sf_dir):
    """The two readings of a number, over text with commas and text without."""
    cells = W.dirty_orders(spark, sf_dir).select("revenue", "unit_price")
    return cells.agg(
        *[
            col
            for n in cells.columns
            for col in (
                F.count(N.strict_number(F.col(n))).alias(f"strict_{n}"),
                F.count(N.lenient_number(F.col(n))).alias(f"lenient_{n}"),
                F.max(N.lenient_number(F.col(n))).alias(f"max_{n}"),
            )
        ]
    )


@query
def date_layouts(spark, sf_dir):
    return frequencies.date_shapes(W.dirty_orders(spark, sf_dir), ["order_date"])


@query
def day_first_reading(spark, sf_dir):
    df = W.dirty_orders(spark, sf_dir)
    first, second = D.day_first_votes(F.col("order_date"))
    return df.agg(
        F.count_if(first).alias("first_over_12"),
        F.count_if(second).alias("second_over_12"),
        D.is_day_first(F.col("order_date")).alias("day_first"),
    )


@query
def title_case_names(spark, sf_dir):
    return W.table(spark, sf_dir, "part").select("p_partkey", V.title_case(F.col("p_type")).alias("spelt"))


# --- detectors ------------------------------------------------------------------------------------


def _found(spark: SparkSession, kind: str, tables: dict[str, DataFrame], *metrics: str) -> DataFrame:
    shown = ["table_name", "column", "severity", "affected_rows", "affected_pct", "default_strategy", *metrics]
    parts = [
        M.issues_frame(spark, detect_issues(df, kinds=(kind,))).withColumn("table_name", F.lit(name))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts).select(*shown)


def _dirty(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "orders": W.dirty_orders(spark, sf_dir),
        "customers": W.dirty_customers(spark, sf_dir),
        "events": W.dirty_events(spark, sf_dir),
    }


@query
def detect_missing_values(spark, sf_dir):
    return _found(spark, M.MISSING, _dirty(spark, sf_dir), "null_pct", "numeric")


@query
def detect_duplicate_rows(spark, sf_dir):
    texts = W.table(spark, sf_dir, "documents").drop("doc_id")
    return _found(spark, M.DUPLICATES, {"orders": W.dirty_orders(spark, sf_dir), "texts": texts})


@query
def detect_duplicates_nested(spark, sf_dir):
    """Copies among rows with maps inside structs and arrays and with variants, with row order and without."""
    df = W.nested_events(spark, sf_dir)
    ordered = with_row_order(df, ["event_id"]).drop("event_id")
    parts = []
    for name, table in (("ordered", ordered), ("unordered", df.drop("event_id"))):
        issues = M.issues_frame(spark, detect_issues(table, kinds=(M.DUPLICATES,)))
        shown = F.array_join("evidence", "\n") if name == "ordered" else F.lit(None).cast("string")
        parts.append(issues.select(F.lit(name).alias("table_name"), "affected_rows", shown.alias("evidence")))
    return reduce(DataFrame.unionByName, parts)


@query
def duplicates_hashed(spark, sf_dir):
    """Copies counted by row hashes first, as in tables too large to shuffle: all columns of whole tables."""
    tables = {
        "orders": W.dirty_orders(spark, sf_dir),
        "ordered": with_row_order(W.dirty_orders(spark, sf_dir), ["order_key"]),
        "documents": W.table(spark, sf_dir, "documents").drop("doc_id"),
    }
    found = {name: duplicates.count_copies(df, shuffle_whole=0) for name, df in tables.items()}
    rows = [(name, n, "\n".join(shown) if name != "documents" else None) for name, (n, shown) in found.items()]
    return spark.createDataFrame(rows, "table_name string, copies bigint, evidence string")


@query
def drop_copies_hashed_ordered(spark, sf_dir):
    """The first row of each group of equal rows, only suspects being shuffled; place is its place in row order."""
    df = W.nested_events(spark, sf_dir)
    kept = duplicates.drop_copies(with_row_order(df, ["event_id"]).drop("event_id"), shuffle_whole=0)
    return kept.select(F.col(f"{HIDDEN}.event_id").alias("place"), "user", F.to_json("said").alias("said"))


@query
def forward_fill_buckets(spark, sf_dir):
    """Forward fill over many buckets of the row order, whole rows of events."""
    df = with_row_order(W.dirty_events(spark, sf_dir), ["event_id"])
    return forward_fill(df, "event_type", rows_per_bucket=997).drop(HIDDEN)


@query
def delimited_fill_and_copies(spark, sf_dir):
    """Orders as delimited text, read back: the first copies and the fills follow the numbers of its rows."""
    path = work_folder(spark, "orders-text")
    write_delimited(with_row_order(W.dirty_orders(spark, sf_dir), ["order_key"]), path)
    read = land(read_delimited(spark, path + "/"), work_folder(spark, "orders-read")).repartition(13)
    kept = land(duplicates.drop_copies(read), work_folder(spark, "orders-kept"))
    filled = forward_fill(kept, "discount", rows_per_bucket=1000)
    return filled.select(F.col(f"{HIDDEN}.row").alias("row"), "order_key", "discount")


@query
def median_narrowed(spark, sf_dir):
    """Quartiles of all numbers of lineitem, their brackets narrowed scan by scan."""
    df = W.table(spark, sf_dir, "lineitem")
    names = [f.name for f in df.schema.fields if V.kind_of(f.dataType) == V.NUMBER]
    numbers = {n: N.number_of(F.col(n), df.schema[n].dataType) for n in names}
    found = exact_quantiles(df, numbers, [0.25, 0.5, 0.75], small=0, read_out=64)
    rows = [(name, n, *values) for name, (n, values) in found.items()]
    return spark.createDataFrame(rows, "column string, n bigint, q1 double, median double, q3 double")


@query
def fix_fill_median_wide(spark, sf_dir):
    """Medians of numbers above 2^53 and of long decimals, in their own type."""
    df = W.wide_lines(spark, sf_dir)
    for name in ("wide", "exact"):
        df = _fixed(df, _issue(M.MISSING, name), "fill_median")
    return df.withColumns({n: F.col(n).cast("string") for n in ("wide", "exact")})


@query
def detect_mixed_types(spark, sf_dir):
    evidence = F.array_join("evidence", " / ").alias("evidence")
    issues = detect_issues(W.dirty_orders(spark, sf_dir), kinds=(M.MIXED,))
    return M.issues_frame(spark, issues).select(
        "column", "severity", "affected_rows", "affected_pct", "numeric_pct", evidence
    )


@query
def detect_inconsistent_dates(spark, sf_dir):
    return _found(spark, M.DATES, _dirty(spark, sf_dir), "formats")


@query
def detect_outliers(spark, sf_dir):
    tables = {
        "orders": W.dirty_orders(spark, sf_dir),
        "given_orders": W.table(spark, sf_dir, "orders"),
        "events": W.table(spark, sf_dir, "events"),
        "documents": W.table(spark, sf_dir, "documents"),
        "lineitem": W.table(spark, sf_dir, "lineitem"),
        "supplier": W.table(spark, sf_dir, "supplier"),
        "part": W.table(spark, sf_dir, "part"),
    }
    return _found(spark, M.OUTLIERS, tables, "lower_bound", "upper_bound")


@query
def detect_whitespace(spark, sf_dir):
    return _found(spark, M.WHITESPACE, _dirty(spark, sf_dir))


@query
def detect_inconsistent_casing(spark, sf_dir):
    """All text columns of customers, documents and orders, whole texts among them."""
    evidence = F.array_join("evidence", "; ").alias("evidence")
    tables = {
        "customers": W.dirty_customers(spark, sf_dir),
        "documents": W.dirty_documents(spark, sf_dir),
        "orders": W.dirty_orders(spark, sf_dir),
        "given_orders": W.table(spark, sf_dir, "orders"),
    }
    parts = []
    for name, df in tables.items():
        issues = M.issues_frame(spark, detect_issues(df, kinds=(M.CASING,)))
        parts.append(issues.withColumn("table_name", F.lit(name)))
    return reduce(DataFrame.unionByName, parts).select(
        "table_name", "column", "severity", "affected_rows", "affected_pct", "clashing_groups", evidence
    )


@query
def detect_invalid_format(spark, sf_dir):
    return _found(spark, M.INVALID, _dirty(spark, sf_dir), "expected")


@query
def detect_constant_columns(spark, sf_dir):
    return _found(spark, M.CONSTANT, _dirty(spark, sf_dir))


def _all_issues(spark, df) -> DataFrame:
    return M.issues_frame(spark, detect_issues(df))


@query
def detect_all_orders(spark, sf_dir):
    """All nine detectors with the place each finding takes, worst first."""
    issues = detect_issues(W.dirty_orders(spark, sf_dir))
    ranked = [(i + 1, x.issue_id, x.severity, x.affected_rows, x.affected_pct) for i, x in enumerate(issues)]
    return spark.createDataFrame(
        ranked, "place int, issue_id string, severity string, affected_rows bigint, affected_pct double"
    )


@query
def detect_all_customers(spark, sf_dir):
    issues = _all_issues(spark, W.dirty_customers(spark, sf_dir))
    return issues.select("issue_id", "severity", "affected_rows", "affected_pct")


@query
def issues_worst_first(spark, sf_dir):
    """All issues of all runs, each run worst first."""
    return sort_issues(W.issue_log(spark, sf_dir), ["run_id"]).select("run_id", "issue_id", "severity")


@query
def issues_to_ask_about(spark, sf_dir):
    """The worst issues of each run, as far as the cap allows asking about them."""
    return advise.worst_issues(W.issue_log(spark, sf_dir), 2)


# --- profile and score ---------------------------------------------------------------------------


@query
def profile_orders(spark, sf_dir):
    return profile.profile_columns(W.dirty_orders(spark, sf_dir), samples=False).drop("mean_value", "position")


@query
def profile_documents(spark, sf_dir):
    df = W.table(spark, sf_dir, "documents")
    columns = profile.profile_columns(df)
    return columns.select("name", "non_null", "null_count", "unique_count", "numeric_like_pct", "date_like_pct")


def _counts_of(spark, sf_dir, name):
    columns = profile.profile_columns(W.table(spark, sf_dir, name), samples=False)
    return columns.select(F.lit(name).alias("table_name"), "name", "non_null", "null_count", "unique_count")


@query
def profile_lineitem(spark, sf_dir):
    return _counts_of(spark, sf_dir, "lineitem")


@query
def profile_events(spark, sf_dir):
    return _counts_of(spark, sf_dir, "events")


@query
def profile_dimensions(spark, sf_dir):
    frames = [_counts_of(spark, sf_dir, name) for name in ("region", "nation", "supplier", "part", "pages")]
    return reduce(lambda a, b: a.union(b), frames)


@query
def profile_samples(spark, sf_dir):
    samples = profile.sample_values(with_row_order(W.dirty_customers(spark, sf_dir), ["cust_key"]))
    return samples.select("column", F.array_join("sample_values", "|").alias("sample_values"))


@query
def value_range_lineitem(spark, sf_dir):
    return profile.value_range(W.table(spark, sf_dir, "lineitem"))


@query
def profile_table_orders(spark, sf_dir):
    return profile.profile_table(W.dirty_orders(spark, sf_dir))


@query
def context_line_orders(spark, sf_dir):
    columns = profile.profile_columns(W.table(spark, sf_dir, "orders"), samples=False)
    return profile.context_line(columns, "orders")


@query
def score_orders(spark, sf_dir):
    return score.score_issues(_all_issues(spark, W.dirty_orders(spark, sf_dir)))


@query
def score_runs(spark, sf_dir):
    """Scores of as many runs as there are orders."""
    scored = score.score_issues(W.issue_log(spark, sf_dir), ["run_id"], rounded=False)
    places = {c: F.round(c, 6) for c in (*M.DIMENSIONS, "score", "penalty")}
    return scored.withColumns(places)


@query
def issue_penalties(spark, sf_dir):
    return W.issue_log(spark, sf_dir).select(
        "run_id",
        "issue_id",
        F.round(score.penalty(), 6).alias("penalty"),
        score.dimension().alias("dimension"),
    )


# --- repairs ---------------------------------------------------------------------------------------


def _issue(kind: str, column: str | None, **metrics) -> M.Issue:
    return M.Issue(f"{kind}:{column or 'rows'}", kind, column, "high", "", "", 0, 0.0, "none", **metrics)


def _fixed(df: DataFrame, issue: M.Issue, strategy: str, value: str | None = None, order_by=None) -> DataFrame:
    decision = M.Decision(issue.issue_id, True, strategy, value)
    return fixes.apply_all(df, [issue], [decision], order_by, count_changes=False).df


def _bounds(df: DataFrame, column: str) -> M.Issue:
    return next(i for i in detect_issues(df.select(column), kinds=(M.OUTLIERS,)) if i.column == column)


@query
def fix_none(spark, sf_dir):
    return _fixed(W.dirty_customers(spark, sf_dir), _issue(M.WHITESPACE, "segment"), "none")


@query
def fix_drop_rows_missing(spark, sf_dir):
    return _fixed(W.dirty_orders(spark, sf_dir), _issue(M.MISSING, "notes"), "drop_rows")


@query
def fix_drop_rows_invalid(spark, sf_dir):
    issue = _issue(M.INVALID, "email", expected=M.EMAIL)
    return _fixed(W.dirty_customers(spark, sf_dir), issue, "drop_rows")


@query
def fix_fill_mean(spark, sf_dir):
    return _fixed(W.dirty_orders(spark, sf_dir), _issue(M.MISSING, "discount"), "fill_mean")


@query
def fix_fill_median(spark, sf_dir):
    return _fixed(W.dirty_orders(spark, sf_dir), _issue(M.MISSING, "revenue"), "fill_median")


@query
def fix_fill_mode(spark, sf_dir):
    return _fixed(W.dirty_events(spark, sf_dir), _issue(M.MISSING, "event_type"), "fill_mode")


@query
def fix_fill_constant(spark, sf_dir):
    return _fixed(W.dirty_orders(spark, sf_dir), _issue(M.MISSING, "notes"), "fill_constant", "Unknown")


@query
def fix_forward_fill(spark, sf_dir):
    issue = _issue(M.MISSING, "event_type")
    return _fixed(W.dirty_events(spark, sf_dir), issue, "forward_fill", order_by=["event_id"])


@query
def fix_drop_duplicates(spark, sf_dir):
    return _fixed(W.dirty_orders(spark, sf_dir), _issue(M.DUPLICATES, None), "drop_duplicates")


@query
def fix_coerce_numeric(spark, sf_dir):
    return _fixed(W.dirty_orders(spark, sf_dir), _issue(M.MIXED, "revenue"), "coerce_numeric")


@query
def fix_normalize_dates(spark, sf_dir):
    return _fixed(W.dirty_orders(spark, sf_dir), _issue(M.DATES, "order_date"), "normalize_dates")


@query
def fix_trim_whitespace(spark, sf_dir):
    return _fixed(W.dirty_customers(spark, sf_dir), _issue(M.WHITESPACE, "segment"), "trim_whitespace")


@query
def fix_case_title(spark, sf_dir):
    return _fixed(W.dirty_customers(spark, sf_dir), _issue(M.CASING, "segment"), "standardize_case_title")


@query
def fix_case_upper(spark, sf_dir):
    return _fixed(W.dirty_customers(spark, sf_dir), _issue(M.CASING, "segment"), "standardize_case_upper")


@query
def fix_case_lower(spark, sf_dir):
    return _fixed(W.dirty_customers(spark, sf_dir), _issue(M.CASING, "segment"), "standardize_case_lower")


@query
def fix_clip_outliers(spark, sf_dir):
    df = W.dirty_orders(spark, sf_dir)
    return _fixed(df, _bounds(df, "unit_price"), "clip_outliers")


@query
def fix_clip_outliers_typed(spark, sf_dir):
    df = W.table(spark, sf_dir, "events")
    return _fixed(df, _bounds(df, "value"), "clip_outliers")


@query
def fix_remove_outlier_rows(spark, sf_dir):
    df = W.dirty_orders(spark, sf_dir)
    return _fixed(df, _bounds(df, "unit_price"), "remove_outlier_rows")


@query
def fix_blank_invalid_format(spark, sf_dir):
    issue = _issue(M.INVALID, "phone", expected=M.PHONE)
    return _fixed(W.dirty_customers(spark, sf_dir), issue, "blank_invalid")


@query
def fix_blank_invalid_numbers(spark, sf_dir):
    return _fixed(W.dirty_orders(spark, sf_dir), _issue(M.MIXED, "revenue"), "blank_invalid")


@query
def fix_drop_column(spark, sf_dir):
    return _fixed(W.dirty_orders(spark, sf_dir), _issue(M.CONSTANT, "currency"), "drop_column")


def _order_steps(spark, sf_dir) -> tuple[DataFrame, list[M.Issue], list[M.Decision]]:
    df = W.dirty_orders(spark, sf_dir)
    price = _bounds(df, "unit_price")
    steps = [
        (_issue(M.CONSTANT, "currency"), "drop_column", None),
        (_issue(M.DUPLICATES, None), "drop_duplicates", None),
        (price, "remove_outlier_rows", None),
        (_issue(M.MISSING, "discount"), "fill_median", None),
        (_issue(M.MISSING, "notes"), "fill_constant", "none given"),
        (_issue(M.MIXED, "revenue"), "coerce_numeric", None),
        (_issue(M.DATES, "order_date"), "normalize_dates", None),
    ]
    issues = [issue for issue, _, _ in steps]
    return df, issues, [M.Decision(i.issue_id, True, s, v) for i, s, v in steps]


@query
def fix_all_in_order(spark, sf_dir):
    df, issues, decisions = _order_steps(spark, sf_dir)
    return fixes.apply_all(df, issues, decisions, count_changes=False).df


@query
def change_records(spark, sf_dir):
    df, issues, decisions = _order_steps(spark, sf_dir)
    applied = fixes.apply_all(df, issues, decisions).applied
    return M.applied_frame(spark, applied).select(
        "issue_id", "strategy", "applied", "rows_changed", "rows_removed", "columns_removed"
    )


@query
def legal_decisions(spark, sf_dir):
    return fixes.legal_decisions(W.decision_log(spark, sf_dir), W.issue_log(spark, sf_dir)).select(
        "run_id", "issue_id", "strategy", "legal", "problem"
    )


@query
def clean_customers(spark, sf_dir):
    """Scan, take the built-in advice, repair, scan again: the findings before and after."""
    found, result = clean(W.dirty_customers(spark, sf_dir))
    both = found.issues_df.withColumn("phase", F.lit("before")).unionByName(
        result.issues_after_df.withColumn("phase", F.lit("after"))
    )
    return both.select("phase", "issue_id", "affected_rows")


# --- advice and decisions --------------------------------------------------------------------------


@query
def rule_advice(spark, sf_dir):
    advice = advise.rule_advice(W.issue_log(spark, sf_dir))
    return advice.select("run_id", "issue_id", "strategy", "confidence", "source")


def _replies(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return intake.check_replies(W.reply_log(spark, sf_dir), W.issue_log(spark, sf_dir))


@query
def reply_advice(spark, sf_dir):
    return _replies(spark, sf_dir)[0]


@query
def reply_errors(spark, sf_dir):
    return _replies(spark, sf_dir)[1]


@query
def issue_payload(spark, sf_dir):
    """The payload's fields, read back from its JSON."""
    payload = advise.issue_payload(W.issue_log(spark, sf_dir))
    schema = "id string, affected_rows bigint, examples array<string>, allowed array<struct<strategy:string>>"
    read = F.from_json("payload", schema)
    return payload.select(
        "run_id",
        read["id"].alias("id"),
        read["affected_rows"].alias("affected_rows"),
        F.array_join(read["examples"], "|").alias("examples"),
        F.array_join(read["allowed"]["strategy"], "|").alias("allowed"),
    )


def _combined(spark, sf_dir) -> DataFrame:
    return advise.combined_advice(W.issue_log(spark, sf_dir), reply_advice(spark, sf_dir), cap=2)


@query
def combined_advice(spark, sf_dir):
    return _combined(spark, sf_dir).select(
        "run_id", "issue_id", "strategy", "confidence", "source", "by_cap", "by_failure"
    )


@query
def fallback_warnings(spark, sf_dir):
    return advise.fallback_warnings(_combined(spark, sf_dir))


@query
def auto_decisions(spark, sf_dir):
    return advise.auto_decisions(advise.rule_advice(W.issue_log(spark, sf_dir)))


@query
def default_decisions(spark, sf_dir):
    issues = W.issue_log(spark, sf_dir)
    return advise.default_decisions(issues, advise.rule_advice(issues), W.decision_log(spark, sf_dir))


def _bulk(spark, sf_dir, mode: str) -> DataFrame:
    decisions = advise.auto_decisions(advise.rule_advice(W.issue_log(spark, sf_dir)))
    return advise.bulk_decisions(decisions, mode).select("run_id", "issue_id", "approved", "strategy")


@query
def bulk_approve_all(spark, sf_dir):
    return _bulk(spark, sf_dir, "all")


@query
def bulk_approve_none(spark, sf_dir):
    return _bulk(spark, sf_dir, "none")


@query
def bulk_approve_safe(spark, sf_dir):
    return _bulk(spark, sf_dir, "safe")


@query
def result_view(spark, sf_dir):
    issues = W.issue_log(spark, sf_dir)
    decisions = W.decision_log(spark, sf_dir).where("issue_id != 'unknown:c0'")
    view = advise.result_view(issues, advise.rule_advice(issues), decisions, W.applied_log_known(spark, sf_dir))
    return view.select(
        "run_id",
        "issue_id",
        F.col("advice.strategy").alias("advised"),
        F.col("decision.strategy").alias("decided"),
        F.col("decision.approved").alias("approved"),
        F.col("outcome.applied").alias("applied"),
    )


# --- history ---------------------------------------------------------------------------------------


@query
def overview_runs(spark, sf_dir):
    return history.overview(W.run_log(spark, sf_dir), rounded=False).withColumn(
        "average_score_lift", F.round("average_score_lift", 6)
    )


@query
def newest_runs(spark, sf_dir):
    return history.run_list(W.run_log(spark, sf_dir), 50).select("run_id", "filename", "status", "created_at")


@query
def find_run(spark, sf_dir):
    return history.find_run(W.run_log(spark, sf_dir), "77").select("run_id", "filename", "status")


@query
def audit_report(spark, sf_dir):
    """Report lines of all runs."""
    runs, issues = W.run_log(spark, sf_dir), W.issue_log(spark, sf_dir)
    mine = runs.select("run_id")

    def of_runs(df: DataFrame) -> DataFrame:
        return df.join(mine, "run_id", "left_semi")

    lines = report.audit_report(
        runs,
        of_runs(issues),
        of_runs(issues.where(F.col("run_id").cast("bigint") % 2 == 0)),
        of_runs(advise.rule_advice(issues)),
        of_runs(W.applied_log_known(spark, sf_dir)),
        of_runs(W.audit_log(spark, sf_dir)),
    )
    return lines.where("part != 1 or line not like '- Because%'").select(
        "run_id", "part", "at", "line"
    )
