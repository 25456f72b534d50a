"""Names, menus, thresholds and row schemas shared by every module."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

# --- fixed values: issue types and the dimension each one speaks to ------------------------

MISSING = "missing_values"
DUPLICATES = "duplicate_rows"
MIXED = "mixed_types"
DATES = "inconsistent_dates"
OUTLIERS = "outliers"
WHITESPACE = "whitespace"
CASING = "inconsistent_casing"
INVALID = "invalid_format"
CONSTANT = "constant_column"

DIMENSION = {
    MISSING: "completeness",
    DUPLICATES: "uniqueness",
    MIXED: "validity",
    DATES: "consistency",
    OUTLIERS: "validity",
    WHITESPACE: "consistency",
    CASING: "consistency",
    INVALID: "validity",
    CONSTANT: "completeness",
}
DIMENSIONS = ("completeness", "uniqueness", "validity", "consistency")

# --- fixed values: severity weights and grade floors ----------------------------------------

SEVERITY_WEIGHT = {"low": 1.0, "medium": 2.5, "high": 5.0, "critical": 10.0}
GRADE_FLOORS = ((95, "Excellent"), (85, "Good"), (70, "Fair"), (50, "Poor"))
LOWEST_GRADE = "Critical"

# --- fixed values: which repairs each issue type allows --------------------------------------

MENU = {
    MISSING: (
        "none",
        "drop_rows",
        "fill_mean",
        "fill_median",
        "fill_mode",
        "fill_constant",
        "forward_fill",
    ),
    DUPLICATES: ("none", "drop_duplicates"),
    MIXED: ("none", "coerce_numeric", "blank_invalid"),
    DATES: ("none", "normalize_dates"),
    OUTLIERS: ("none", "clip_outliers", "remove_outlier_rows"),
    WHITESPACE: ("none", "trim_whitespace"),
    CASING: (
        "none",
        "standardize_case_title",
        "standardize_case_upper",
        "standardize_case_lower",
    ),
    INVALID: ("none", "blank_invalid", "drop_rows"),
    CONSTANT: ("none", "drop_column"),
}

# Order in which approved repairs run: tidy values, then fill, then remove rows and columns.
RUN_RANK = {
    "trim_whitespace": 0,
    "standardize_case_title": 1,
    "standardize_case_upper": 1,
    "standardize_case_lower": 1,
    "coerce_numeric": 2,
    "normalize_dates": 2,
    "blank_invalid": 3,
    "fill_mean": 4,
    "fill_median": 4,
    "fill_mode": 4,
    "fill_constant": 4,
    "forward_fill": 4,
    "clip_outliers": 5,
    "drop_duplicates": 6,
    "remove_outlier_rows": 7,
    "drop_rows": 8,
    "drop_column": 9,
    "none": 10,
}

DESTRUCTIVE = ("drop_rows", "drop_duplicates", "remove_outlier_rows", "drop_column")

# One sentence per repair, shown to whoever has to choose.
HELP = {
    "none": "Make no change and keep a note that this was decided.",
    "drop_rows": "Remove each row in which this column has the problem.",
    "fill_mean": "Put the column's arithmetic mean into its blank cells.",
    "fill_median": "Put the column's median into its blank cells; extremes do not sway it.",
    "fill_mode": "Put the value seen most often into the blank cells.",
    "fill_constant": "Put one value of your own, for example 0 or 'Unknown', into the blank cells.",
    "forward_fill": "Repeat the last value seen above each blank; use it on ordered data only.",
    "drop_duplicates": "Keep one copy of every repeated row.",
    "coerce_numeric": "Turn the column into numbers; text that cannot be read as one becomes blank.",
    "normalize_dates": "Write all readable dates as YYYY-MM-DD.",
    "trim_whitespace": "Cut white space from both ends of each value.",
    "standardize_case_title": "Spell the text values With Leading Capitals.",
    "standardize_case_upper": "Spell the text values IN CAPITALS.",
    "standardize_case_lower": "Spell the text values in small letters.",
    "clip_outliers": "Move extreme values to the nearer end of the usual range.",
    "remove_outlier_rows": "Remove each row with an extreme value in this column.",
    "blank_invalid": "Empty the cells that fail the check and leave their rows alone.",
    "drop_column": "Remove this column from the table.",
}

EMAIL = "email address"
PHONE = "phone number"


@dataclass(frozen=True)
class Thresholds:
    """Detector settings with their defaults; out-of-range values are refused."""

    missing_warn_pct: float = 5.0
    missing_critical_pct: float = 40.0
    outlier_iqr_multiplier: float = 3.0
    outlier_min_rows: int = 20
    mixed_type_tolerance_pct: float = 2.0
    high_cardinality_ratio: float = 0.5
    max_issues_advised: int = 40

    _BOUNDS = {
        "missing_warn_pct": (0, 100),
        "missing_critical_pct": (0, 100),
        "outlier_iqr_multiplier": (1, 10),
        "outlier_min_rows": (5, 100_000),
        "mixed_type_tolerance_pct": (0, 100),
        "high_cardinality_ratio": (0, 1),
        "max_issues_advised": (1, 200),
    }

    def __post_init__(self):
        for name, (low, high) in self._BOUNDS.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie between {low} and {high}")


@dataclass
class Issue:
    """One finding about one column (or, with ``column=None``, about whole rows)."""

    issue_id: str
    issue_type: str
    column: str | None
    severity: str
    title: str
    detail: str
    affected_rows: int
    affected_pct: float
    default_strategy: str
    evidence: list[str] = field(default_factory=list)
    null_pct: float | None = None
    numeric: bool | None = None
    numeric_pct: float | None = None
    formats: int | None = None
    lower_bound: float | None = None
    upper_bound: float | None = None
    clashing_groups: int | None = None
    expected: str | None = None

    @property
    def allowed(self) -> list[str]:
        return list(MENU[self.issue_type])

    @property
    def weight(self) -> float:
        return SEVERITY_WEIGHT[self.severity]


@dataclass(frozen=True)
class Decision:
    """What a person settled on for one issue."""

    issue_id: str
    approved: bool
    strategy: str
    fill_value: str | None = None


@dataclass
class AppliedFix:
    issue_id: str
    issue_type: str
    column: str | None
    strategy: str
    applied: bool
    rows_changed: int = 0
    rows_removed: int = 0
    columns_removed: int = 0
    detail: str = ""


ISSUE_SCHEMA = T.StructType(
    [
        T.StructField("issue_id", T.StringType()),
        T.StructField("issue_type", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("detail", T.StringType()),
        T.StructField("affected_rows", T.LongType()),
        T.StructField("affected_pct", T.DoubleType()),
        T.StructField("evidence", T.ArrayType(T.StringType())),
        T.StructField("allowed", T.ArrayType(T.StringType())),
        T.StructField("default_strategy", T.StringType()),
        T.StructField("null_pct", T.DoubleType()),
        T.StructField("numeric", T.BooleanType()),
        T.StructField("numeric_pct", T.DoubleType()),
        T.StructField("formats", T.LongType()),
        T.StructField("lower_bound", T.DoubleType()),
        T.StructField("upper_bound", T.DoubleType()),
        T.StructField("clashing_groups", T.LongType()),
        T.StructField("expected", T.StringType()),
    ]
)

ADVICE_SCHEMA = T.StructType(
    [
        T.StructField("issue_id", T.StringType()),
        T.StructField("strategy", T.StringType()),
        T.StructField("reasoning", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("fill_value", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)

DECISION_SCHEMA = T.StructType(
    [
        T.StructField("issue_id", T.StringType()),
        T.StructField("approved", T.BooleanType()),
        T.StructField("strategy", T.StringType()),
        T.StructField("fill_value", T.StringType()),
    ]
)

APPLIED_SCHEMA = T.StructType(
    [
        T.StructField("issue_id", T.StringType()),
        T.StructField("issue_type", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("strategy", T.StringType()),
        T.StructField("applied", T.BooleanType()),
        T.StructField("rows_changed", T.LongType()),
        T.StructField("rows_removed", T.LongType()),
        T.StructField("columns_removed", T.LongType()),
        T.StructField("detail", T.StringType()),
    ]
)


def _frame(spark: SparkSession, items, schema: T.StructType) -> DataFrame:
    rows = [tuple(getattr(item, name) for name in schema.names) for item in items]
    return spark.createDataFrame(rows, schema)


def issues_frame(spark: SparkSession, issues: list[Issue]) -> DataFrame:
    return _frame(spark, issues, ISSUE_SCHEMA)


def decisions_frame(spark: SparkSession, decisions: list[Decision]) -> DataFrame:
    return _frame(spark, decisions, DECISION_SCHEMA)


def applied_frame(spark: SparkSession, applied: list[AppliedFix]) -> DataFrame:
    return _frame(spark, applied, APPLIED_SCHEMA)


def issue_from_row(row: Row) -> Issue:
    known = {f.name for f in fields(Issue)}
    values = {k: v for k, v in row.asDict().items() if k in known}
    values["evidence"] = list(values.get("evidence") or [])
    return Issue(**values)


def decision_from_row(row: Row) -> Decision:
    return Decision(row["issue_id"], bool(row["approved"]), row["strategy"], row["fill_value"])


def menu_frame(spark: SparkSession) -> DataFrame:
    """The closed menu as a dimension table: one row per (issue type, strategy)."""
    rows = [
        (kind, strategy, position, strategy in DESTRUCTIVE, RUN_RANK[strategy], HELP[strategy])
        for kind, strategies in MENU.items()
        for position, strategy in enumerate(strategies)
    ]
    return spark.createDataFrame(
        rows,
        "issue_type string, strategy string, position int, destructive boolean, run_rank int, help string",
    )
