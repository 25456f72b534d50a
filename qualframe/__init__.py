"""Data quality on Spark: profile, detect, score, advise, repair and measure again."""

from qualframe.model import Decision, Issue, Thresholds
from qualframe.operators.detect import detect, detect_issues
from qualframe.operators.fixes import FixRejected, apply_all, apply_fix
from qualframe.operators.profile import profile_columns
from qualframe.operators.score import score_issues
from qualframe.registry import Detector, Strategy, register, registered, unregister
from qualframe.plans.clean import analyze, apply, clean
from qualframe.sources.delimited import LoadError, preview, read_delimited

__all__ = [
    "Decision",
    "Detector",
    "FixRejected",
    "Issue",
    "LoadError",
    "Strategy",
    "Thresholds",
    "analyze",
    "apply",
    "apply_all",
    "apply_fix",
    "clean",
    "detect",
    "detect_issues",
    "preview",
    "profile_columns",
    "read_delimited",
    "register",
    "registered",
    "score_issues",
    "unregister",
]
