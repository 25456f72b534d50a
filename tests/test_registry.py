import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import qualframe as qf
from qualframe import model as M
from qualframe import registry
from qualframe.model import Thresholds, issues_frame
from qualframe.operators import detect
from qualframe.operators.advise import rule_advice
from qualframe.operators.detect import detect_issues
from qualframe.operators.score import score_issues


def finish_short(name, n, rows, limits):
    if n["short"]:
        text = f"{n['short']:.0f} short values in '{name}', the longest cell has {n['longest']:.0f}."
        return dict(affected_rows=int(n["short"]), title=text, detail=text, evidence=[f"{n['longest']:.0f}"])
    return None


SHORT = qf.Detector(
    kind="short_text",
    dimension="validity",
    menu=("pad_text",),
    advice="pad_text",
    aggregates=lambda cell, blank: {"short": F.count_if(~blank & (F.length(cell) < 3)), "longest": F.max(F.length(cell))},
    finish=finish_short,
)
NEGATIVE = qf.Detector(
    kind="negative_numbers",
    dimension="validity",
    menu=(),
    aggregates=lambda cell, blank: {"n": F.count_if(cell < 0)},
    finish=lambda name, n, rows, limits: n["n"] and dict(affected_rows=int(n["n"]), title="negative", detail="", severity="high"),
    applies=lambda field: isinstance(field.dataType, T.NumericType),
)
PAD = qf.Strategy(
    name="pad_text",
    rank=1,
    help="Fill short values up to three characters.",
    rewrite=lambda c, blank, decision: (F.when(blank | (F.length(c) >= 3), c).otherwise(F.rpad(c, 3, "_")), ~blank & (F.length(c) < 3)),
)


@pytest.fixture
def df(spark):
    rows = [("ab", "long one", -1, 2.0), ("abc", "x", 5, -3.5), ("", "another", -7, None), ("z", None, 0, 1.0)]
    return spark.createDataFrame(rows, "a string, b string, n int, d double")


def test_findings_of_registered_detectors(spark, df):
    before = detect_issues(df)
    with qf.registered(PAD, SHORT, NEGATIVE):
        issues = {(i.issue_type, i.column): i for i in detect_issues(df)}
        assert {k: i.affected_rows for k, i in issues.items() if k[0] in ("short_text", "negative_numbers")} == {
            ("short_text", "a"): 2, ("short_text", "b"): 1, ("negative_numbers", "n"): 2, ("negative_numbers", "d"): 1,
        }
        short = issues["short_text", "a"]
        assert short.evidence == ["3"] and short.allowed == ["none", "pad_text"] and short.default_strategy == "pad_text"
        assert short.issue_id == "short_text:a" and issues["negative_numbers", "n"].severity == "high"
        frame = issues_frame(spark, list(issues.values()))
        assert {r.issue_id: r.strategy for r in rule_advice(frame).collect()}["short_text:a"] == "pad_text"
        assert score_issues(frame).first()["validity"] < 100
        fixed = qf.apply_fix(df, short, qf.Decision("short_text:a", True, "pad_text"))
        assert sorted(r.a for r in fixed.df.collect()) == ["", "ab_", "abc", "z__"] and fixed.applied[0].rows_changed == 2
        _, result = qf.clean(df)
        assert not [i for i in result.issues_after if i.issue_type == "short_text"]
    assert detect_issues(df) == before and "short_text" not in M.MENU and not registry.DETECTORS


def test_registered_detectors_cost_no_further_pass(df, monkeypatch):
    """The same number of jobs, and of scans in the facts plan, with a detector and without."""
    def scans():
        plan = detect.column_facts(df)._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("LocalRelation") + plan.count("LogicalRDD")

    calls = []
    real = detect.column_facts
    monkeypatch.setattr(detect, "column_facts", lambda d: calls.append(1) or real(d))
    without = scans()
    detect_issues(df)
    with qf.registered(PAD, SHORT, NEGATIVE):
        assert scans() == without
        detect_issues(df)
    assert len(calls) == 4  # one in each scan and one in each detection


def test_what_cannot_be_registered():
    with pytest.raises(ValueError, match="already"):
        qf.register(qf.Strategy("trim_whitespace", 1, "", None))
    with pytest.raises(ValueError, match="unknown repairs"):
        qf.register(SHORT)
    with pytest.raises(ValueError, match="known already"):
        qf.register(qf.Detector("outliers", "validity", (), None, None))


def test_thresholds_reach_the_detector(df):
    seen = []
    with qf.registered(qf.Detector("probe", "validity", (), lambda c, b: {"n": F.count(c)}, lambda *a: seen.append(a) and None)):
        detect_issues(df, Thresholds(outlier_min_rows=33))
    assert {(a[0], a[1]["n"], a[2], a[3].outlier_min_rows) for a in seen} == {("a", 4.0, 4, 33), ("b", 3.0, 4, 33)}
