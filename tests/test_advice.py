import json

from qualframe import model as M
from qualframe.model import Decision, Issue, decisions_frame, issues_frame
from qualframe.operators import advise
from qualframe.operators.detect import detect_issues
from qualframe.operators.intake import check_replies


def issue(ident="i1", kind=M.MISSING, pct=8.0, numeric=True, severity="medium"):
    return Issue(ident, kind, "price", severity, "12 blanks", "8% empty", 12, pct, "fill_median", numeric=numeric)


def reply(*items):
    return json.dumps([{"id": i, "strategy": s, "reasoning": " because ", "confidence": 0.9} for i, s in items])


def checked(spark, raw, issues):
    replies = spark.createDataFrame([("r", raw)], "run_id string, reply string")
    known = spark.createDataFrame([("r", i.issue_id, i.issue_type) for i in issues], "run_id string, issue_id string, issue_type string")
    advice, errors = check_replies(replies, known)
    return advice.collect(), [r["message"] for r in errors.orderBy("nth").collect()]


def test_plain_fenced_and_wrapped_replies(spark):
    plain = reply(("i1", "fill_mode"))
    for raw in (
        plain,
        f"```json\n{plain}\n```",
        json.dumps({"n": 1, "results": json.loads(plain)}),
        f"Here you are: {plain} and that is it.",
    ):
        advice, errors = checked(spark, raw, [issue()])
        assert errors == [] and advice[0]["strategy"] == "fill_mode", raw
        assert (advice[0]["reasoning"], advice[0]["confidence"], advice[0]["source"]) == ("because", 0.9, "llm")


def test_replies_are_turned_down_as_a_whole(spark):
    both = [issue("i1"), issue("i2")]
    for raw, fault in (
        (reply(("i1", "fill_mode")), "Missing 1 ids, first i2"),
        (reply(("i1", "drop_duplicates"), ("i2", "none")), "not allowed for i1"),
        (reply(("i1", "none"), ("i2", "none"), ("i3", "none")), "Unknown issue id i3"),
        ("no idea", "no JSON array"),
        ('{"a": 1}', "no JSON array"),
        ("[]", "Missing 2 ids"),
        ('[{"id": "i1", "strategy": "none", "confidence": 2}, {"id": "i2", "strategy": "none"}]', "malformed"),
        ('[{"id": 5, "strategy": "none"}, {"id": "i2", "strategy": "none"}]', "malformed"),
    ):
        advice, errors = checked(spark, raw, both)
        assert advice == [] and any(fault in e for e in errors), (raw, errors)


def test_defaults_and_cuts(spark):
    raw = json.dumps([{"id": "i1", "strategy": "fill_constant", "reasoning": "x" * 900, "fill_value": "0"}])
    advice, errors = checked(spark, raw, [issue()])
    assert errors == [] and len(advice[0]["reasoning"]) == 800
    assert advice[0]["confidence"] == 0.8 and advice[0]["fill_value"] == "0"


def test_rules_cover_every_type(spark, flawed):
    issues = detect_issues(flawed)
    rows = advise.rule_advice(issues_frame(spark, issues)).collect()
    kinds = {i.issue_id: i.issue_type for i in issues}
    assert len(rows) == len(issues)
    for r in rows:
        assert r["strategy"] in M.MENU[kinds[r["issue_id"]]] and len(r["reasoning"]) > 30
    remark = next(r for r in rows if r["issue_id"] == "missing_values:remark")
    assert remark["strategy"] == "none" and "invent" in remark["reasoning"]


def test_rule_for_few_blanks(spark):
    cases = [issue("a", pct=4.0, numeric=False), issue("b", pct=4.0), issue("c", pct=30.0, numeric=False), issue("d", pct=60.0)]
    got = {r["issue_id"]: r["strategy"] for r in advise.rule_advice(issues_frame(spark, cases)).collect()}
    assert got == {"a": "fill_mode", "b": "fill_median", "c": "fill_mode", "d": "none"}


def test_cap_and_outage(spark):
    issues = issues_frame(spark, [issue("a", severity="low"), issue("b", severity="critical"), issue("c")])
    given = spark.createDataFrame(
        [(i, "fill_mean", "why", 0.9, None, "llm") for i in "ab"], M.ADVICE_SCHEMA
    )
    got = {r["issue_id"]: r for r in advise.combined_advice(issues, given, cap=2).collect()}
    assert [got[i]["source"] for i in "abc"] == ["rule", "llm", "rule"]
    assert (got["a"]["by_cap"], got["c"]["by_failure"]) == (True, True)
    lines = [r[0] for r in advise.fallback_warnings(advise.combined_advice(issues, given, cap=2)).collect()]
    assert any("lower-priority" in x for x in lines) and any("came from the built-in" in x for x in lines)


def test_payload_carries_the_menu(spark):
    payload = json.loads(advise.issue_payload(issues_frame(spark, [issue()])).first()["payload"])
    assert payload["id"] == "i1" and payload["affected_percent"] == 8.0 and payload["examples"] == []
    assert {a["strategy"]: a["means"] for a in payload["allowed"]}["fill_median"] == M.HELP["fill_median"]


def test_decisions(spark):
    issues = issues_frame(spark, [issue("a"), issue("b"), issue("c")])
    advice = spark.createDataFrame([("b", "drop_rows", "", 0.6, "", "rule")], M.ADVICE_SCHEMA)
    earlier = decisions_frame(spark, [Decision("c", False, "fill_constant", "0")])
    rows = advise.default_decisions(issues, advice, earlier).orderBy("issue_id").collect()
    assert [tuple(r) for r in rows] == [
        ("a", True, "fill_median", None), ("b", True, "drop_rows", None), ("c", False, "fill_constant", "0"),
    ]
    start = advise.default_decisions(issues, advice, earlier)
    safe = {r["issue_id"]: r["approved"] for r in advise.bulk_decisions(start, "safe").collect()}
    assert safe == {"a": True, "b": False, "c": True}
