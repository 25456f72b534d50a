import random

import pytest
from pyspark.sql import functions as F

from qualframe import model as M
from qualframe.model import Thresholds, issues_frame
from qualframe.operators import detect as D
from qualframe.operators.detect import detect_issues
from qualframe.operators.frequencies import case_clashes, spelling_hashes
from qualframe.operators.frequencies import distinct_counts
from qualframe.operators.profile import profile_columns, profile_table, sample_values
from qualframe.operators.score import grade, score_issues


def kinds(df, thresholds=None):
    return {i.issue_type for i in detect_issues(df, thresholds)}


def named(df, kind, column=None, **limits):
    found = [i for i in detect_issues(df, Thresholds(**limits)) if i.issue_type == kind]
    return next(i for i in found if column in (None, i.column))


def test_each_planted_flaw_is_found(flawed):
    issues = {(i.issue_type, i.column): i for i in detect_issues(flawed)}
    assert issues[M.MISSING, "Remark"].affected_rows == 9
    assert issues[M.MISSING, "Remark"].severity == "critical"
    assert issues[M.MISSING, "Cost"].affected_rows == 2
    assert "written out" in issues[M.MISSING, "Cost"].detail
    assert issues[M.DUPLICATES, None].affected_rows == 1
    assert issues[M.DUPLICATES, None].evidence[0].startswith("Ticket=10 | Opened=2026-02-10")
    assert issues[M.MIXED, "Cost"].evidence == ["unknown yet"]
    assert issues[M.DATES, "Opened"].formats == 2
    assert issues[M.WHITESPACE, "Town"].evidence == ["'  turin '"]
    assert issues[M.CASING, "Town"].affected_rows == 3
    assert issues[M.CASING, "Town"].evidence == ["TURIN / Turin / turin"]
    assert issues[M.INVALID, "ContactEmail"].evidence == ["nobody"]
    assert issues[M.CONSTANT, "Unit"].affected_rows == 11
    assert len(issues) == 9


def test_order_is_worst_first(flawed):
    issues = detect_issues(flawed)
    assert issues == sorted(issues, key=lambda i: (-i.weight, -i.affected_pct, i.issue_id))


def test_same_findings_twice_and_for_any_partitioning(flawed):
    want = detect_issues(flawed.coalesce(1))
    assert detect_issues(flawed.coalesce(1)) == want
    assert detect_issues(flawed.repartition(8)) == want


def test_clean_table_has_no_findings(spark, table):
    days = range(1, 13)
    df = table(
        {
            "id": [str(d) for d in days],
            "name": [f"Name {d}" for d in days],
            "amount": [f"{100 + d}.00" for d in days],
            "day": [f"2026-01-{d:02d}" for d in days],
        }
    )
    issues = detect_issues(df)
    assert issues == []
    assert score_issues(issues_frame(spark, issues)).first()["score"] == 100.0


def test_only_columns_named_for_a_format_are_judged(table):
    df = table({"email": ["none of it", "b@x.com", "c@x.com"], "nickname": ["none of it", "bob", "carol"]})
    assert [i.column for i in detect_issues(df) if i.issue_type == M.INVALID] == ["email"]


def test_missing_threshold(flawed):
    assert M.MISSING not in kinds(flawed, Thresholds(missing_warn_pct=95))


def test_outlier_settings(table):
    df = table({"amount": [*map(str, range(1, 41)), "200"]})
    assert named(df, M.OUTLIERS, outlier_iqr_multiplier=1.5).evidence == ["200.00"]
    assert M.OUTLIERS not in kinds(df, Thresholds(outlier_iqr_multiplier=10))
    assert M.OUTLIERS not in kinds(table({"amount": ["10"] * 40 + ["10000"]}))
    assert M.OUTLIERS not in kinds(table({"amount": ["1", "2", "3", "900"]}))
    assert M.OUTLIERS not in kinds(table({"amount": [f"${i}" for i in range(40)] + ["$9000"]}))


def test_one_date_layout_is_no_finding(table):
    assert M.DATES not in kinds(table({"when": [f"{d} January 2026" for d in range(1, 9)]}))


def test_mixed_share_is_bounded(table):
    def mixed(words, numbers):
        return M.MIXED in kinds(table({"v": ["word"] * words + [str(i) for i in range(numbers)]}))

    assert mixed(1, 9) and mixed(7, 13)
    assert not mixed(8, 12) and not mixed(1, 3) and not mixed(2, 98)


def test_casing_skips_near_unique_text(table):
    cells = ["a", "A", "b", "c", "d", "e"]
    assert M.CASING not in kinds(table({"v": cells}))
    assert named(table({"v": cells * 3}), M.CASING).affected_rows == 6


def test_names_that_share_a_slug_keep_separate_ids(table):
    df = table({"A b": ["x", ""], "a_b": ["y", ""]})
    ids = [i.issue_id for i in detect_issues(df) if i.issue_type == M.MISSING]
    assert len(set(ids)) == 2


def test_typed_tables(spark):
    df = spark.createDataFrame(
        [(i, float(i % 30), None if i % 3 else "x", [i]) for i in range(60)] + [(60, 9000.0, "x", [1])],
        "k bigint, v double, t string, a array<int>",
    )
    df = df.withColumn("n", F.when(F.col("k") > 5, F.lit(float("nan"))).otherwise(F.col("k").cast("double")))
    issues = {(i.issue_type, i.column): i for i in detect_issues(df)}
    assert issues[M.OUTLIERS, "v"].affected_rows == 1
    assert issues[M.MISSING, "n"].numeric is True
    assert issues[M.MISSING, "t"].affected_rows == 40
    assert issues[M.CONSTANT, "t"].evidence == ["x"]


def test_empty_tables(spark):
    assert detect_issues(spark.createDataFrame([], "a string, b double")) == []


def test_hot_copies_and_hot_values(spark):
    """One row and one spelling hold most of the table."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 50)).alias("v")
    )
    duplicates = named(df, M.DUPLICATES)
    assert duplicates.affected_rows == 3000 - df.distinct().count()


def test_profile(flawed):
    rows = {r["name"]: r for r in profile_columns(flawed).collect()}
    assert list(rows) == [c for c in flawed.columns if not c.startswith("__")]
    assert rows["Remark"]["null_count"] == 9 and rows["Remark"]["sample_values"] == ["fine", "late"]
    assert rows["Cost"]["numeric_like_pct"] == pytest.approx(100 * 8 / 9)
    assert rows["Town"]["unique_count"] == 5
    assert rows["Opened"]["date_like_pct"] == 100.0
    whole = profile_table(flawed).first()
    assert (whole["rows"], whole["columns"]) == (11, 7)


def test_distinct_counts_of_every_type(spark):
    rng = random.Random(4)
    top = (1 << 63) - 1
    whole = [*range(-130, 130), top, top - 1, -top, -top - 1, *[rng.randrange(-top, top) for _ in range(100)]]
    values = [(rng.choice(whole), rng.randrange(-128, 128)) for _ in range(2000)] + [(v, 0) for v in whole] + [(None, None)] * 50
    df = spark.createDataFrame(values, "key long, b int").selectExpr(
        "key",
        "CAST(b AS tinyint) AS `a.b`",
        "CAST(key % 1000000000 / 7BD AS decimal(18, 4)) AS word",
        "CAST(b AS decimal(30, 2)) AS wide",
        "date_add(DATE'1970-01-01', b) AS day",
        "timestamp_micros(key % 100000) AS at",
        "CAST(b AS double) / 3 * if(b % 2 = 0, -0.0D, 1) AS `column`",
        "CAST(b AS float) AS f",
        "b > 0 AS flag",
        "if(b < 9, NULL, repeat(CAST(b AS string), 40)) AS long_text",
    ).repartition(7)
    got = {r["column"]: r["unique_count"] for r in distinct_counts(df).collect()}
    names = df.columns
    assert set(got) == set(names)
    seen = {n: {r[n] for r in df.collect() if r[n] is not None} for n in names}
    assert got == {n: len(s) for n, s in seen.items()}
    assert got["key"] == len(set(whole)) and set(distinct_counts(df.where("false")).collect()) == set()
    rough = {r["column"]: r["unique_count"] for r in distinct_counts(df, approx=True).collect()}
    assert all(abs(rough[n] - got[n]) <= 0.2 * got[n] + 1 for n in names)


def test_dense_numbers_are_exchanged_as_words(spark):
    plan = distinct_counts(spark.range(10))._jdf.queryExecution().toString()
    assert "bit_or" in plan and "SortAggregate" not in plan
    words = spark.range(1 << 20).groupBy(F.shiftright("id", 6)).count().count()
    assert words == 1 << 14


def test_samples_come_in_row_order(table):
    df = table({"v": ["z", "", "y", "a", "b", "c", "d"]}).repartition(5)
    assert sample_values(df).first()["sample_values"] == ["z", "y", "a", "b", "c"]


def test_score(spark, flawed):
    issues = detect_issues(flawed)
    row = score_issues(issues_frame(spark, issues)).first()
    points = sum(i.weight * min(1.0, i.affected_pct / 100 * 3 + 0.15) for i in issues)
    assert row["score"] == pytest.approx(round(max(0, 100 - points), 1))
    assert row["issue_count"] == len(issues)
    df = spark.createDataFrame([(s,) for s in (95.0, 85.0, 70.0, 50.0, 49.9)], "s double")
    assert [r[0] for r in df.select(grade(F.col("s"))).collect()] == [
        "Excellent", "Good", "Fair", "Poor", "Critical",
    ]


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(5000).selectExpr("CAST(9999 - id AS STRING) AS v")
    lowest = sorted(str(9999 - i) for i in range(5000))[:5]
    for n in (1, 7):
        assert sample_values(df.repartition(n)).first()["sample_values"] == lowest


def casing_by_hand(cells, ratio):
    spelt = [c.strip() for c in cells if c is not None and c.strip() not in ("", "N/A")]
    groups = {}
    for c in spelt:
        groups.setdefault(c.lower(), []).append(c)
    clash = {low: found for low, found in groups.items() if len(set(found)) > 1}
    if not clash or len(set(spelt)) > ratio * len(spelt):
        return None
    shown = [" / ".join(sorted(set(clash[low]))[:4]) for low in sorted(clash)[:3]]
    return len(clash), sum(map(len, clash.values())), shown


def test_case_clashes_by_hand(table):
    rng = random.Random(6)
    words = ["rome", "Rome", " ROME", "rOme", "romE", "bari", "Bari ", "é" * 90 + "x", "É" * 90 + "X", "pisa", "", "N/A", None, "Straße", "STRASSE"]
    columns = {f"c{k}": [rng.choice(words[k:]) for _ in range(300)] for k in range(0, 12, 3)}
    columns["unique"] = [f"Value {i // 2}".upper() if i % 2 else f"value {i // 2}" for i in range(300)]
    present = {n: sum(c is not None and c.strip() not in ("", "N/A") for c in cells) for n, cells in columns.items()}
    for ratio in (0.5, 1.0):
        got = case_clashes(table(columns).repartition(4), list(columns), present, ratio)
        want = {n: casing_by_hand(cells, ratio) for n, cells in columns.items()}
        assert {n: (r["groups"], r["affected"], r["examples"]) for n, r in got.items()} == {n: w for n, w in want.items() if w}


def test_spellings_are_counted_by_hashes(table):
    assert {f.dataType.simpleString() for f in spelling_hashes(table({"a": ["x"]}), ["a"]).schema} == {"int", "bigint"}
