import random
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from qualframe import model as M
from qualframe.model import Decision, Issue, issues_frame
from qualframe.operators import duplicates as DUP
from qualframe.operators import fixes
from qualframe.operators.detect import detect_issues
from qualframe.operators.facts import HIDDEN
from qualframe.operators.fixes import FixRejected, apply_all, apply_fix
from qualframe.operators.forward_fill import forward_fill
from qualframe.operators.quantiles import exact_medians
from qualframe.operators.score import score_issues


def issue_of(df, kind, column=None):
    return next(i for i in detect_issues(df) if i.issue_type == kind and column in (None, i.column))


def fix(df, issue, strategy, value=None):
    out = apply_fix(df, issue, Decision(issue.issue_id, True, strategy, value))
    return out.df, out.applied[0]


def made(kind, column, **metrics):
    return Issue(f"{kind}:{column}", kind, column, "high", "", "", 0, 0.0, "none", **metrics)


def cells(df, column):
    ordered = df.orderBy(HIDDEN) if HIDDEN in df.columns else df
    return [r[0] for r in ordered.select(column).collect()]


def test_trim(flawed):
    out, record = fix(flawed, issue_of(flawed, M.WHITESPACE), "trim_whitespace")
    assert record.rows_changed == 1
    assert cells(out, "Town") == [c.strip() for c in cells(flawed, "Town")]


def test_case(flawed):
    issue = issue_of(flawed, M.CASING)
    for strategy, want in (
        ("standardize_case_title", {"Turin", "Milan", "Rome"}),
        ("standardize_case_upper", {"TURIN", "MILAN", "ROME"}),
        ("standardize_case_lower", {"turin", "milan", "rome"}),
    ):
        assert set(cells(fix(flawed, issue, strategy)[0], "Town")) == want


def test_drop_duplicates_keeps_the_first(flawed):
    out, record = fix(flawed, issue_of(flawed, M.DUPLICATES), "drop_duplicates")
    assert record.rows_removed == 1
    assert sorted(r[0] for r in out.select(f"{HIDDEN}.row_no").collect()) == list(range(10))


@pytest.mark.parametrize("whole, limit", [(1 << 30, 0), (0, 0), (0, 1_000_000)])
def test_copies_are_dropped_for_all_sizes(spark, monkeypatch, whole, limit):
    monkeypatch.setattr(DUP, "SHUFFLE_WHOLE", whole)
    monkeypatch.setattr(DUP, "BROADCAST_HASHES", limit)
    df = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise((F.col("id") % 700).cast("string")).alias("v"),
        F.when(F.col("id") % 4 == 1, F.lit(None).cast("string")).otherwise("x").alias("w"),
    )
    want = df.distinct().count()
    assert DUP.drop_copies(df).count() == want
    count, examples = DUP.count_copies(df)
    assert count == 4000 - want and examples[0].startswith("v=1 | w=")
    ordered = df.withColumn(HIDDEN, F.struct(F.monotonically_increasing_id()))
    count, examples = DUP.count_copies(ordered)
    assert count == 4000 - want and examples == ["v=hot | w=x"] * 3
    unique = df.dropDuplicates()
    assert DUP.count_copies(unique) == (0, []) and DUP.drop_copies(unique).count() == want


def test_duplicates_with_maps(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2},), ({"b": 2, "a": 1},), ({"a": 1},)], "m map<string,int>")
    assert DUP.count_copies(df)[0] == 1
    assert DUP.drop_copies(df).count() == 2


@pytest.mark.parametrize("whole", [1 << 30, 0])
def test_copies_of_nested_rows(spark, whole):
    """Maps inside structs and arrays and variants, in any order of their entries; null and empty differ."""
    texts = ['{"a": 1, "b": [1, null]}', '{"b": [1, null], "a": 1}', '{"a": "1"}', "1", '"1"', None]
    rows = [(k, {"x": 1, "y": None}, [{"p": "q"}, None]) for k in range(6)] + [(k, {"y": None, "x": 1}, [{"p": "q"}, None]) for k in range(6)]
    df = spark.createDataFrame(rows, "k int, m map<string,int>, l array<map<string,string>>")
    said = F.element_at(F.array(*[F.lit(t) for t in texts]), F.col("k") + 1)
    df = df.select(F.struct(F.col("m").alias("inside"), F.lit(1).alias("one")).alias("s"), "l", F.parse_json(said).alias("v"), F.col("k").alias("at"))
    # the two spellings of one object are equal: k 0 and 1
    assert DUP.count_copies(df.drop("at"), shuffle_whole=whole)[0] == 12 - 5
    kept = DUP.drop_copies(df.drop("at"), shuffle_whole=whole)
    assert kept.count() == 5 and dict(kept.dtypes)["v"] == "variant"
    ordered = df.withColumn(HIDDEN, F.struct("at")).drop("at")
    count, examples = DUP.count_copies(ordered, shuffle_whole=whole)
    assert count == 7 and len(examples) == 3 and all(x.startswith("s={") for x in examples)
    firsts = DUP.drop_copies(ordered, shuffle_whole=whole)
    assert sorted(r[0] for r in firsts.select(f"{HIDDEN}.at").collect()) == [0, 2, 3, 4, 5]
    empties = spark.createDataFrame([(None, None), ({}, []), (None, None)], "m map<string,int>, l array<map<string,int>>")
    assert DUP.count_copies(empties, shuffle_whole=whole)[0] == 1


@pytest.mark.parametrize("whole, most", [(1 << 30, 1.2), (0, 2.2)])
def test_copies_are_counted_in_few_scans(spark, whole, most):
    seen = spark.sparkContext.accumulator(0)

    def counted(v):
        seen.add(1)
        return v % 50

    n = 2000
    df = spark.range(n).select(F.udf(counted, "long")("id").alias("v"), F.struct(F.col("id").alias("at")).alias(HIDDEN))
    assert DUP.count_copies(df, shuffle_whole=whole) == (n - 50, ["v=0", "v=1", "v=2"])
    assert seen.value <= most * n
    seen.value = 0
    assert DUP.count_copies(df.drop(HIDDEN), shuffle_whole=whole) == (n - 50, ["v=0", "v=1", "v=2"])
    assert seen.value <= most * n


def test_first_later_rows_wherever_they_are(spark):
    """Few copies, many, at the end only, and of one place, against the rows in order."""
    rng = random.Random(2)
    tables = [[rng.randrange(k) for _ in range(60)] for k in (2, 30, 1000)]
    tables += [[*range(50), 7], [*range(50), 7, 7, 3, 7], [1] * 5, [*range(9)]]
    for cells in tables:
        places = rng.sample(range(1000), len(cells))
        rows = [((p if p != min(places) else None,), v) for p, v in zip(places, cells)]
        df = spark.createDataFrame(rows, f"{HIDDEN} struct<at:int>, v int").repartition(3)
        known, later = set(), []
        for _, v in sorted(zip(places, cells)):
            later += [f"v={v}"] * (v in known)
            known.add(v)
        for examples in (1, 3, 5):
            assert DUP.count_copies(df, examples) == (len(later), later[:examples]), cells
    tied = spark.createDataFrame([((1,), "a"), ((1,), "a"), ((2,), "b"), ((3,), "b"), ((0,), "c")], f"{HIDDEN} struct<at:int>, v string")
    assert DUP.count_copies(tied) == (2, ["v=b", "v=a"])


def test_ordered_examples_are_compared_in_full(spark, monkeypatch):
    """With one hash for several rows only true copies are shown, in row order; ties with the first copy come last."""
    monkeypatch.setattr(DUP, "_row_hash", lambda df: F.xxhash64(F.length("v")))
    cells = ["a", "b", "c", "d", "a", "e", "b", "ff", "g", "ff", "c"]
    df = spark.createDataFrame(list(enumerate(cells)), "i int, v string").select(F.struct("i").alias(HIDDEN), "v")
    for whole in (1 << 30, 0):
        assert DUP.count_copies(df, shuffle_whole=whole) == (4, ["v=a", "v=b", "v=ff"])
        assert DUP.count_copies(df, 1, shuffle_whole=whole) == (4, ["v=a"])
    tied = df.withColumn(HIDDEN, F.struct((F.col(f"{HIDDEN}.i") * 0).alias("i")))
    count, shown = DUP.count_copies(tied)
    assert count == 4 and len(set(shown)) == 3 and set(shown) <= {"v=a", "v=b", "v=c", "v=ff"}


def test_medians_keep_their_digits(spark):
    big = [9007199254740993, 9007199254740995, 9007199254740995, None, -(2**62), 2**62]
    df = spark.createDataFrame([(b, None if b is None else Decimal(b) / 1000) for b in big], "b bigint, d decimal(38,3)")
    found = exact_medians(df, {"b": F.col("b"), "d": F.col("d")}, read_out=0)
    assert found == {"b": 9007199254740995, "d": Decimal("9007199254740.995")}
    out, record = fix(df, made(M.MISSING, "b", numeric=True), "fill_median")
    assert sorted(r.b for r in out.collect())[2:5] == [9007199254740995] * 3 and "9007199254740995 (median)" in record.detail
    rng = random.Random(1)
    values = [rng.choice([rng.randrange(-(2**63), 2**63), 2**53 + rng.randrange(9), 7]) for _ in range(999)]
    df = spark.createDataFrame([(v,) for v in values], "b bigint")
    for n in (999, 998, 1, 2):
        some = sorted(values[:n])
        want = Decimal(some[(n - 1) // 2] + some[n // 2]) / 2
        df = spark.createDataFrame([(v,) for v in values[:n]], "b bigint")
        assert exact_medians(df, {"b": F.col("b")}, read_out=5)["b"] == want
    assert exact_medians(df.limit(0), {"b": F.col("b")}) == {}


def test_dates(flawed, table):
    out, record = fix(flawed, issue_of(flawed, M.DATES), "normalize_dates")
    assert cells(out, "Opened")[1] == "2026-03-02" and "month/day/year" in record.detail
    assert record.rows_changed == 1
    df = table({"when": ["29/01/2026", "06/01/2026", "2026-01-07", "2026-01-08", "2026-01-09", "soon"]})
    out, record = fix(df, made(M.DATES, "when"), "normalize_dates")
    assert cells(out, "when")[:2] == ["2026-01-29", "2026-01-06"] and cells(out, "when")[5] == "soon"
    assert "day/month/year" in record.detail and "1 values" in record.detail


def test_coerce(flawed):
    out, record = fix(flawed, issue_of(flawed, M.MIXED), "coerce_numeric")
    assert record.rows_changed == 1 and cells(out, "Cost")[:3] == [10.5, 20.0, None]


def test_blank_invalid(flawed):
    out, record = fix(flawed, issue_of(flawed, M.INVALID), "blank_invalid")
    assert record.rows_changed == 1 and out.count() == 11
    assert cells(out, "ContactEmail")[2] is None and cells(out, "Ticket")[2] == "3"
    out, record = fix(flawed, issue_of(flawed, M.MIXED), "blank_invalid")
    assert record.rows_changed == 1 and cells(out, "Cost")[3] == "n/a"


def test_drop_rows(flawed):
    out, record = fix(flawed, issue_of(flawed, M.MISSING, "Cost"), "drop_rows")
    assert record.rows_removed == 2 and out.count() == 9
    out, record = fix(flawed, issue_of(flawed, M.INVALID), "drop_rows")
    assert record.rows_removed == 1


def test_averages(table):
    df = table({"id": [*"123456"], "amount": ["10", "20", "", "30", "", "40"]})
    issue = issue_of(df, M.MISSING, "amount")
    out, record = fix(df, issue, "fill_median")
    assert cells(out, "amount") == [10.0, 20.0, 25.0, 30.0, 25.0, 40.0] and "median" in record.detail
    out, record = fix(df, issue, "fill_mean")
    assert cells(out, "amount")[2] == 25.0 and record.rows_changed == 2
    odd = table({"amount": ["10", "x", "", "30"]})
    out, record = fix(odd, made(M.MISSING, "amount"), "fill_mean")
    assert cells(out, "amount") == [10.0, 20.0, 20.0, 30.0] and record.rows_changed == 2
    with pytest.raises(FixRejected, match="no numbers"):
        fix(table({"amount": ["x", ""]}), made(M.MISSING, "amount"), "fill_mean")


def test_average_is_refused_on_text(table):
    df = table({"town": ["Turin", "", "Milan", ""]})
    with pytest.raises(FixRejected, match="which is text"):
        fix(df, issue_of(df, M.MISSING), "fill_mean")


def test_mode_takes_the_lowest_on_a_tie(table):
    out, _ = fix(table({"v": ["b", "a", "b", "a", "", "c"]}), made(M.MISSING, "v"), "fill_mode")
    assert cells(out, "v")[4] == "a"
    with pytest.raises(FixRejected, match="is present, so none"):
        fix(table({"v": ["", "n/a"]}), made(M.MISSING, "v"), "fill_mode")


def test_mode_of_numbers_keeps_them_numbers(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,)], "v double")
    out, _ = fix(df, made(M.MISSING, "v"), "fill_mode")
    assert sorted(cells(out, "v")) == [1.0, 2.0, 2.0, 2.0]


def test_constant(flawed, spark):
    issue = issue_of(flawed, M.MISSING, "Remark")
    with pytest.raises(FixRejected, match="No value was given"):
        fix(flawed, issue, "fill_constant")
    out, record = fix(flawed, issue, "fill_constant", "Unknown")
    assert cells(out, "Remark").count("Unknown") == 9 == record.rows_changed
    numbers = spark.createDataFrame([(1.0,), (None,)], "v double")
    assert sorted(cells(fix(numbers, made(M.MISSING, "v"), "fill_constant", "7")[0], "v")) == [1.0, 7.0]
    assert sorted(cells(fix(numbers, made(M.MISSING, "v"), "fill_constant", "?!")[0], "v")) == ["1.0", "?!"]


def test_forward_fill(table):
    df = table({"v": ["", "a", "n/a", "", "b", ""]}).repartition(4)
    out, record = fix(df, made(M.MISSING, "v"), "forward_fill")
    assert cells(out, "v") == [None, "a", "a", "a", "b", "b"]
    assert record.rows_changed == 3 and "1 at the top" in record.detail
    with pytest.raises(FixRejected, match="no known order"):
        fix(df.drop(HIDDEN), made(M.MISSING, "v"), "forward_fill")


@pytest.mark.parametrize("rows_per_bucket", [7, 100, 10_000])
def test_forward_fill_over_many_buckets(spark, rows_per_bucket):
    """Long gaps cross whole buckets; a two-part order key."""
    df = spark.range(1000).select(
        F.struct((F.col("id") / 10).cast("int").alias("a"), F.col("id").alias("b")).alias(HIDDEN),
        "id",
        F.when(F.col("id") % 211 == 5, F.concat(F.lit("v"), "id")).otherwise("").alias("v"),
    )
    out = forward_fill(df.repartition(8), "v", rows_per_bucket).orderBy("id").toPandas()
    raw = df.orderBy("id").toPandas()["v"]
    want = raw.where(raw != "").ffill()
    assert out["v"].where(out["v"].notna(), None).tolist() == want.where(want.notna(), None).tolist()


def test_forward_fill_with_a_row_that_fills_buckets(spark):
    """Two thirds of the table are copies of one blank row."""
    df = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(301)).alias("k"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("v"), "id")).otherwise("").alias("v"),
    )
    df = df.select(F.struct("k").alias(HIDDEN), "k", "v")
    out = forward_fill(df, "v", 20)
    assert out.count() == 900
    assert out.where("v is null").count() == 0
    assert {r[0] for r in out.where("k = 301").select("v").distinct().collect()} == {"v300"}


def test_outliers(table):
    df = table({"amount": [*map(str, range(1, 41)), "500", ""]})
    issue = issue_of(df, M.OUTLIERS)
    out, record = fix(df, issue, "clip_outliers")
    assert record.rows_changed == 1 and float(cells(out, "amount")[40]) == issue.upper_bound
    assert cells(out, "amount")[41] == ""
    out, record = fix(df, issue, "remove_outlier_rows")
    assert record.rows_removed == 1 and "" in cells(out, "amount")
    whole = df.where("amount != ''")
    assert dict(fix(whole, issue, "clip_outliers")[0].dtypes)["amount"] == "double"
    with pytest.raises(FixRejected, match="range"):
        fix(df, made(M.OUTLIERS, "amount"), "clip_outliers")


def test_menu_is_enforced_and_complete(flawed):
    issue = issue_of(flawed, M.DUPLICATES)
    with pytest.raises(FixRejected, match="cannot be repaired"):
        fix(flawed, issue, "normalize_dates")
    out = apply_fix(flawed, issue, Decision(issue.issue_id, True, "none"))
    assert not out.applied[0].applied and "Nothing was to be done" in out.applied[0].detail
    assert set(M.MENU) == set(M.DIMENSION)
    assert {s for names in M.MENU.values() for s in names} == set(M.HELP) == set(M.RUN_RANK)


def test_every_offered_strategy_runs_or_refuses(flawed):
    for issue in detect_issues(flawed):
        for strategy in issue.allowed:
            try:
                out, record = fix(flawed, issue, strategy, "X" if strategy == "fill_constant" else None)
            except FixRejected:
                continue
            assert record.strategy == strategy and out.count() > 0


def test_safe_order_and_skips(flawed):
    issues = detect_issues(flawed)
    by_kind = {i.issue_type: i for i in issues}
    drop = made(M.CONSTANT, "Town")
    decisions = [
        Decision(drop.issue_id, True, "drop_column"),
        Decision(by_kind[M.DUPLICATES].issue_id, True, "drop_duplicates"),
        Decision(by_kind[M.WHITESPACE].issue_id, True, "trim_whitespace"),
        Decision("unknown", True, "none"),
        Decision(by_kind[M.CONSTANT].issue_id, False, "drop_column"),
    ]
    out = apply_all(flawed, [*issues, drop], decisions)
    assert [a.strategy for a in out.applied] == ["trim_whitespace", "drop_duplicates", "drop_column"]
    assert all(a.applied for a in out.applied) and "Town" not in out.df.columns and "Unit" in out.df.columns
    gone = apply_all(flawed.drop("Town"), issues, decisions[2:3])
    assert not gone.applied[0].applied and "an earlier step removed" in gone.applied[0].detail


def test_trimming_first_merges_near_copies(table):
    df = table({"v": ["a", "a ", "b"]})
    issues = [made(M.WHITESPACE, "v"), made(M.DUPLICATES, None)]
    decisions = [Decision(issues[1].issue_id, True, "drop_duplicates"), Decision(issues[0].issue_id, True, "trim_whitespace")]
    assert apply_all(df, issues, decisions).df.count() == 2


def test_nothing_approved_changes_nothing(flawed):
    issues = detect_issues(flawed)
    decisions = [Decision(i.issue_id, False, i.default_strategy) for i in issues]
    out = apply_all(flawed, issues, decisions)
    assert out.applied == [] and out.df.exceptAll(flawed).isEmpty() and out.rows_before == 11


def test_repairs_raise_the_score_and_are_idempotent(spark, flawed):
    def score(df):
        return score_issues(issues_frame(spark, detect_issues(df))).first()["score"]

    issues = detect_issues(flawed)
    decisions = [Decision(i.issue_id, True, i.default_strategy) for i in issues if i.default_strategy != "none"]
    once = apply_all(flawed, issues, decisions).df
    assert score(once) > score(flawed)
    again = apply_all(once, issues, decisions).df
    assert again.exceptAll(once).isEmpty() and once.exceptAll(again).isEmpty()
    assert isinstance(once.toPandas(), pd.DataFrame)


def test_typed_numbers_keep_type_and_digits(spark):
    from decimal import Decimal

    big = 9007199254740993
    rows = [(i, big + i, Decimal("1.10") + i, "q") for i in range(9)] + [(9, None, None, "q")]
    df = spark.createDataFrame(rows, "k int, n bigint, d decimal(20,2), __flag_quality string")
    issues = [
        M.Issue(f"m_{c}", M.MISSING, c, "low", "t", "d", 1, 10.0, "fill_median", numeric=True) for c in ("n", "d")
    ]
    out = apply_all(df, issues, [Decision(i.issue_id, True, "fill_median") for i in issues]).df
    assert out.dtypes == df.dtypes
    got = {r["k"]: r for r in out.collect()}
    assert all(got[i]["n"] == big + i and got[i]["d"] == rows[i][2] for i in range(9))
    assert got[9]["d"] == Decimal("5.10") and got[9]["n"] is not None and got[9]["__flag_quality"] == "q"


def test_clipping_keeps_a_typed_column(spark):
    df = spark.createDataFrame([(i,) for i in range(20)] + [(900,)], "n bigint")
    issue = M.Issue("o_n", M.OUTLIERS, "n", "low", "t", "d", 1, 5.0, "clip_outliers", lower_bound=-0.5, upper_bound=30.5)
    out = apply_all(df, [issue], [Decision("o_n", True, "clip_outliers")]).df
    assert out.dtypes == [("n", "bigint")] and sorted(r[0] for r in out.collect())[-2:] == [19, 30]


def test_scalars_of_all_columns_in_as_few_rounds_as_one_column_needs(table, monkeypatch):
    df = table(
        {
            "day": [" 13/02/2026 ", "03/02/2026", "", "04/02/2026"],
            "cost": ["1", " 2", "x", ""],
            "size": ["4", "", "4", "6"],
            "town": [" Rome", "rome ", "", "Milan"],
        }
    )
    steps = [
        (made(M.WHITESPACE, "day"), "trim_whitespace"),
        (made(M.DATES, "day"), "normalize_dates"),
        (made(M.MISSING, "day"), "fill_mode"),
        (made(M.WHITESPACE, "cost"), "trim_whitespace"),
        (made(M.MIXED, "cost"), "coerce_numeric"),
        (made(M.MISSING, "cost"), "fill_mean"),
        (made(M.MISSING, "size"), "fill_median"),
        (made(M.WHITESPACE, "town"), "trim_whitespace"),
        (made(M.CASING, "town"), "standardize_case_title"),
        (made(M.MISSING, "town"), "fill_mode"),
    ]
    rounds, gather = [], fixes.gather_scalars
    monkeypatch.setattr(fixes, "gather_scalars", lambda df, wanted: (rounds.append(sorted(wanted)), gather(df, wanted))[1])
    out = apply_all(df, [i for i, _ in steps], [Decision(i.issue_id, True, s) for i, s in steps])
    assert all(a.applied for a in out.applied), [a.detail for a in out.applied]
    rows = [tuple(r) for r in out.df.orderBy(HIDDEN).drop(HIDDEN).collect()]
    assert rows == [
        ("2026-02-13", 1.0, 4.0, "Rome"),
        ("2026-02-03", 2.0, 4.0, "Rome"),
        ("2026-02-03", 1.5, 4.0, "Rome"),
        ("2026-02-04", 1.5, 6.0, "Milan"),
    ]
    assert rounds == [
        [("fill_mean", "cost"), ("fill_median", "size"), ("fill_mode", "town"), ("normalize_dates", "day")],
        [("fill_mode", "day")],
    ]


def test_copies_are_dropped_once(table, monkeypatch):
    df = table({"a": ["1", "1", "2", ""], "b": ["x", "x", "y", "z"]})
    calls, drop = [], fixes.drop_copies
    monkeypatch.setattr(fixes, "drop_copies", lambda df: (calls.append(1), drop(df))[1])
    steps = [(made(M.DUPLICATES, None), "drop_duplicates"), (made(M.MISSING, "a"), "drop_rows")]
    out = apply_all(df, [i for i, _ in steps], [Decision(i.issue_id, True, s) for i, s in steps])
    assert [a.rows_removed for a in out.applied] == [1, 1] and out.df.count() == 2 and len(calls) == 1


def test_bucket_boundaries_are_one_constant(spark, monkeypatch):
    from qualframe.operators import forward_fill as module

    structs, struct = [], module.F.struct
    monkeypatch.setattr(module.F, "struct", lambda *c: (structs.append(1), struct(*c))[1])
    keys = [None, float("nan"), 1e-300, *[i + 0.123456789012345 for i in range(600)]]
    rows = [((k, i), "v%d" % i if i % 3 == 0 else "") for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, f"`{HIDDEN}` struct<k: double, i: int>, a string").repartition(5)
    filled = module.forward_fill(df, "a", rows_per_bucket=5)
    assert len(structs) < 40
    got = [r.a for r in filled.orderBy(HIDDEN).collect()]
    last, expected = None, []
    for _, a in sorted(rows, key=lambda r: (r[0][0] is not None, r[0][0] != r[0][0], r[0][0] or 0.0)):
        last = a or last
        expected.append(last)
    assert got == expected
