import csv
import gzip
import os
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException

import qualframe as qf

from qualframe.operators.facts import HIDDEN
from qualframe.plans import history as history_module
from qualframe.plans.clean import analyze, clean
from qualframe.plans.history import History, run_list
from qualframe.plans.report import audit_report
from qualframe.model import Decision
from qualframe.sources.delimited import (
    LoadError, clean_names, preview, read_delimited, sniff_delimiter,
)
from qualframe.sources.blocks import lines, states_before
from qualframe.sources.tables import land, write_delimited, write_parquet


def write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def rows(df):
    return [tuple(r) for r in df.orderBy(HIDDEN).drop(HIDDEN).collect()]


def test_delimiters(spark, folder):
    one = read_delimited(spark, write(folder, "one.csv", "total\n10\n20\n30\n"))
    assert one.columns == [HIDDEN, "total"] and rows(one) == [("10",), ("20",), ("30",)]
    assert rows(read_delimited(spark, write(folder, "s.csv", "a;b\n1;2\n"))) == [("1", "2")]
    assert rows(read_delimited(spark, write(folder, "t.tsv", "a\tb,c\n1\t2\n"))) == [("1", "2")]
    assert [sniff_delimiter(h) for h in ("a,b;c", "a|b|c,d", "total")] == [",", "|", ","]


def test_cells_stay_literal(spark, folder):
    text = "﻿id,note,City,city\n1,\"a, \"\"b\"\"\",N/A,\n\n2, x ,null,001\n"
    df = read_delimited(spark, write(folder, "l.csv", text))
    assert df.columns[1:] == ["id", "note", "City", "city"]
    assert rows(df) == [("1", 'a, "b"', "N/A", ""), ("2", " x ", "null", "001")]


def test_names_are_tidied(spark, folder):
    df = read_delimited(spark, write(folder, "n.csv", " a ,,\"b, c\"\n1,2,3\n"))
    assert df.columns[1:] == ["a", "column_2", "b, c"] and rows(df) == [("1", "2", "3")]
    with pytest.raises(LoadError):
        clean_names(["a", " a"])


def test_refusals(spark, folder):
    with pytest.raises(LoadError, match="Unsupported"):
        read_delimited(spark, write(folder, "x.pdf", "a"))
    with pytest.raises(LoadError, match="empty"):
        read_delimited(spark, write(folder, "e.csv", " \n"))
    with pytest.raises(LoadError, match="no rows"):
        read_delimited(spark, write(folder, "h.csv", "a,b\n\n"))


def test_preview_and_sinks(spark, flawed, folder):
    head = preview(flawed, 2).collect()
    assert [r["Ticket"] for r in head] == ["1", "2"] and head[1]["Remark"] == ""
    back = write_parquet(flawed, os.path.join(folder, "p"))
    assert back.count() == 11 and HIDDEN not in back.columns
    assert land(flawed, os.path.join(folder, "l")).columns == flawed.columns
    out = os.path.join(folder, "d.csv")
    write_delimited(flawed, out)
    again = read_delimited(spark, out)
    assert again.drop(HIDDEN).exceptAll(flawed.drop(HIDDEN)).isEmpty() and again.count() == 11


def test_analysis_changes_nothing_and_clean_measures_again(spark, flawed, folder):
    found = analyze(flawed)
    assert found.advice.count() == len(found.issues) == found.score.first()["issue_count"]
    _, result = clean(flawed, os.path.join(folder, "out"))
    assert result.score_after.first()["score"] > found.score.first()["score"]
    assert spark.read.parquet(os.path.join(folder, "out")).count() == 10
    assert any(i.issue_type == "missing_values" and i.column == "Remark" for i in result.issues_after)
    assert dict(result.cleaned.dtypes)["Cost"] == "double"


def test_history(spark, flawed, folder):
    history = History(spark, os.path.join(folder, "h"))
    assert history.overview().first()["runs"] == 0
    found, result = clean(flawed)
    before, after = found.score.first()["score"], result.score_after.first()["score"]
    for run in ("1", "2"):
        history.save_run(run, filename="t.csv", status="analyzing", rows_before=11, provider="rules", model="built-in")
        history.save_issues(run, found.issues_df)
        history.save_advice(run, found.advice.drop("by_cap", "by_failure"))
        history.add_events(run, [("human", "uploaded", "a|b"), ("detector", "scanned", "x" * 3000)])
    history.save_decisions("1", [Decision(i.issue_id, True, i.default_strategy) for i in found.issues])
    history.save_applied("1", result.applied)
    history.save_issues("1", result.issues_after_df, "after")
    history.add_events("1", [("system", "validated", "done")])
    history.save_run("1", status="completed", score_before=before, score_after=after, fixes_applied=3, rows_after=10)
    assert history.read("issues", "1").where("phase = 'before'").count() == len(found.issues)
    over = history.overview().first()
    assert over["runs"] == 2 and over["average_score_lift"] == pytest.approx(round(after - before, 1))
    assert [r["run_id"] for r in history.runs().collect()] == ["2", "1"]
    log = history.audit_log("1").collect()
    assert [r["event"] for r in log] == ["uploaded", "scanned", "validated"] and len(log[1]["detail"]) == 2000

    issues = history.read("issues")
    lines = audit_report(
        history.read("runs"), issues.where("phase = 'before'"), issues.where("phase = 'after'"),
        history.read("advice"), history.read("applied_fixes"), history.read("audit"),
    ).orderBy("run_id", "part", "at", "line_no").collect()
    text = {run: [r["line"] for r in lines if r["run_id"] == run] for run in ("1", "2")}
    assert any("a\\|b" in x for x in text["1"]) and "- Carried out: yes" in text["1"]
    assert "_Nothing was repaired._" in text["2"]

    history.save_issues("1", result.issues_after_df.limit(0), "after")
    assert history.read("issues", "1").where("phase = 'after'").isEmpty()
    assert history.delete_run("1") and not history.delete_run("1")
    assert history.overview().first()["runs"] == 1 and history.read("audit", "1").isEmpty()


def test_history_takes_safe_ids_and_empty_lists(spark, folder):
    history = History(spark, folder)
    for bad in ("a:b", "1/../x", ""):
        with pytest.raises(ValueError):
            history.save_run(bad)
        with pytest.raises(ValueError):
            history.delete_run(bad)
    history.save_decisions("r1", [Decision("i", True, "none")])
    history.save_decisions("r2", [Decision("i", True, "none")])
    history.save_decisions("r1", [])
    assert [r.run_id for r in history.read("decisions").collect()] == ["r2"]


def test_two_writers_share_no_number(spark, folder, monkeypatch):
    monkeypatch.setattr(history_module, "now", lambda: "2026-01-01T00:00:00+00:00")
    one, two = History(spark, folder), History(spark, folder)
    for k in range(2):
        for writer, name in ((one, "a"), (two, "b")):
            writer.add_events("r", [("system", f"{name}{k}.{i}", "x") for i in range(3)])
    log = one.audit_log("r").collect()
    assert [r["seq"] for r in log] == list(range(12))
    for k in range(0, 12, 3):  # the events of a call stay together and in order
        events = [r["event"] for r in log[k : k + 3]]
        assert [e[-1] for e in events] == ["0", "1", "2"] and len({e[:2] for e in events}) == 1


def test_run_list_honours_its_limit(spark):
    runs = spark.range(300).selectExpr("CAST(id AS STRING) AS run_id", "CAST(id AS STRING) AS created_at")
    assert run_list(runs, 250).count() == 250


WIDE = "more cells than the header"


def test_lines_wider_than_the_header_are_refused_or_kept(spark, folder):
    text = 'a,b\n1,2\n3\n4,5,6\n"x,y","p,q"\n7,8,9,10\n,,z\n"u, v",w,"t, ""s"""\n3,"open\n\n5,\n'
    path = write(folder, "w.csv", text)
    with pytest.raises(PySparkException, match=WIDE):
        qf.read_delimited(spark, path).collect()
    with pytest.raises(PySparkException, match=WIDE):
        qf.read_delimited(spark, path).count()
    kept = qf.read_delimited(spark, path, surplus_column="line", multi_line=False)
    assert kept.columns == [HIDDEN, "a", "b", "line"]
    lines = [r["line"] for r in kept.orderBy(HIDDEN).select("line", "a").collect()]
    assert lines == ["", "", "4,5,6", "", "7,8,9,10", ",,z", '"u, v",w,"t, ""s"""', "", ""]
    assert kept.where("line != ''").count() == 4
    assert rows(kept)[:3] == [("1", "2", ""), ("3", "", ""), ("4", "5", "4,5,6")]
    assert rows(qf.read_delimited(spark, path, surplus_column="line"))[-1] == ("3", "open\n\n5,", "")
    with pytest.raises(LoadError, match="already"):
        qf.read_delimited(spark, path, surplus_column="b")
    one = write(folder, "v.csv", 'a\n1\n"2,3"\n3,"open\n')
    with pytest.raises(PySparkException, match=WIDE):
        qf.read_delimited(spark, one).collect()
    broken = write(folder, "m.csv", 'a,b\n"1\n2",3\n"4\n5",6,7\n8\n')
    with pytest.raises(PySparkException, match=WIDE):
        qf.read_delimited(spark, broken).collect()
    fits = qf.read_delimited(spark, write(folder, "f.csv", "a,b\n1,2\n3\n"))
    assert rows(fits) == [("1", "2"), ("3", "")]
    assert rows(qf.read_delimited(spark, write(folder, "g.tsv", "a\tb\n1\t2,3\n"))) == [("1", "2,3")]


def random_rows(seed, n):
    rng = random.Random(seed)
    parts = ["a", "b", ",", '"', "\n", "\r\n", "\n\n", " ", "é", '5" ', "x,\"", ""]
    return [(str(i), "".join(rng.choice(parts) for _ in range(rng.randrange(9)))) for i in range(n)]


@pytest.fixture
def block_size(spark):
    """block_size("97"): files are cut into blocks of so many bytes from now on."""
    names = ("maxPartitionBytes", "openCostInBytes", "minPartitionNum")

    def cut(size):
        for name, value in zip(names, (size, "1", "1")):
            spark.conf.set(f"spark.sql.files.{name}", value)

    yield cut
    for name in names:
        spark.conf.unset(f"spark.sql.files.{name}")


def write_csv(path, table, ending="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=ending)
        out.writerows([("x", "y"), *table])


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_records_do_not_depend_on_blocks(spark, folder, block_size, ending):
    first, second = random_rows(1, 300), random_rows(2, 200)
    write_csv(os.path.join(folder, "1.csv"), first, ending)
    write_csv(os.path.join(folder, "2.csv"), second, ending)
    want = [(i, *r) for i, r in enumerate(first + second)]
    for size in ("1g", "300", "41"):
        block_size(size)
        found = read_delimited(spark, folder + "/")
        got = sorted((r[HIDDEN]["row"], r["x"], r["y"]) for r in found.collect())
        assert got == want, size
    assert lines(spark, folder).select("file", "start").distinct().count() > 100


def test_quotes_inside_unquoted_cells_are_literal(spark, folder, block_size):
    path = write(folder, "q.csv", 'a,b\n5" pipe,x\n"q","r""\n,s"\n7"",8\n "z",9\n')
    want = [('5" pipe', "x"), ("q", 'r"\n,s'), ('7""', "8"), (' "z"', "9")]
    for size in ("1g", "3"):
        block_size(size)
        assert rows(read_delimited(spark, path)) == want


def test_old_line_endings_marks_and_blank_lines(spark, folder):
    assert rows(read_delimited(spark, write(folder, "r.csv", "a,b\r1,2\r\r3,4\r"))) == [("1", "2"), ("3", "4")]
    text = "\n\ufeffa;b\r\n1;2\r\n \t\r\n3;\"x\r\ny\"\r\n"
    assert rows(read_delimited(spark, write(folder, "b.csv", text.lstrip()))) == [("1", "2"), ("3", "x\r\ny")]
    assert rows(read_delimited(spark, write(folder, "t.tsv", "a\tb\n\t\n1\t2\n"))) == [("", ""), ("1", "2")]


def test_folders_patterns_and_compressed_files(spark, folder):
    table = random_rows(3, 50)
    write_csv(os.path.join(folder, "a1.csv"), table[:20])
    with gzip.open(os.path.join(folder, "a2.csv.gz"), "wt", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator="\n").writerows([("x", "y"), *table[20:]])
    for path in (folder + "/", folder + "/a*"):
        assert rows(read_delimited(spark, path)) == table
    assert rows(read_delimited(spark, folder + "/a2.csv.gz")) == table[20:]
    write(folder, "a3.csv", "x,z\n1,2\n")
    with pytest.raises(PySparkException, match="header differs"):
        read_delimited(spark, folder + "/").collect()


def test_states_of_lines():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(12)
        end0, end1 = (np.array([rng.random() < 0.5 for _ in range(n)], bool) for _ in range(2))
        for begin in (False, True):
            state, want = begin, []
            for i in range(n):
                want.append(state)
                state = bool(end1[i] if state else end0[i])
            got, last = states_before(end0, end1, begin)
            assert (got.tolist() if n else []) == want and last == state


def test_preview_counts_all_rows(flawed):
    head = preview(flawed, 2, total=True).collect()
    assert [(r["Ticket"], r["total_rows"]) for r in head] == [("1", 11), ("2", 11)]
