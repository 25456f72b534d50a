"""Row numbers and salted joins against plain Python."""

from pyspark.sql import functions as F

from qualframe.llm import scratch
from qualframe.llm.ranks import hot_hashes, join_hot, numbered, numbered_by_group


def test_numbers_are_dense_for_any_partitioning(spark):
    words = [None, "", "a", "b", "é", "Z", "aa", *[f"w{i % 50}" for i in range(300)]]
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "w string, i int")
    want = sorted(((w, i) for i, w in enumerate(words)), key=lambda x: (x[0] is not None, (x[0] or "").encode(), x[1]))
    for parts in (1, 7):
        got = {r["at"]: (r["w"], r["i"]) for r in numbered(df.repartition(parts), ["w", "i"], "t").collect()}
        assert [got[k] for k in range(len(words))] == want
    assert numbered(df.limit(0), ["w", "i"], "t").collect() == []


def test_ranks_in_groups(spark):
    rows = [(g, k) for g, n in ((None, 3), ("a", 1), ("hot", 400), ("é", 20)) for k in range(n)]
    df = spark.createDataFrame(rows, "g_name string, k int").repartition(5)
    ranked, groups = numbered_by_group(df, "g_name", ["k"], "t")
    assert {(r["g_name"], r["g"], r["n"]) for r in groups.collect()} == {(None, 0, 3), ("a", 1, 1), ("hot", 2, 400), ("é", 3, 20)}
    for r in ranked.collect():
        assert r["rank"] == r["k"] and r["n"] == {None: 3, "a": 1, "hot": 400, "é": 20}[r["g_name"]]
    assert ranked.count() == len(rows)


def test_hot_keys_are_joined_whole(spark):
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 99).cast("string")).alias("key"))
    table = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("key", "name")
    hot = hot_hashes(table, F.col("name"), "n")
    assert hot.count() == 1
    joined = join_hot(rows, F.col("key"), table, F.col("name"), hot)
    assert joined.columns == ["id", "key", "name", "n"] and joined.where("key = name").select("id").distinct().count() == joined.count() == 30_000
    left = join_hot(rows, F.col("key"), table.where("name <> '0'"), F.col("name"), hot, "left")
    assert left.count() == 30_000 and left.where("n IS NULL").count() == rows.where("key = '0'").count()


def test_broadcasts_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", 9_000)
    df = spark.range(50).selectExpr("id AS a", "repeat('é', CAST(id AS int)) AS t", "CAST('xy' AS binary) AS b", "array('q', NULL) AS n")
    fixed = 8 * 4 * 50
    assert scratch.stored_bytes(df) == fixed + 2 * sum(range(50)) + 2 * 50 + 50 * len('{"n":["q",null]}')
    is_broadcast = lambda d: "strategy=broadcast" in d._jdf.queryExecution().analyzed().toString()
    assert is_broadcast(scratch.small(df))
    assert not is_broadcast(scratch.small(df.union(df)))
    assert scratch.stored_bytes(spark.range(2000)) == 16_000 and not is_broadcast(scratch.small(spark.range(2000)))
    assert scratch.stored_bytes(df.limit(0)) == 0 and is_broadcast(scratch.small(df.limit(0)))
