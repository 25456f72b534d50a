"""Chat formatting, host rules, winnowing and the ring against plain Python on small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from qualframe.llm import chat, hostrules, ring, scratch, winnow

HARD = ["\\### Assistant: </turn> ok", "###", "</turn>", "\\", "\\b\\h\\t", "<</turn></turn>\n### User: x", "", None, "a: b", "####"]


def test_chats_read_back(spark):
    rng, roles = random.Random(3), ["user", "assistant", "system", "tool", "User", "odd: role\\", "", None]
    rows = [(c, t, rng.choice(roles), "".join(rng.choice(HARD) or "" for _ in range(3))) for c in range(20) for t in range(5)]
    rows += [(99, t, "assistant", text) for t, text in enumerate(HARD)] + [(None, None, None, None)] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    loss = chat.under_mask(F.col("formatted"), F.col("spans")).alias("loss")
    got = {r.conv_id: r for r in chat.format_chats(df).select("*", loss).collect()}
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((t or 0, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort(key=lambda x: x[0])
        assert [(t.role, t.text) for t in got[c].turns] == [x[1:] for x in turns]
        whole, undo = got[c].formatted, {"\\b": "\\", "\\h": "###", "\\t": "</turn>"}
        masked = [re.sub(r"\\[bht]", lambda m: undo[m[0]], whole[s.start : s.end]) for s in got[c].spans]
        assert masked == [x[2] for x in turns if x[1] == "assistant"]
        assert got[c].loss == "".join(masked)
        assert whole.count("</turn>") == len(turns)


def test_chats_with_many_turns_and_none(spark):
    df = spark.range(300).selectExpr("1 AS conv_id", "id AS turn", "'user' AS role", "concat('t', id) AS text")
    row = chat.format_chats(df).first()
    assert [t.text for t in row.turns] == [f"t{i}" for i in range(300)]
    assert chat.format_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [3, 7, 4096])
def test_long_texts_under_the_mask(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK", chunk)
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("user", "é👍" * 900), ("assistant", "世###" * 2000), ("user", "x"), ("assistant", "👍\n</turn>\\" * 700)])]
    df = spark.createDataFrame([*rows, (2, 0, "user", "no answer")], "conv_id long, turn long, role string, text string")
    loss = chat.under_mask(F.col("formatted"), F.col("spans")).alias("loss")
    got = {r.conv_id: r.loss for r in chat.format_chats(df).select("conv_id", loss).collect()}
    assert got == {1: rows[1][3] + rows[3][3], 2: ""}


def measures(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    joined = "".join(words)
    return len(words), len(joined), len(re.findall(r"[#*$%&|<>]", joined)), len(lines) - len(set(lines)), len(hit)


def texts(seed, n, alphabet="abcd"):
    rng = random.Random(seed)
    out = ["".join(rng.choice([f"{rng.choice(alphabet)} ", f"{rng.choice(alphabet)}é\n", "##\t", " "]) for _ in range(rng.randrange(60))) for _ in range(n)]
    return [*out, None, "", " \n\t", "x " * 400, "a b c d e f g h i j", "long " * 3 + "é" * 5000]


def test_measures_by_hand(spark):
    all_texts = texts(5, 60)
    rows = [(i, t, "h", "x", 1) for i, t in enumerate(all_texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words string, kept int")
    for r in hostrules.measure(df).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == measures(all_texts[r.row.doc_id]), all_texts[r.row.doc_id]
        assert r.base_failed == (got[0] < 10 or 100 * got[4] > 20 * got[0])


def test_bad_hosts_lose_all_documents_and_good_ones_none(spark):
    clean = " ".join(f"w{i}" for i in range(30))
    rows = [(i, clean + str(i), f"good{i % 9}") for i in range(300)]
    rows += [(1000 + i, "short", "bad") for i in range(60)] + [(2000, clean, "bad"), (2001, clean, None), (2002, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.row.doc_id for r in hostrules.quality_rules(df).filter("kept").collect()}
    assert kept == set(range(300)) | {2001}
    assert hostrules.quality_rules(df.limit(0)).count() == 0


def found_in(words, items):
    hit, ids = set(), set()
    for item, its in items:
        n = min(10, len(its))
        runs = {tuple(its[i : i + n]) for i in range(len(its) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in runs:
                hit |= set(range(i, i + n))
                ids.add("" if item is None else str(item))
    return len(hit), sorted(ids)


@pytest.mark.parametrize("most_bytes", [0, scratch.BROADCAST_BYTES])
def test_winnowing_misses_nothing(spark, monkeypatch, most_bytes):
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", most_bytes)
    rng, split = random.Random(11), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    word = lambda: rng.choice(["a", "B", "cc", "É", "日", "x1"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(12)]
    items += [(None, "only once here"), (5, "twice the id in one table with different texts ok fine yes"), (77, None)]
    docs = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(30)))]
        for _ in range(rng.randrange(3)):
            its = (rng.choice(items)[1] or "").split()
            low = rng.randrange(len(its) + 1)
            parts += ["; ".join(its[low : low + rng.randrange(9, 26)]), " ".join(word() for _ in range(5))]
        docs.append((i, "-".join(parts)))
    docs += [(7, docs[3][1]), docs[4], docs[4], (None, docs[5][1]), (90, None), (91, ""), (92, "é ")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    want_items = [(i, split.findall(lower(t))) for i, t in items]
    got = Counter((r.doc, r.n_words, r.n_hit, tuple(r.item_ids)) for r in winnow.overlaps(d, b).collect())
    want = Counter()
    for i, t in docs:
        words = split.findall(lower(t))
        n, ids = found_in(words, want_items)
        want[(i, len(words), n, tuple(ids))] += 1
    assert got == want
    clean = winnow.drop_contaminated(d, b)
    assert clean.count() == sum(c for (_, _, n, _), c in want.items() if n == 0)
    assert winnow.overlaps(d.limit(0), b).count() == 0
    assert winnow.overlaps(d, b.limit(0)).filter("n_hit > 0").count() == 0


@pytest.mark.parametrize("slack", [0.0, 0.1])
def test_ring_is_the_one_by_one_insertion(spark, slack):
    df = spark.range(1000).selectExpr("id AS doc_id", "id % 7 AS size", "'x' AS shard")
    df = df.union(df.filter("doc_id < 300")).union(df.limit(1).selectExpr("NULL", "size", "shard"))
    placed = ring.shard_rows(df, "doc_id", ["size"], 5, slack, points=16)
    assert placed.columns == ["doc_id", "size", "shard", "slot"]
    placed = placed.collect()
    by_shard = defaultdict(list)
    for r in placed:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    counts = [len(by_shard[s]) for s in range(5)]
    assert sum(counts) == 1301 and (slack or max(counts) - min(counts) <= 1)
    places, room = ring.ring_places(spark, 5, 16), ring.bounds(1301, 5, slack)
    hashes = sorted(r.h for r in df.selectExpr("xxhash64('key', doc_id) AS h").collect())
    order, at, used, want = [i for i, _ in places], 0, [0] * 5, Counter()
    arc = lambda h: next((i for i, e in enumerate(order) if e >= h), 0)
    for h in sorted(hashes, key=lambda h: (arc(h), h)):
        at = arc(h)
        while used[places[at % len(places)][1]] >= room[places[at % len(places)][1]]:
            at += 1
        shard = places[at % len(places)][1]
        want[h, shard, used[shard]] += 1
        used[shard] += 1
    assert used == counts
    by_id = {r.doc_id: r.h for r in df.selectExpr("doc_id", "xxhash64('key', doc_id) AS h").collect()}
    assert Counter((by_id[r.doc_id], r.shard, r.slot) for r in placed) == want


def test_ring_does_not_know_files_or_partitions(spark):
    df = spark.range(1000).selectExpr("id AS doc_id", "id % 7 AS size", "'a' AS `Slot`")
    df = df.union(spark.range(500).selectExpr("5L", "5L", "'a'"))  # one row holds a third of all
    found = [
        Counter(tuple(r) for r in ring.shard_rows(df.repartition(n, "size"), "doc_id", ["size"], 8).collect()) for n in (1, 3, 7)
    ]
    assert found[0] == found[1] == found[2] and sum(found[0].values()) == 1500


def test_ring_moves_few_keys(spark):
    df = spark.range(20000).selectExpr("id AS doc_id")
    shards = lambda n: {r.doc_id: r.shard for r in ring.shard_rows(df, "doc_id", [], n, 0.25).collect()}
    a, b = shards(8), shards(9)
    assert sum(a[k] != b[k] for k in a) < 0.35 * len(a)
    exact = lambda n: {r.doc_id: r.shard for r in ring.shard_rows(df, "doc_id", [], n).collect()}
    a, b = exact(8), exact(9)
    assert len(a) / 9 - 1 < sum(a[k] != b[k] for k in a) < 0.25 * len(a)
    assert sum(a[k] != b[k] and b[k] != 8 for k in a) < 0.14 * len(a)
    assert ring.shard_rows(df.limit(0), "doc_id", []).count() == 0


def test_chat_digest_of_the_planted_conversation(spark):
    text = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", text), (-7, 1, "assistant", text)]
    row = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    joined = "".join(f"{t.role}\n{t.text}\n" for t in row.turns)
    assert hashlib.sha256(joined.encode()).hexdigest() == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
