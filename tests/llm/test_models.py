"""Operators that run numpy or the tokenizers library inside tasks, against plain versions."""

import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
import zstandard
from tokenizers import AddedToken, Tokenizer

from qualframe.llm import bytebpe, licenses, probminhash, queries, resample, scratch, tokenfile, toxicity, words

ODD = ["", None, " ", "  a  b ", "\n\n x\n", "it's we'll\tgo", "é世界👍🏽 ok", "a" * 3000, "<|endoftext|> x", "\u0085  a", "!!!! ----", "é ﬁ İ"]


def odd_texts():
    rng = random.Random(2)
    alphabet = list(" \n\taaabé世👍!,.'s09")
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(200)]


@pytest.fixture(scope="module")
def multi():
    return queries.multi_tokenizer()


def test_ids_are_those_of_the_rank_library(spark, multi):
    ranks = bytebpe.read_ranks(public_tokenizers.path(queries.MULTI_RANKS))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = list(enumerate(odd_texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in bytebpe.encode_documents(df, multi).collect()}
    for i, t in rows:
        ids = plain.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids), t
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bytebpe.encode_documents(df.limit(0), multi).count() == 0


def test_split_characters_and_offsets(multi):
    own = bytebpe.Encoder(multi)
    ids = own.encode_batch(["a👍🏽"])[0]
    assert own.decode(ids) == "a👍🏽" and "�" in own.decode(ids[:2])
    offsets = own.offsets("ab 世 c")
    assert offsets[-1][1] == 6 and all(a < b for a, b in offsets)


def cut(t):
    return bytebpe.joined_at_blanks(t.replace("\n", " \n").split(" "))


def test_pieces_join_to_the_text():
    for t in [x or "" for x in odd_texts()] + ["\na", " a \nb\n\nc\td ", "\n", " "]:
        first, *rest = cut(t)
        assert first.replace(" \n", "\n") + "".join(map(bytebpe.written, rest)) == t


def test_pieces_have_the_ids_of_the_whole_text(multi, monkeypatch):
    monkeypatch.setattr(bytebpe, "KEPT_PIECES", 8)  # forgets all the time
    rng = random.Random(3)
    parts = [" ", "\n", "\t", "  ", "\n\n", "\r\n", "\u00a0", "\x1c", "\x85", "a", "Wort", "é.", "don't", "'s", "12", "½", "日本", "x" * 70]
    with open(public_tokenizers.path(queries.BPE_JSON), encoding="utf-8") as f:
        descriptions = [f.read(), multi]
    for own in map(bytebpe.Encoder, descriptions):
        assert own.cuts
        for _ in range(2000):
            t = "".join(rng.choices(parts, k=rng.randint(0, 12)))
            assert own.encode_batch([t])[0].tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_distinct_pieces_are_looked_up_once_a_run(multi, monkeypatch):
    class Counted(bytebpe.PieceIds):
        asked = 0

        def get(self, piece):
            Counted.asked += 1
            return super().get(piece)

        def __getitem__(self, piece):
            Counted.asked += 1
            return super().__getitem__(piece)

    rng = random.Random(4)
    words = ["Wort", "Wort,", "(a.b)", "don't", "('s", "é.", "12", "1,2", "日本", "\x01", "\nx", "ª;", "x" * 70 + "!", "<|endoftext|>"]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(20)] + ["", " ", "a  b", "\n", " a", "\x01", ","]
    with open(public_tokenizers.path(queries.BPE_JSON), encoding="utf-8") as f:
        descriptions = [f.read(), multi]
    for kept in (3, 1000):
        monkeypatch.setattr(bytebpe, "KEPT_PIECES", kept)
        for own in map(bytebpe.Encoder, descriptions):
            for t, ids in zip(texts, own.encode_batch(texts)):
                assert ids.tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids, t
            assert len(own.cache) <= kept
    own.cache = Counted(own._learn, own._word)
    found = own.encode_batch(["Wort, Wort. Wort; " * 500 + "end"])[0]
    assert len(found) >= 3000 and Counted.asked < 30 and "Wort" in own.cache and "Wort," not in own.cache


def test_other_tokenizers_get_whole_texts():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        description = f.read()
    own, plain = bytebpe.Encoder(description), Tokenizer.from_str(description)
    assert not own.cuts
    assert own.encode_batch(["Some Words"])[0].tolist() == plain.encode("Some Words", add_special_tokens=False).ids


def test_packed_ranks_come_back():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 1001):
        ranks = (2 ** rng.uniform(0, 32, n)).astype(np.uint32)
        control, data = tokenfile.pack(ranks)
        assert len(control) == -(-n // 4) and np.array_equal(tokenfile.unpack(control, data, n), ranks)


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 100)
    with open(public_tokenizers.path(queries.BPE_JSON), encoding="utf-8") as f:
        description = f.read()
    plain = Tokenizer.from_str(description)
    plain.encode_special_tokens = True
    rows = list(enumerate(odd_texts())) + [(None, "x y"), (3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    folder = scratch.new_path(spark, "tokens")
    tokenfile.write_tokens(df, description, folder)
    got = sorted(tokenfile.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    texts, start = defaultdict(list), 0
    for i, t in rows:
        texts[i].append([*plain.encode(t or "", add_special_tokens=False).ids, 0])
    for r in got:
        assert r.ids in texts[r.doc_id] and r.start == start and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    empty = scratch.new_path(spark, "tokens")
    tokenfile.write_tokens(df.limit(0), description, empty)
    assert tokenfile.read_tokens(spark, empty).count() == 0


def naive_similarity(a, wa, b, wb):
    x, y = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
    keys = x.keys() | y.keys()
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in keys) for d in x.keys() & y.keys())


def test_probability_jaccard_and_its_estimate():
    rng = np.random.default_rng(1)
    for share in (0.0, 0.5, 0.8, 1.0):
        ids = np.unique(rng.integers(1, 1 << 62, 60, dtype=np.uint64))
        a, b = ids[:50], np.sort(np.concatenate([ids[: int(50 * share)], ids[50 : 60 - int(10 * share)]]))
        wa, wb = rng.uniform(0.5, 3, len(a)), rng.uniform(0.5, 3, len(b))
        exact = probminhash.probability_jaccard(a, wa, b, wb)
        assert exact == pytest.approx(naive_similarity(a, wa, b, wb))
        left, right = probminhash.signatures([a, b], [wa, wb], 4000)
        assert abs((left == right).mean() - exact) < 0.05
    one = probminhash.signatures([np.array([5], np.uint64)], [np.array([1.0])], 125)
    assert (one == 5).all()


def classes_by_hand(texts):
    content = {i: probminhash.weighted_runs(words.word_hashes(t or "")) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and len(content[i][0]) and probminhash.probability_jaccard(*content[i], *content[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in texts}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    texts, sources = {}, [fresh(rng.choice([30, 80, 300])) for _ in range(15)]
    for i in range(220):
        copy = list(rng.choice(sources)) if rng.random() < 0.7 else fresh(rng.choice([3, 5, 40]))
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(4000)}"
        texts[i] = " ".join(copy)
    texts |= {300: None, 301: "", 302: "...", 303: "one two", 304: "One, two!"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    want = classes_by_hand(texts)
    got = {r.doc_id: r for r in probminhash.near_duplicates(df).collect()}
    assert {i: r.class_id for i, r in got.items()} == want
    assert {i for i, r in got.items() if r.kept} == {i for i, c in want.items() if i == c}
    extra = df.selectExpr("*", "doc_id AS entity", "'x' AS kept")
    repeated = extra.union(extra.filter("doc_id IN (0, 303)")).union(extra.filter("doc_id = 5").selectExpr("NULL", "text", "entity", "kept"))
    left = [r.doc_id for r in probminhash.drop_near_duplicates(repeated).collect()]
    assert sorted(left) == sorted(i for i, c in want.items() if i == c)
    assert probminhash.near_duplicates(df.limit(0)).count() == 0


def test_pairs_far_from_every_leader_are_linked(spark):
    rng = random.Random(5)
    base, texts = [f"w{i}" for i in range(300)], {}
    for i in range(150):  # similarity about 0.75 between families, so a bucket holds many of them
        own = list(base)
        for k in rng.sample(range(0, 300, 6), 5):
            own[k] = f"v{i}.{k}"
        texts[2 * i] = " ".join(own)
        own[rng.randrange(300)] = f"u{i}"
        texts[2 * i + 1] = " ".join(own)
    want = classes_by_hand(texts)
    assert len(set(want.values())) > 30
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.class_id for r in probminhash.near_duplicates(df).collect()} == want


@pytest.mark.parametrize("most_bytes", [0, scratch.BROADCAST_BYTES])
def test_every_large_group_meets_its_leader(spark, monkeypatch, most_bytes):
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", most_bytes)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:k] + [f"z{i}"] + base[k + 1 :])) for i, k in enumerate(random.Random(4).choices(range(200), k=400))]
    df = spark.createDataFrame([*rows, *[(1000 + i, " ".join(base)) for i in range(100)]], "doc_id long, text string")
    assert probminhash.near_duplicates(df).select("class_id").distinct().count() == 1


def toxic_rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text, toxic = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(5, 80))], i % 5 == 0
        for _ in range(3 if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["vile", "nasty,", "grumpf" + rng.choice("abc")]))
        out.append((i, " ".join(text), "xx" if i % 2 else "yy", int(toxic)))
    return out


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows(600, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.train(df.select("doc_id", "text", "lang"), df.filter("doc_id % 3 <> 1").select("doc_id", "toxic"), 1000)
    got = {r.doc_id: r.score for r in toxicity.score_documents(df, model, ["doc_id"]).collect()}
    wrong = sum((got[i] >= 0.7) != bool(y) for i, _, _, y in rows if i % 3 == 1)
    assert wrong <= 4 and set(model.thresholds) == {"xx", "yy"}
    odd = spark.createDataFrame([(1, None, None), (2, "", "xx"), (3, "vile nasty, " + "w1 " * 250_000, "yy")], "doc_id long, text string, lang string")
    scores = {r.doc_id: r.score for r in toxicity.score_documents(odd, model, ["doc_id"]).collect()}
    assert 0 <= scores[1] == scores[2] < 0.5 < scores[3] <= 1
    left = toxicity.drop_toxic(df.drop("toxic").selectExpr("*", "1 AS score"), model)
    assert abs(left.count() - 480) <= 6 and left.columns == ["doc_id", "text", "lang", "score"]


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame(toxic_rows(20, 2), "doc_id long, text string, lang string, toxic int")
    for labels, score in ((df.limit(0), 0.0), (df.filter("toxic = 1"), 1.0)):
        model = toxicity.train(df, labels.select("doc_id", "toxic"))
        assert {r.score for r in toxicity.score_documents(df, model, ["doc_id"]).collect()} == {score}
    assert toxicity.score_documents(df.limit(0), model, ["doc_id"]).count() == 0


def test_kth_largest(spark):
    values = [random.Random(6).randrange(-(1 << 40), 1 << 40) for _ in range(500)] + [7] * 100
    df = spark.createDataFrame([(v,) for v in values], "v long").cache()
    for k in (1, 2, 300, 600):
        assert resample.kth_largest(df, k) == sorted(values, reverse=True)[k - 1]


def test_resampling_prefers_the_target(spark):
    rng = random.Random(9)
    prose = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(40))
    junk = lambda: " ".join(rng.choice(["ALPHA!!", "%%%", "beta%%%"]) for _ in range(40))
    rows = [(i, prose()) for i in range(150)] + [(1000 + i, junk()) for i in range(50)] + [(2000, None), (2001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    good = spark.range(60).selectExpr("id AS doc_id")
    got = {r.doc_id: r for r in resample.resample(df, good, 0.5).collect()}
    assert sum(r.kept for r in got.values()) == 101
    assert not any(r.kept for i, r in got.items() if 1000 <= i < 2000)
    counts = resample.counts(df.withColumn("t", df.doc_id < 60), "t", "text")
    ratio, features = resample.log_ratios(*counts), resample.Features()
    for i, t in rows[:5]:
        assert got[i].log_importance == pytest.approx(ratio[features.of(t)].sum())
    scaled = {r.doc_id: r.log_importance for r in resample.resample(df, good, 0.5, length=64).collect()}
    assert scaled == pytest.approx({i: r.log_importance * 64 / max(r.n_ngrams, 1) for i, r in got.items()})
    assert counts[0].sum() == sum(len(features.of(t or "")) for _, t in rows)
    same = df.filter("doc_id = 3")
    twice = {r.kept for r in resample.resample(df.union(same).union(same), good, 0.5).filter("doc_id = 3").collect()}
    assert len(twice) == 1
    assert resample.resample(df.limit(0), good).count() == 0


def shape_of(word):
    core = word.strip(words.EDGES)
    kind = "".join("X" if c.isupper() else "9" if c.isdigit() else "x" if c.isalpha() else c for c in (core[:1], core[-1:]))
    return f"{kind} {word.replace(core, '~', 1) if core else word}"


def buckets_by_hand(text):
    """n-grams written out one by one."""
    whole = 1 << 64

    def mixed(x):
        x = [x % whole]
        return int(words.mix(np.array(x, np.uint64))[0])

    of = lambda t: xxhash.xxh3_64_intdigest(t)
    plain = [of(w.strip(words.EDGES).lower()) for w in (text or "").split()]
    shapes = [of(shape_of(w)) for w in (text or "").split()]
    out = [*plain, *shapes]
    out += [1 if a == b else mixed(3 * a + b) for a, b in zip(plain, plain[1:])]
    out += [mixed(5 * a + b + 7) for a, b in zip(shapes, shapes[1:])]
    return [x % resample.BUCKETS for x in out]


def test_the_whole_draw_by_hand(spark):
    rng = random.Random(12)
    vocabulary = ["Alpha", "beta,", "(gamma)", "x1", "9", "...", "Éa", "%%"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(40)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "beta, " * 50_000), (7, rows[7][1]), (None, "Alpha x1")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, good string").repartition(5)
    good = spark.createDataFrame([(i,) for i in range(0, 60, 2)] + [(None,), (4,), (999,)], "doc_id long")
    found = [buckets_by_hand(t) for _, t in rows]
    raw, target = Counter(), Counter()
    for (i, _), f in zip(rows, found):
        raw.update(f)
        if i is not None and i < 60 and i % 2 == 0:
            target.update(f)
    size = resample.BUCKETS
    q = {b: (raw[b] + 1) / (sum(raw.values()) + size) for b in raw}
    log_ratio = {b: math.log((target[b] + size * q[b]) / (sum(target.values()) + size) / q[b]) for b in raw}
    numbers = {
        (r.doc_id, r.text): r.h for r in df.selectExpr("doc_id", "text", "xxhash64(1, doc_id, coalesce(text, '')) AS h").collect()
    }
    want = []
    for (i, t), f in zip(rows, found):
        importance = math.fsum(log_ratio[b] for b in f)
        uniform = (((numbers[i, t] % (1 << 64)) >> 11) + 0.5) / (1 << 53)
        want.append((i, len(f), importance, importance - math.log(-math.log(uniform))))
    last = sorted((w[3] for w in want), reverse=True)[round(0.5 * len(rows)) - 1]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted((tuple(r) for r in resample.resample(df, good, 0.5).collect()), key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:2] == w[:2] and g[2:4] == pytest.approx(w[2:4]) and g[4] == (w[3] >= last), (g, w)


def test_license_blocks(spark):
    mit = licenses.TEMPLATES["MIT"][2]
    rows = [
        (0, "prose\nReleased under the MIT License.\nmore"),
        (1, "This work is licensed under the GNU General Public License, version 2."),
        (2, "This work is licensed under the GNU General Public License, version 3.\nand Licensed under CC BY-NC 4.0."),
        (3, "x\n" + "\n".join(mit[i : i + 60] for i in range(0, len(mit), 60)).replace("\n", "\n") + "\ny"),
        (4, "the license of my car is a license"),
        (5, None),
        (6, ""),
        (7, ("word " * 200 + ". ") + "Licensed under the Apache License, Version 2.0. " + "word " * 100),
        (8, "Licensed under the Apache License, Version 1.1."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert [got[i].licenses for i in (0, 1, 4, 5, 6, 7, 8)] == ["MIT", "GPL-2.0", "", "", "", "Apache-2.0", ""]
    assert "GPL-3.0" in got[2].licenses and got[5].n_blocks == got[6].n_blocks == 0 < got[4].n_blocks
    span = next(s for s in got[0].spans if s.license)
    assert rows[0][1][span.start : span.end] == "Released under the MIT License." and span.reduction > 0.2
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_license_notices_as_they_are_written(spark):
    grant, apache, gpl = licenses.TEMPLATES["MIT"][2], licenses.TEMPLATES["Apache-2.0"][1], licenses.TEMPLATES["GPL-3.0"][1]
    wrapped = lambda t, head="", mark="": "\n".join(mark + x for x in (head + "\n\n" + textwrap.fill(t, 72)).split("\n"))
    first, *_ = bsd = re.split(r" (?=Redistributions|Neither)", licenses.TEMPLATES["BSD-3-Clause"][1])
    listed = "\n\n".join([textwrap.fill(first, 72)] + [f"{i}. {textwrap.fill(c, 72)}" for i, c in enumerate(bsd[1:], 1)])
    owner = "Copyright (c) 2020, 2021 X Y"
    cases = [
        (wrapped(grant, "MIT License\n\n" + owner), "MIT"),
        (wrapped(grant, "MIT License\n\n" + owner, " * "), "MIT"),
        (wrapped(apache, "Copyright 2020 X", "# ").replace("http:", "https:"), "Apache-2.0"),
        (wrapped(gpl, "foo - a tool\n" + owner), "GPL-3.0"),
        (wrapped(gpl.replace("version 3", "version 2"), owner), "GPL-2.0"),
        (wrapped(gpl.replace("General", "Lesser General"), owner), "LGPL-3.0"),
        (wrapped(gpl.replace("version 3", "version 4"), owner), ""),
        (owner + "\n\n" + listed, "BSD-3-Clause"),
        (owner + "\n\n" + listed.split("\n\n3.")[0], "BSD-2-Clause"),
        (wrapped(licenses.TEMPLATES["BSD-3-Clause"][0], owner), "BSD-3-Clause"),
        ("By Foo. Licensed under CC BY 4.0.", "CC-BY-4.0"),
        ("By Foo. " + "word " * 90 + "Licensed under CC BY 4.0. More by Bar.", "CC-BY-4.0"),
        ("This work is licensed under the GNU General Public License, version 3.\nand Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0,GPL-3.0"),
        ("x\n" + "\n".join(grant[i : i + 60] for i in range(0, len(grant), 60)) + "\ny", "MIT"),
        (wrapped(grant, owner).replace("permission\n", "permis-\nsion\n"), "MIT"),
        ("// SPDX-License-Identifier: MIT", "MIT"),
        ("SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0 OR isc) AND none-such", "GPL-2.0,ISC"),
        ("Some prose. All rights\nreserved.", "LicenseRef-All-Rights-Reserved"),
        ("Rights: CC BY 4.0", "CC-BY-4.0"),
        ("Licensed under CC BY 4.0.\n" * 300, "CC-BY-4.0"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    for i, (text, want) in enumerate(cases):
        assert got[i].licenses == want, (text, got[i].licenses)
        assert got[i].n_confirmed == sum(s.license is not None for s in got[i].spans) and got[i].n_blocks == len(got[i].spans) > 0
    span = next(s for s in got[0].spans if s.license)
    assert cases[0][0][span.start : span.end].split() == grant.split() and not span.differences
    assert next(s for s in got[2].spans if s.license).differences == ["-http", "+https"] and got[len(cases) - 1].n_confirmed == 300


def least_cost(wanted, words):
    """Words to leave out of or put into the template, by hand; no number and no telling word."""
    fixed = lambda w: any(c.isdigit() for c in w) or w in ("lesser", "affero")
    row = [0.0]
    for w in words:
        row.append(row[-1] + (math.inf if fixed(w) else 1))
    for e in wanted:
        gone, last = (math.inf if fixed(e) else 1), row
        row = [last[0] + gone]
        for j, w in enumerate(words):
            row.append(min(last[j + 1] + gone, row[-1] + (math.inf if fixed(w) else 1), last[j] if e == w else math.inf))
    return row


def notices_by_hand(text):
    """All templates against all spans; of those that overlap, the one that its template shrinks by most bytes."""
    found = [(m.start(), m.end(), m.group().lower()) for m in licenses.WORD.finditer(text)]
    small, ranked, k = zstandard.ZstdCompressor(level=3), [], 0
    for name, notices in licenses.TEMPLATES.items():
        for notice in notices:
            wanted, spans, taken = licenses.plain_words(notice), [], set()
            most = int(licenses.MOST_DIFFERENT * len(wanted))
            for a in range(len(found)):
                costs = least_cost(wanted, [w for _, _, w in found[a : a + len(wanted) + most]])
                spans += [(c, a + n, -a) for n, c in enumerate(costs) if n and c <= most]
            given = zstandard.ZstdCompressionDict(notice.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            with_notice = zstandard.ZstdCompressor(level=3, dict_data=given)
            for c, b, a in sorted(spans):
                if not taken & set(range(-a, b)):
                    taken |= set(range(-a, b))
                    raw = " ".join(text[found[-a][0] : re.compile(r"[^\w\s]*").match(text, found[b - 1][1]).end()].lower().split()).encode()
                    ranked.append((len(with_notice.compress(raw)) - len(small.compress(raw)), c, k, -a, b, name))
            k += 1
    out, taken = [], set()
    for _, c, _, a, b, name in sorted(ranked):
        if not taken & set(range(a, b)):
            taken |= set(range(a, b))
            out.append((found[a][0], name, c))
    return sorted(out)


def changed_notices(rng):
    """One to three notices with up to three words changed, wrapped somehow, in prose with words of licences."""
    notices, parts = [t for ts in licenses.TEMPLATES.values() for t in ts if len(t) < 400], []
    for _ in range(rng.randint(1, 3)):
        own = rng.choice(notices).split()
        for _ in range(rng.randint(0, 3)):
            at, how = rng.randrange(len(own)), rng.randrange(3)
            own[at : at + 1] = [[own[at], "kind"], ["your"], [] if len(own) > 1 else ["x"]][how]
        width = rng.choice([5, 9, 1000])
        parts.append(rng.choice([" ", "\n"]).join(" ".join(own[i : i + width]) for i in range(0, len(own), width)))
        parts.append(" ".join(rng.choices(["some", "prose", "the license", "Copyright 2020 X", "software."], k=rng.randint(0, 8))))
    return rng.choice([" ", "\n", ". "]).join([*parts, "This is the license"])


def test_ranked_templates_lose_no_notice():
    rng, scanner, every = random.Random(21), licenses.Scanner(), licenses.Scanner(kept=1 << 20)
    texts = [changed_notices(rng) for _ in range(400)]
    assert [scanner.scan(t) for t in texts] == [every.scan(t) for t in texts]
    for t in [t for t in texts if len(t) < 600][:25]:
        got = [(f.start, f.name, len(f.differences)) for f in scanner.scan(t) if f.name]
        assert got == notices_by_hand(t), t
    ranks = scanner.first("Licensed under the Apache License, Version 2.0.")
    assert licenses.FIRST <= len(ranks) < len(scanner.templates) and "Apache-2.0" in {scanner.templates[k][0] for k in ranks}


def test_very_long_texts_and_clashing_names(spark):
    long = "prose about a license, " * 60_000 + "Licensed under CC BY 4.0. " + "and more " * 100_000
    rows = [(1, long, "x", 3), (2, None, "y", 4), (2, None, "y", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, licenses string, n_blocks int")
    got = sorted((r.doc_id, r.licenses, r.n_confirmed) for r in licenses.scan_licenses(df).collect())
    assert got == [(1, "CC-BY-4.0", 1), (2, "", 0), (2, "", 0)]


def test_special_tokens_in_a_text_get_their_ids_in_token_files(spark, tmp_path):
    with open(public_tokenizers.path(queries.BPE_JSON), encoding="utf-8") as f:
        description = f.read()
    plain = Tokenizer.from_str(description)
    assert plain.encode("<|endoftext|> x", add_special_tokens=False).ids == [50256, 2124]
    rng = random.Random(7)
    parts = ["<|endoftext|>", "<|endoftext|", " ", "\n", "  ", "Wort", "é.", "don't", "12", "|>"]
    texts = [t or "" for t in odd_texts()] + ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(500)]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in bytebpe.Encoder(description, specials=True).encode_batch(texts)] == want
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op9_token_files(spark, str(tmp_path)).collect()}
    start = 0
    for i, ids in enumerate(want):
        ids = [*ids, tokenfile.END_ID]
        assert (got[i].start, got[i].n_tokens) == (start, len(ids))
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_added_tokens_that_are_not_special():
    with open(public_tokenizers.path(queries.BPE_JSON), encoding="utf-8") as f:
        description = f.read()
    for strip in (False, True):
        tokenizer = Tokenizer.from_str(description)
        tokenizer.add_tokens([AddedToken("two words", lstrip=strip, normalized=False), AddedToken("two", normalized=False)])
        text = "a two words <|endoftext|>two\ntwo  word"
        for specials in (False, True):
            own = bytebpe.Encoder(tokenizer.to_str(), specials)
            tokenizer.encode_special_tokens = not specials
            assert own.encode_batch([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
            assert own.cuts != strip


def test_buckets_of_three_with_one_leader_are_met(spark):
    names, runs = [b"a" * 16, b"b" * 16, b"c" * 16], np.arange(1, 41, dtype=np.uint64)
    kind = "entity binary, first struct<no_id:boolean,doc:long,text_hash:long>, n_words long, bands array<long>, sketch binary, label binary"

    def entities(lowest):
        rows = [(e, (False, i, 0), 44, [7, 100 + i], b"s" * 125, e) for i, e in enumerate(names)]
        return spark.createDataFrame([(e, (n, -1 if e == lowest else d, h), *rest) for e, (n, d, h), *rest in rows], kind)

    [leader] = {bytes(r.other) for r in probminhash.bucket_leaders(entities(names[0])).collect()}
    held = [(e, (runs + np.uint64(1000) if e == leader else runs).tobytes(), b"") for e in names]
    content = spark.createDataFrame(held, "entity binary, runs binary, weights binary")
    for lowest in names:
        df = entities(lowest)
        got = probminhash.unmet_pairs(df.drop("first"), probminhash.bucket_leaders(df), content, 0.8).collect()
        want = [e for e in names if e != leader] if lowest == leader else None
        assert [(bytes(r.a), bytes(r.b)) for r in got] == ([tuple(want)] if want else [])


def test_thresholds_come_from_rows_that_were_not_fitted(spark, monkeypatch):
    df = spark.createDataFrame(toxic_rows(300, 3), "doc_id long, text string, lang string, toxic int")
    seen, fit, calibrate = {}, toxicity.fit, toxicity.calibrate
    monkeypatch.setattr(toxicity, "fit", lambda texts, y, shape: (seen.update(fitted=texts), fit(texts, y, shape))[1])
    monkeypatch.setattr(toxicity, "calibrate", lambda m, texts, y, x: (seen.update(held=texts), calibrate(m, texts, y, x))[1])
    toxicity.train(df.select("doc_id", "text", "lang"), df.select("doc_id", "toxic"), 1000)
    assert len(seen["held"]) == 60 and len(seen["fitted"]) == 240 and not set(seen["held"]) & set(seen["fitted"])


def test_every_labelled_row_trains_or_calibrates(spark, monkeypatch):
    df = spark.createDataFrame(toxic_rows(900, 4), "doc_id long, text string, lang string, toxic int")
    docs, labels = df.select("doc_id", "text", "lang"), df.select("doc_id", "toxic")
    learned, held, train_round, calibrate = [], [], toxicity.train_round, toxicity.calibrate_on_all

    def recorded(model, rows, *more):
        learned.extend(r.l_id for r in rows.select("l_id").collect())
        train_round(model, rows, *more)

    def recorded_held(model, rows):
        held.extend(r.l_id for r in rows.select("l_id").collect())
        return calibrate(model, rows)

    monkeypatch.setattr(toxicity, "train_round", recorded)
    monkeypatch.setattr(toxicity, "calibrate_on_all", recorded_held)
    monkeypatch.setattr(toxicity, "ROWS_PER_SHARE", 150)
    model = toxicity.train(docs.union(docs.limit(9)), labels, 300)
    assert sorted(learned + held) == list(range(900)) and 120 < len(held) < 240
    assert set(model.thresholds) == {"xx", "yy"} and not model.squares
    fresh = toxic_rows(300, 5)
    scored = toxicity.score_documents(spark.createDataFrame(fresh, df.schema), model, ["doc_id", "toxic"]).collect()
    assert sum((r.score >= 0.7) != bool(r.toxic) for r in scored) <= 15
    # files and partitions make no difference
    again = toxicity.train(docs.union(docs.limit(9)).repartition(7), labels.repartition(3), 300)
    assert again.thresholds == model.thresholds and np.array_equal(again.table, model.table)


def test_words_of_rows_beyond_the_first_are_learned(spark):
    rows = toxic_rows(800, 6)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.train(df.select("doc_id", "text", "lang"), df.select("doc_id", "toxic"), 4)
    scored = toxicity.score_documents(df, model, ["doc_id", "toxic"]).collect()
    assert sum((r.score >= 0.7) != bool(r.toxic) for r in scored) <= 80


def test_thresholds_by_counts_are_those_by_scores(spark):
    rows = toxic_rows(400, 7)
    model = toxicity.fit([r[1] for r in rows[:200]], np.array([r[3] for r in rows[:200]], np.float32))
    held = rows[200:]
    df = spark.createDataFrame(held, "doc_id long, text string, lang string, toxic int")
    by_scores = toxicity.calibrate(model, [r[1] for r in held], np.array([r[3] for r in held]), [r[2] for r in held])
    by_counts = toxicity.calibrate_on_all(model, df)
    scores = {r.doc_id: r.score for r in toxicity.score_documents(df, model, ["doc_id"]).collect()}
    for lang in ("xx", "yy"):
        wrong = [sum((scores[i] >= t[lang]) != bool(y) for i, _, x, y in held if x == lang) for t in (by_scores, by_counts)]
        assert wrong[1] <= wrong[0] + 1


def test_ids_are_counted_while_they_are_encoded(spark):
    with open(public_tokenizers.path(queries.BPE_JSON), encoding="utf-8") as f:
        description = f.read()
    rows = [(i, t) for i, t in enumerate(odd_texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = tokenfile.encoded(df, description, "doc_id", "text").cache()
    assert found.where("counts is null").count() == len(rows) and 1 <= found.where("counts is not null").count() <= 3
    ids = [i for r in found.where("counts is null").collect() for i in np.frombuffer(r.ids, "<u2").tolist()]
    assert {r.id: r.n for r in tokenfile.frequencies(found).collect()} == Counter(ids)
    assert tokenfile.encoded(df.limit(0), description, "doc_id", "text").count() == 0


def test_a_worker_gives_back_what_building_its_encoder_took(monkeypatch, multi):
    given = []
    monkeypatch.setattr(bytebpe, "give_back", lambda: given.append(True))
    monkeypatch.setattr(bytebpe, "_encoders", {})
    own = bytebpe.encoder(multi)
    assert given == [True] and bytebpe.encoder(multi) is own and given == [True]
    assert bytebpe.KEPT_PIECES <= 400_000
