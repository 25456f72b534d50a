"""The Merkle manifest, spelling variants and tiled vectors against plain Python on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from qualframe.llm import merkle, pcatiles, queries, spelling


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def levels(nodes, width):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + width]) for i in range(0, len(out[-1]), width)])
    return out


def siblings(tree, rank, width):
    out = []
    for level in tree[:-1]:
        run = level[rank // width * width : rank // width * width + width]
        out.append((rank % width, run[: rank % width] + run[rank % width + 1 :]))
        rank //= width
    return out


def by_hand(rows, width=2):
    """rows: (doc_id, source, lang, n_chars, text) -> (doc_id, leaf, subroot, root, proof, folded, verified)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, H(*map(field, r)), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], width) for g in names}
    top = levels([trees[g][-1][0] for g in names], width)
    out = []
    for k, g in enumerate(names):
        for rank, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = siblings(trees[g], rank, width) + siblings(top, k, width)
            start = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                start = H(*map(field, (*r[:3], r[3] + 1, r[4])))
            for digit, others in path:
                start = H(*others[:digit], start, *others[digit:])
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], H(*(x for _, o in path for x in o)), start, start == top[-1][0]))
    return out


def manifest_rows():
    rng = random.Random(8)
    rows = [(i, "s", rng.choice(["en", "de", "é"]), i % 9, f"text {i}\n") for i in range(150)]
    rows += [(500, None, None, None, None), (None, "s", None, 3, ""), (7, "x", "one", 0, "é" * 20_000)]
    rows += [(9, "copy", "en", 4, "same")] * 40  # equal subtrees
    return rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_manifest_query(spark, folder):
    rows = manifest_rows()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{folder}/documents.parquet")
    assert as_rows(queries.op11_merkle_manifest(spark, folder)) == sorted(by_hand(rows), key=repr)


def test_manifest_of_one_row_and_none(spark, folder):
    df = spark.createDataFrame([(3, "s", "en", 1, "a")], SCHEMA)
    df.write.parquet(f"{folder}/one/documents.parquet")
    df.limit(0).write.parquet(f"{folder}/none/documents.parquet")
    assert as_rows(queries.op11_merkle_manifest(spark, f"{folder}/one")) == by_hand([(3, "s", "en", 1, "a")])
    assert queries.op11_merkle_manifest(spark, f"{folder}/none").collect() == []


def test_packs_of_several_rounds_and_widths(spark):
    """Small packs, so that the descent takes several steps; only the wanted rows are proved."""
    n, width = 100, 3
    df = spark.range(n).select("id", F.lit("a").alias("lang"), merkle.leaf_digest(F.col("id")).alias("leaf"), F.lit(1).alias("digest"))
    made = merkle.build_manifest(df.drop("digest"), "lang", ["id"], "leaf", width, 2)
    assert len(made.trees.rounds) == 3
    tree = levels([H(field(i)) for i in range(n)], width)
    assert [r.root for r in merkle.root_of(made).collect()] == [levels(tree[-1], width)[-1][0]]
    wanted = made.leaves.where("row.id % 7 = 0 OR row.id = 99")
    got = {r["rank"]: r for r in merkle.prove(made, wanted.union(wanted)).collect()}
    assert sorted(got) == [i for i in range(n) if i % 7 == 0 or i == 99]
    for rank, r in got.items():
        assert r.leaf == tree[0][rank]
        assert [(s.digit, s.others) for s in r.proof] == [(d, "".join(o)) for d, o in siblings(tree, rank, width)]


def test_names_of_columns_cannot_clash(spark):
    df = spark.range(9).selectExpr("id", "id AS rank", "'x' AS g", "sha2(cast(id AS string), 256) AS n", "1 AS part", "2 AS row", "3 AS leaf")
    made = merkle.build_manifest(df, "g", ["rank"], "n")
    assert {(r["row"]["id"], r["rank"], r["leaf"]) for r in made.leaves.collect()} == {
        (i, i, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(9)
    }
    assert merkle.prove(made, made.leaves).count() == 9


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def forms_by_hand(counts, least=5, ratio=5):
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}
    out = {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] < ratio * n:
            best = None
        out[w] = [w, n, len(near), best, words.get(best)]
    for w, row in out.items():
        root = w
        while out[root][3] is not None:
            root = out[root][3]
        row.append(root)
    return sorted(tuple(r) for r in out.values())


def variants(seed, n, alphabet="abé"):
    rng = random.Random(seed)
    words = {}
    while len(words) < n:
        w = [rng.choice(alphabet) for _ in range(rng.randrange(6, 10))]
        words["".join(w)] = rng.choice([5, 6, 20, 30, 150, 4000])
    return words


@pytest.mark.parametrize("alphabet", ["ab", "abé", "abcdefÿ"])
def test_lists_find_every_near_pair(alphabet):
    words = sorted(variants(len(alphabet), 150, alphabet))
    some, others = words[::2], words[1::2]
    for queries_ in (words, others):
        table = words if queries_ is words else some
        i, j = spelling.near_in_list(table, queries_)
        got = sorted((table[a], queries_[b]) for a, b in zip(i, j))
        assert got == sorted((a, b) for a in table for b in queries_ if one_edit(a, b) and a[:3] == b[:3])


def test_spelling_forms(spark, monkeypatch):
    words = variants(5, 400) | {"é" * 3000: 9, "é" * 2999: 900, "é" * 2998: 20000, "alphabet": 5000, "alphabt": 200, "alphab": 5, "lphabet": 1000}
    df = spark.createDataFrame(list(words.items()), "word string, n long").withColumn("n_near", F.lit("x"))
    want = forms_by_hand(words)
    assert as_rows(spelling.spelling_forms(df)) == sorted(want, key=repr)
    monkeypatch.setattr(spelling, "TILE", 16)  # many tiles with one start
    assert as_rows(spelling.spelling_forms(df)) == sorted(want, key=repr)
    assert spelling.spelling_forms(df.limit(0)).collect() == []


def test_variants_query(spark, folder):
    rng = random.Random(4)
    vocabulary = list(variants(6, 60)) + ["HOUSEHOLD", "Household", "Àbcdefg", "àbcdefg", "abc×def", "x1housing"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(400))), "x") for i in range(60)]
    rows += [(None, "Household 中householdĀ household-household", "x"), (5, None, "x"), (5, "", "x")] * 3
    rows += [(77, "longest " * 200_000, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, word string").write.parquet(f"{folder}/documents.parquet")
    counts = Counter()
    import re

    for doc, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            counts[low if h % 199 else low[: h % len(low)] + low[h % len(low) + 1 :]] += 1
    assert as_rows(queries.op12_spelling_variants(spark, folder)) == sorted(forms_by_hand(counts), key=repr)


def test_pieces_end_between_words():
    text = "abc déf " * 50 + "x" * 300 + " end"
    assert "".join(spelling.pieces(text, 64)) == text
    assert [w for p in spelling.pieces(text, 64) for w in spelling.runs(p)] == spelling.runs(text)


def links_by_hand(rows, least=0.9):
    def sound(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        if not (sound(a) and sound(b)) or len(a) != len(b):
            return -1
        if max(map(abs, a + b)) > 1e100 or max(map(abs, a)) < 1e-100 or max(map(abs, b)) < 1e-100:
            a, b = ([x / max(map(abs, v)) for x in v] for v in (a, b))
        return math.fsum(x * y for x, y in zip(a, b)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(y * y for y in b))

    n = len(rows)
    links = [[j for j in range(n) if j != i and cosine(rows[i][1], rows[j][1]) >= least] for i in range(n)]
    out = []
    for i in range(n):
        seen, stack = {i}, [i]
        while stack:
            for j in links[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        names = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(links[i]), min(names, default=None)))
    return sorted(out, key=repr)


def vectors():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(12, 8))
    rows = [(i, (base[i % 12] + rng.normal(size=8) * rng.choice([0, 0.1, 0.45, 0.6])).tolist()) for i in range(140)]
    rows += [(300 + k, [0.0] * 8) for k in range(2)] + [(400, None), (401, []), (402, [1.0, None] * 4), (403, [float("nan")] * 8)]
    rows += [(404, [float("inf"), 1.0]), (405, [1.0, 0.0]), (406, [0.9, math.sqrt(0.19)]), (None, base[0].tolist()), (None, [0.0, -5.0])]
    rows += [(2, base[2].tolist())] * 30 + [(500, (base[2] * 1e300).tolist()), (501, (base[3] * 1e-300).tolist()), (502, [-0.0, 1.0]), (503, [0.0, 1.0])]
    return rows


def test_near_vectors(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, n_links int, c string")
    want = links_by_hand(rows)
    assert as_rows(pcatiles.near_vectors(df)) == want
    monkeypatch.setattr(pcatiles, "TILE", 7)
    monkeypatch.setattr(pcatiles, "BLOCK_BYTES", 1)  # 64 rows a block
    assert as_rows(pcatiles.near_vectors(df.repartition(3))) == want
    assert pcatiles.near_vectors(df.limit(0)).collect() == []


def test_stages_lose_no_pair():
    rng = np.random.default_rng(2)
    x = pcatiles.unit(np.repeat(rng.normal(size=(20, 16)), 10, axis=0) + rng.normal(size=(200, 16)) * 0.25)
    y = pcatiles.unit(rng.normal(size=(90, 16)))
    for other in (x, y):
        for stages in ([4, 9, 16], [16], [1, 2, 3, 16]):
            i, j, dots = pcatiles.close_pairs(x, other, stages, 0.8)
            whole = x @ other.T
            assert set(zip(i.tolist(), j.tolist())) == set(zip(*(k.tolist() for k in np.nonzero(whole >= 0.8))))
            assert np.allclose(dots, whole[i, j])


def test_far_blocks_do_not_meet(spark):
    low = [f"{v} AS {n}{i}" for i in range(1, 4) for n, v in (("low", -0.1), ("high", 0.1))]
    boxes = spark.range(4).selectExpr("1 AS dim", "id AS block", "id / 2 - 1 AS low0", "id / 2 - 0.9 AS high0", *low)
    got = {(r.a, r.b) for r in pcatiles.block_pairs(boxes, 0.9).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 3), (0, 1), (1, 2), (2, 3)}


def test_local_components():
    rng = random.Random(1)
    for _ in range(20):
        pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(rng.randrange(60))]
        label = np.arange(40)
        i, j = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        pcatiles.merge(label, i, j)
        want = list(range(40))
        for _ in range(40):
            for a, b in pairs:
                want[a] = want[b] = min(want[a], want[b])
        assert label.tolist() == want
