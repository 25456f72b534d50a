"""Near duplicates by ProbMinHash.

A text is a set of runs of five words, each weighted 1 + ln(count). Each run sends arrivals of a Poisson process
with its weight as rate to random registers; a register keeps the run that arrives first. A run stops once its
next arrival comes after the last register was filled, so most runs send one or two. Two texts agree in a
register with their probability Jaccard similarity as probability.

Texts with the same words in order are one entity from the start. Entities that agree in all registers of a band
meet in a bucket. In each bucket every entity is compared with two leaders, the one with the lowest document and
one by hash, which joins most of a bucket into one class with pairs linear in the rows. What is then left in more
than one class is met in full: the entities outside the bucket's largest class, in blocks of bounded size, against
all of the bucket: where a sketch of one byte a register allows it, the pair is compared in place, in the first
bucket that both share, and only pairs that are similar leave the task. So every pair that shares a bucket is in
one class already, or compared. Compared means: the exact probability Jaccard of the whole texts is at least `similarity`. Classes
are the connected components of the pairs that are.

Defined cases: texts without words are a class each; fewer than five words are one run; null ids come after
all others when the document that stays is chosen; rows that repeat an id and a text share one verdict, and
`drop_near_duplicates` keeps one of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualframe.llm.components import components
from qualframe.llm.scratch import small, store
from qualframe.llm.words import WordHashes, give_back, mix, run_hashes, text_batches, word_hashes

BANDS, ROWS = 25, 5  # at similarity 0.8 a pair meets in some bucket with probability 0.99995
RUN_WORDS, SIMILARITY = 5, 0.8
BLOCK, BLOCK_WORDS = 32, 1 << 15  # entities of a bucket that are compared at once, and words of them, on average
SPREAD = 5.0  # standard deviations below the expected agreement at which a sketch still passes (loss 3e-7)


def weighted_runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs, sorted, and their weights."""
    runs, counts = np.unique(run_hashes(words, RUN_WORDS), return_counts=True)
    return runs, 1 + np.log(counts)


def signatures(runs: list[np.ndarray], weights: list[np.ndarray], registers: int) -> np.ndarray:
    """uint64 [texts, registers]: the run that came first in each register; all texts have a run."""
    n = len(runs)
    owner = np.repeat(np.arange(n), [len(r) for r in runs])
    run, rate = np.concatenate(runs), np.concatenate(weights)
    first, kept = np.full(n * registers, np.inf), np.zeros(n * registers, np.uint64)
    time, last, turn = np.zeros(len(run)), np.full(n, np.inf), 0
    while len(run):
        turn += 1
        draw = mix(run + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64)))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53) / rate
        on = time <= last[owner]
        run, rate, time, owner, draw = run[on], rate[on], time[on], owner[on], draw[on]
        slot = owner * registers + (mix(draw ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        kept[slot[won]] = run[won]
        open_texts = owner[np.flatnonzero(np.diff(owner, prepend=-1))]
        last[open_texts] = first.reshape(n, registers)[open_texts].max(axis=1)
        on = time <= last[owner]
        run, rate, time, owner = run[on], rate[on], time[on], owner[on]
    return kept.reshape(n, registers)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """uint64 [texts, bands] of uint64 [texts, bands * rows]."""
    n = len(signature)
    parts = signature.reshape(n, -1, ROWS)
    out = np.zeros(parts.shape[:2], np.uint64)
    for k in range(ROWS):
        out = mix(out ^ (parts[:, :, k] + np.uint64(k + 1)))
    return out


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact, over all runs of both: sum over shared runs d of 1 / sum over e of max(a_e / a_d, b_e / b_d)."""
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    sa, sb = wa[ia], wb[ib]
    ratio = sb / sa
    order = np.argsort(ratio, kind="stable")
    sa, sb, ratio = sa[order], sb[order], ratio[order]
    # at ratio t, runs with b / a up to t weigh a, all others b / t; runs of one side only lie at either end
    low = (wa.sum() - sa.sum()) + np.cumsum(sa)
    high = wb.sum() - np.cumsum(sb)
    return float(np.sum(1.0 / ((low + high / ratio) / sa)))


def sign(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc, text_hash, entity, n_words, bands, sketch): entity is a 128-bit digest of the words, null without words.

    sketch: the low byte of each register.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for start, texts in text_batches(batch.column(2)):
                words = [word_hashes(t, known) for t in texts]
                entities = [hashlib.blake2b(w.tobytes(), digest_size=16).digest() if len(w) else None for w in words]
                fresh = {e: i for i, e in enumerate(entities) if e}  # copies in one batch are signed once
                keys, low = {}, {}
                if fresh:
                    runs, weights = zip(*[weighted_runs(words[i]) for i in fresh.values()])
                    signed = signatures(list(runs), list(weights), BANDS * ROWS)
                    keys = dict(zip(fresh, band_keys(signed).astype(np.int64)))
                    low = {e: x.tobytes() for e, x in zip(fresh, signed.astype(np.uint8))}
                bands = pa.array([keys[e] if e else None for e in entities], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(texts)),
                        batch.column(1).slice(start, len(texts)),
                        pa.array(entities, pa.binary()),
                        pa.array([len(w) for w in words], pa.int64()),
                        bands,
                        pa.array([low.get(e) for e in entities], pa.binary()),
                    ],
                    ["doc", "text_hash", "entity", "n_words", "bands", "sketch"],
                )
        known.clear()
        give_back()

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    chosen = docs.select(F.col(id_col).alias("doc"), F.xxhash64(body).alias("text_hash"), body.alias("body"))
    kind = dict(chosen.dtypes)["doc"]
    return chosen.mapInArrow(run, f"doc {kind}, text_hash long, entity binary, n_words long, bands array<long>, sketch binary")


def contents(docs: DataFrame, wanted: DataFrame, id_col: str, text: str) -> DataFrame:
    """(entity, runs, weights) of the documents (doc, text_hash, entity) in wanted, read from the texts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for start, texts in text_batches(batch.column(1)):
                both = [weighted_runs(word_hashes(t, known)) for t in texts]
                # all weights 1 need no bytes
                weights = [w.astype(np.float64).tobytes() if w.max(initial=1) > 1 else b"" for _, w in both]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(texts)),
                        pa.array([r.tobytes() for r, _ in both], pa.binary()),
                        pa.array(weights, pa.binary()),
                    ],
                    ["entity", "runs", "weights"],
                )
        known.clear()
        give_back()

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    chosen = docs.select(F.col(id_col).alias("d"), F.xxhash64(body).alias("h"), body.alias("body"))
    same = F.col("d").eqNullSafe(F.col("doc")) & (F.col("h") == F.col("text_hash"))
    chosen = chosen.join(small(wanted), same).select("entity", "body")
    return chosen.mapInArrow(run, "entity binary, runs binary, weights binary").dropDuplicates(["entity"])


def similar(pairs: DataFrame, content: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity is high enough, with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in zip(*[batch.column(i) for i in range(2, 6)]):
                ra, wa, rb, wb = (x.as_py() for x in row)
                a, b = np.frombuffer(ra, np.uint64), np.frombuffer(rb, np.uint64)
                weight = lambda w, r: np.frombuffer(w, np.float64) if w else np.ones(len(r))
                found.append(probability_jaccard(a, weight(wa, a), b, weight(wb, b)))
            keep = pa.array([s >= similarity - 1e-12 for s in found], pa.bool_())
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["a", "b", "similarity"]
            )
            yield out.filter(keep)

    side = lambda c: content.select(
        F.col("entity").alias(c), F.col("runs").alias(f"runs_{c}"), F.col("weights").alias(f"weights_{c}")
    )
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "runs_a", "weights_a", "runs_b", "weights_b")
    return both.mapInArrow(run, "a binary, b binary, similarity double")


def bucket_leaders(entities: DataFrame) -> DataFrame:
    """(l_band, l_bucket, low, other, n) of the buckets of two entities and more: the lowest, and one by hash."""
    in_buckets = entities.select("entity", "first", F.posexplode("bands").alias("l_band", "l_bucket"))
    by_hash = F.struct(F.xxhash64("entity", "l_band").alias("h"), "entity")
    leaders = in_buckets.groupBy("l_band", "l_bucket").agg(
        F.min(F.struct("first", "entity")).alias("low"), F.max(by_hash).alias("other"), F.count("*").alias("n")
    )
    return leaders.filter("n > 1").select("l_band", "l_bucket", "low", F.col("other.entity").alias("other"), "n")


IN_BUCKET = "band = l_band AND bucket = l_bucket"


def candidate_pairs(entities: DataFrame, leaders: DataFrame) -> DataFrame:
    """(a, b, low): each entity with the leaders of its buckets; `low` is the lowest leader of all its buckets."""
    in_buckets = entities.select("entity", F.posexplode("bands").alias("band", "bucket"))
    met = in_buckets.join(small(leaders), F.expr(IN_BUCKET))
    led = met.select(
        F.col("entity").alias("a"),
        F.explode(F.array(F.struct(F.col("low.entity").alias("b"), F.col("low").alias("low")), F.struct(F.col("other").alias("b"), F.lit(None).alias("low")))).alias("x"),
    ).select("a", "x.b", "x.low")
    return led.filter("a <> b").groupBy("a", "b").agg(F.min("low").alias("low"))


def least_agreement(similarity: float) -> int:
    """Registers in which a pair of at least that similarity agrees, but for SPREAD standard deviations."""
    n = BANDS * ROWS
    return max(1, int(n * similarity - SPREAD * (n * similarity * (1 - similarity)) ** 0.5))


def unmet_pairs(classed: DataFrame, leaders: DataFrame, content: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similarity): similar pairs of different classes that share a bucket and that no leader compared.

    classed: (entity, n_words, bands, sketch, label) of all entities that share a bucket. Buckets of two
    entities, of three with two leaders, and those of one class have nothing left. In the others, blocks of the entities outside the largest
    class meet the blocks of all; blocks are filled by hash, so a bucket of any size is many rows.
    """
    large = store(leaders.filter("n > 3 OR n = 3 AND low.entity = other").select("l_band", "l_bucket", F.col("low.entity").alias("low"), "other"), "large")
    members = classed.select("entity", "label", "n_words", F.posexplode("bands").alias("band", "bucket"))
    members = members.join(small(large), F.expr(IN_BUCKET)).filter("entity <> low AND entity <> other")
    sizes = members.groupBy("l_band", "l_bucket", "label").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))
    mixed = sizes.groupBy("l_band", "l_bucket").agg(
        F.max(F.struct("n", "label", "words")).alias("main"),
        F.sum("n").alias("n"),
        F.sum("words").alias("words"),
        F.count("*").alias("labels"),
    )
    parts = lambda n, words: F.ceil(F.greatest(n / BLOCK, words / BLOCK_WORDS))
    mixed = store(
        mixed.filter("labels > 1").select(
            F.col("l_band").alias("m_band"),
            F.col("l_bucket").alias("m_bucket"),
            F.col("main.label").alias("main"),
            parts(F.col("main.n"), F.col("main.words")).alias("main_parts"),
            parts(F.col("n") - F.col("main.n"), F.col("words") - F.col("main.words")).alias("rest_parts"),
        ),
        "mixed",
    )
    inside = members.join(small(mixed), F.expr("band = m_band AND bucket = m_bucket"))
    rest = F.col("label") != F.col("main")
    block = F.pmod(F.xxhash64("entity"), F.when(rest, F.col("rest_parts")).otherwise(F.col("main_parts")))
    inside = store(inside.select("entity", "band", "bucket", rest.alias("rest"), block.alias("block")), "inside")
    full = classed.join(content, "entity").select("entity", F.struct("entity", "label", "bands", "sketch", "runs", "weights").alias("x"))
    blocks = inside.join(full, "entity").groupBy("band", "bucket", "rest", "block").agg(F.collect_list("x").alias("held"))
    blocks = store(blocks, "blocks")
    enough = least_agreement(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(x: pa.StructArray):
            flat = lambda name, kind: np.frombuffer(b"".join(x.field(name).to_pylist()), kind).reshape(len(x), -1)
            bands = np.array(x.field("bands").to_pylist(), np.int64)
            return x.field("entity").to_pylist(), np.array(x.field("label").to_pylist(), object), bands, flat("sketch", np.uint8), x

        def content_of(x: pa.StructArray, i: int, known: dict) -> tuple[np.ndarray, np.ndarray]:
            if i not in known:
                runs, weights = np.frombuffer(x.field("runs")[i].as_py(), np.uint64), x.field("weights")[i].as_py()
                known[i] = runs, np.frombuffer(weights, np.float64) if weights else np.ones(len(runs))
            return known[i]

        for batch in batches:
            for i in range(batch.num_rows):
                band = batch.column(0)[i].as_py()
                (ea, la, ba, sa, xa), (eb, lb, bb, sb, xb) = (read(batch.column(c)[i].values) for c in (1, 2))
                close = (sa[:, None, :] == sb[None, :, :]).sum(axis=2) >= enough
                close &= la[:, None] != lb[None, :]
                # where an earlier band is shared too, the pair met there: among members, or one of them was the leader
                close &= ~(ba[:, None, :band] == bb[None, :, :band]).any(axis=2)
                pairs, left, right = [], {}, {}
                for j, k in zip(*np.nonzero(close)):
                    found = probability_jaccard(*content_of(xa, j, left), *content_of(xb, k, right))
                    if found >= similarity - 1e-12:
                        pairs.append((min(ea[j], eb[k]), max(ea[j], eb[k]), found))
                columns = list(zip(*pairs)) or [(), (), ()]
                kinds = (pa.binary(), pa.binary(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["a", "b", "similarity"])

    side = lambda c: blocks.select(
        "band", "bucket", F.col("rest").alias(f"rest_{c}"), F.col("block").alias(f"block_{c}"), F.col("held").alias(f"held_{c}")
    )
    met = side("a").filter("rest_a").join(side("b"), ["band", "bucket"])
    met = met.filter("NOT rest_b OR block_a <= block_b").select("band", "held_a", "held_b")
    return met.mapInArrow(run, "a binary, b binary, similarity double").dropDuplicates(["a", "b"])


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """(id, text_hash, class_id, kept): one row per document; class_id is the lowest id of its class."""
    signed = store(sign(docs, id_col, text), "signed")
    first = F.struct(F.col("doc").isNull().alias("no_id"), "doc", "text_hash")
    entities = signed.filter("entity is not null").groupBy("entity").agg(
        F.min(first).alias("first"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"), F.any_value("n_words").alias("n_words")
    )
    entities = store(entities, "entities")
    leaders = store(bucket_leaders(entities), "leaders")
    pairs = store(candidate_pairs(entities, leaders), "pairs")

    ends = pairs.select(F.col("a").alias("end")).union(pairs.select("b")).distinct()
    met = store(entities.join(ends, F.col("entity") == F.col("end")).drop("end"), "met")
    wanted = store(met.select("first.doc", "first.text_hash", "entity"), "wanted")
    content = store(contents(docs, wanted, id_col, text), "contents")

    to_first = pairs.filter("low is not null").groupBy("a").agg(F.min("low").alias("low"))
    edges = store(similar(to_first.select("a", F.col("low.entity").alias("b")), content, similarity), "similar")
    labels = components(edges)
    label = lambda c: labels.select(F.col("node").alias(f"n_{c}"), F.col("label").alias(f"l_{c}"))
    apart = (
        pairs.join(label("a"), F.col("a") == F.col("n_a"), "left")
        .join(label("b"), F.col("b") == F.col("n_b"), "left")
        .filter(F.coalesce("l_a", "a") != F.coalesce("l_b", "b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    edges = edges.union(store(similar(apart, content, similarity), "similar"))
    labels = components(edges)
    classed = met.join(labels, F.col("entity") == F.col("node"), "left").select(
        "entity", "n_words", "bands", "sketch", F.coalesce("label", "entity").alias("label")
    )
    late = store(unmet_pairs(store(classed, "classed"), leaders, content, similarity), "unmet")
    if late.head(1):
        labels = components(edges.union(late))

    classes = entities.join(labels, F.col("entity") == F.col("node"), "left").select(
        "entity", "first", F.coalesce("label", "entity").alias("class")
    )
    classes = store(classes, "classes")
    lowest = classes.groupBy(F.col("class").alias("c")).agg(F.min("first").alias("lowest"))
    of_entity = store(
        classes.join(lowest, F.col("class") == F.col("c")).select(F.col("entity").alias("e"), "lowest"), "members"
    )
    same = F.col("doc").eqNullSafe(F.col("lowest.doc")) & (F.col("text_hash") == F.col("lowest.text_hash"))
    out = signed.join(of_entity, F.col("entity") == F.col("e"), "left").select(
        F.col("doc").alias(id_col),
        "text_hash",
        F.when(F.col("e").isNull(), F.col("doc")).otherwise(F.col("lowest.doc")).alias("class_id"),
        F.coalesce(F.col("e").isNull() | same, F.lit(True)).alias("kept"),
    )
    return out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each class; all columns stay."""
    verdicts = near_duplicates(docs, id_col, text).groupBy(F.col(id_col).alias("v_id"), F.col("text_hash").alias("v_hash"))
    verdicts = store(verdicts.agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")), "verdicts")
    rows = docs.select(F.struct("*").alias("row"))
    body = F.coalesce(F.col(f"row.{text}").cast("string"), F.lit(""))
    same = F.col(f"row.{id_col}").eqNullSafe(F.col("v_id")) & (F.xxhash64(body) == F.col("v_hash"))
    kept = rows.join(small(verdicts.filter("not kept")), same, "left_anti")
    repeated = verdicts.filter("kept and n > 1")
    if repeated.head(1):
        once = kept.join(small(repeated), same, "left_semi").withColumn("h", F.xxhash64(body))
        once = once.withColumn("id", F.col(f"row.{id_col}")).dropDuplicates(["id", "h"]).select("row")
        kept = kept.join(small(repeated), same, "left_anti").union(once)
    return kept.select("row.*")
