"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Words and their shapes (capitals, digits, marks around them), alone and in pairs, are counted in hashed buckets:
once over all documents, once over the target, the documents labelled good. The target's documents are raw
documents too and stay in the raw model. The log-ratio of the two models, summed over a document's n-grams, is its
log-importance: the likelihood ratio of the text. A Gumbel number from the hash of id and text is added, and the
documents with the greatest sums are the sample: a draw without replacement in proportion to importance.
The ratio of a long text is far from 1, so length has its weight; `length` scales the sum to so many n-grams
instead, and the draw is then no longer in proportion to the ratio of the whole texts.

Defined cases: null and empty texts have no n-grams and log-importance 0; a very long text is one Python string while
it is counted; rows that tie with the last of the sample are all in it; rows that repeat id and text get the same
number; no good labels make the models equal; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualframe.llm.scratch import small, store
from qualframe.llm.words import EDGES, mix, text_batches

BUCKETS = 1 << 16  # a power of two
KEPT_WORDS = 500_000
FINE = 1 << 24  # steps a unit in the order of the sums


class WordsAndShapes(dict):
    """Index of a word; `fresh` has the hashes of letters and shape of the words that came last."""

    def __init__(self):
        super().__init__()
        self.fresh: list[tuple[int, int]] = []

    def __missing__(self, word: str) -> int:
        core = word.strip(EDGES)
        shape = "".join("X" if c.isupper() else "9" if c.isdigit() else "x" if c.isalpha() else c for c in (core[:1], core[-1:]))
        marks = word.replace(core, "~", 1) if core else word
        self.fresh.append((xxhash.xxh3_64_intdigest(core.lower()), xxhash.xxh3_64_intdigest(f"{shape} {marks}")))
        index = self[word] = len(self)
        return index


class Features:
    def __init__(self):
        self.words, self.hashes = WordsAndShapes(), np.zeros((2, 1 << 12), np.uint64)

    def of(self, text: str) -> np.ndarray:
        """Buckets of all n-grams of a text."""
        if len(self.words) > KEPT_WORDS:
            self.__init__()
        words = text.split()
        index = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        self._take_in()
        word, shape = self.hashes[0][index], self.hashes[1][index]
        pairs = mix(word[:-1] * np.uint64(3) + word[1:])
        pairs[word[:-1] == word[1:]] = np.uint64(1)  # the same word twice is one n-gram, whatever the word
        shapes = mix(shape[:-1] * np.uint64(5) + shape[1:] + np.uint64(7))
        return (np.concatenate([word, shape, pairs, shapes]) & np.uint64(BUCKETS - 1)).view(np.int64)

    def _take_in(self) -> None:
        """Hashes of fresh words go behind those known; the table doubles when it is full."""
        fresh, n = self.words.fresh, len(self.words)
        if fresh:
            if n > self.hashes.shape[1]:
                self.hashes = np.concatenate([self.hashes, np.zeros((2, n), np.uint64)], axis=1)
            self.hashes[:, n - len(fresh) : n] = np.array(fresh, np.uint64).T
            fresh.clear()


def counts(docs: DataFrame, target: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """n-grams in each bucket over all documents, and over those with `target` true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            good = batch.column(1).to_pylist()
            for start, texts in text_batches(batch.column(0)):
                found = [features.of(t) for t in texts]
                chosen = [f for i, f in enumerate(found, start) if good[i]]
                for row, parts in enumerate((found, chosen)):
                    if parts:
                        total[row] += np.bincount(np.concatenate(parts), minlength=BUCKETS)
        seen = np.flatnonzero(total[0])
        columns = [pa.array(seen), pa.array(total[0][seen]), pa.array(total[1][seen])]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "n_raw", "n_target"])

    parts = docs.select(F.col(text).cast("string"), target).mapInArrow(run, "bucket long, n_raw long, n_target long")
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in parts.groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target")).collect():
        raw[r.bucket], good[r.bucket] = r.n_raw, r.n_target  # one row a bucket
    return raw, good


def log_ratios(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """log of target model over raw model by bucket; the raw counts, scaled to one a bucket, smooth the target."""
    if not good.sum():
        return np.zeros(len(raw))
    q = (raw + 1) / (raw + 1).sum()
    return np.log((good + len(raw) * q) / (good.sum() + len(raw))) - np.log(q)


def resample(
    docs: DataFrame,
    good: DataFrame,
    share: float = 0.8,
    id_col: str = "doc_id",
    text: str = "text",
    seed: int = 1,
    length: int | None = None,
) -> DataFrame:
    """(id, n_ngrams, log_importance, gumbel_sum, kept): kept marks the sample, `share` of all rows.

    good: (id) of the documents that stand for the target. length: n-grams to scale log_importance to, none by default.
    """
    wanted = small(store(good.select(F.col(id_col).alias("g_id")).distinct().withColumn("good", F.lit(True)), "good"))
    marked = docs.select(F.col(id_col).alias("id"), F.col(text).alias("body")).join(wanted, F.col("id") == F.col("g_id"), "left")
    marked = marked.select("body", F.coalesce("good", F.lit(False)).alias("good"))
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(*counts(marked, "good", "body")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, ratio = Features(), ratios.value
        for batch in batches:
            for start, texts in text_batches(batch.column(2)):
                found = [features.of(t) for t in texts]
                scores = [float(ratio[f].sum()) * (length / len(f) if length and len(f) else 1.0) for f in found]
                kept = [batch.column(i).slice(start, len(texts)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array([len(f) for f in found], pa.int64()), pa.array(scores, pa.float64())],
                    ["doc", "h", "n_ngrams", "log_importance"],
                )

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    chosen = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.lit(seed), F.col(id_col), body).alias("h"), body.alias("body"))
    kind = dict(chosen.dtypes)["doc"]
    scored = chosen.mapInArrow(run, f"doc {kind}, h long, n_ngrams long, log_importance double")
    uniform = (F.shiftrightunsigned("h", 11) + 0.5) / float(1 << 53)
    scored = store(scored.withColumn("gumbel_sum", F.col("log_importance") - F.log(-F.log(uniform))).drop("h"), "scored")
    rank = F.floor(F.col("gumbel_sum") * FINE)
    least = kth_largest(scored.select(rank.alias("v")), round(share * scored.count()))
    return scored.select(
        F.col("doc").alias(id_col), "n_ngrams", "log_importance", "gumbel_sum", (rank >= least).alias("kept")
    )


def kth_largest(values: DataFrame, k: int, bins: int = 4096) -> int:
    """Exact k-th largest of a column v of whole numbers: counts in ever finer bins, a few thousand rows at a time."""
    if k <= 0:
        return (1 << 63) - 1
    low, high = values.agg(F.min("v"), F.max("v")).first()
    while low < high:
        width = -(-(high - low + 1) // bins)
        place = F.floor((F.col("v") - low) / width)
        inside = values.filter((F.col("v") >= low) & (F.col("v") <= high))
        found = inside.groupBy(place.alias("bin")).count().orderBy(F.desc("bin")).collect()
        for r in found:
            if k <= r["count"]:
                low, high = low + r.bin * width, min(high, low + (r.bin + 1) * width - 1)
                break
            k -= r["count"]
    return low
