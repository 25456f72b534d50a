"""Toxicity by a convolutional text classifier in numpy.

A word is the mean of hashed rows of one embedding table: the word itself and its first three and four letters,
each at two places, so that a shared row alone says little. Filters of one, two and three words run over the
whole text; each keeps its greatest response, and a logistic unit turns those into a score. Training follows
only the winning positions, so a step costs little more than the forward pass.

Every labelled row is read: four fifths by the fit, the last fifth, which the fit does not read, for a threshold
for each language; language is no input of a score. Up to `most_rows` rows the driver fits them. Beyond, the model
so begun, on rows chosen by the hash of their ids, is trained on in rounds: in each, tasks run once through their
share of the rows, and what they changed is averaged. Shares, rounds and orders follow the hash of the ids and the
number of labelled rows, not files or partitions. Scores are given to every row from its text alone.

Defined cases: a null or empty text scores as no response at all; without labels of both kinds every score is
the share of toxic labels, 0 without labels; a language too rare to calibrate has the common threshold;
repeated rows score alike; labels that contradict each other count as toxic.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualframe.llm.scratch import small, store
from qualframe.llm.words import EDGES, give_back, text_batches

WIDTHS = (1, 2, 3)
COMMON_THRESHOLD = 0.7
POOLED = 40_000  # words whose windows are in memory at once
KEPT_WORDS = 300_000  # embedded words per Python worker; a fuller memory starts anew
FOLDS = 5  # by hash of the id; the first is kept for the thresholds
ROUNDS = ((1, 2), (3, 4))  # folds of each round
ROWS_PER_SHARE = 2000  # in a round, as long as that makes no more than
MOST_SHARES = 64
CHUNK = 1 << 12  # table rows whose changes are averaged together
SCORE_BINS = 1000


@dataclass
class Shape:
    rows: int = 1 << 18  # of the embedding table
    size: int = 8  # of a word
    filters: int = 8  # of each width
    steps: int = 500
    batch: int = 48
    rate: float = 0.1
    seed: int = 7


@dataclass
class Model:
    shape: Shape
    table: np.ndarray
    kernels: list[np.ndarray]  # [width * size, filters]
    biases: list[np.ndarray]
    weight: np.ndarray
    bias: float
    prior: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    trained: bool = False
    squares: list[np.ndarray] = field(default_factory=list)  # of the gradients: table, dense(), while it is trained

    def dense(self) -> np.ndarray:
        """All parameters but the table."""
        return np.concatenate([*[k.ravel() for k in self.kernels], *self.biases, self.weight, [self.bias]]).astype(np.float32)

    def set_dense(self, flat: np.ndarray) -> None:
        parts, at = [*self.kernels, *self.biases, self.weight], 0
        for part in parts:
            part[...] = flat[at : at + part.size].reshape(part.shape)
            at += part.size
        self.bias = float(flat[at])


def features(word: str, rows: int) -> list[int]:
    plain = word.lower().strip(EDGES)
    seeds = [(plain, 0), (plain[:3] + "^", 1), (plain[:4] + "^", 2)]
    return [xxhash.xxh3_64_intdigest(w, seed=2 * s + k) % rows for w, s in seeds for k in (0, 1)]


class WordFeatures(dict):
    """Index of each word; `fresh` has the table rows of the words indexed since they were taken."""

    def __init__(self, rows: int):
        super().__init__()
        self.rows, self.fresh = rows, []

    def __missing__(self, word: str) -> int:
        index = self[word] = len(self)
        self.fresh.append(features(word, self.rows))
        return index

    def take(self) -> np.ndarray:
        """[words, 6] of the fresh words."""
        fresh, self.fresh = self.fresh, []
        return np.array(fresh, np.int32).reshape(-1, 6)

    def indices(self, text: str) -> np.ndarray:
        words = text.split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def new_model(shape: Shape) -> Model:
    draw = np.random.default_rng(shape.seed)
    normal = lambda *n, s: draw.normal(0, s, n).astype(np.float32)
    return Model(
        shape,
        normal(shape.rows, shape.size, s=0.1),
        [normal(w * shape.size, shape.filters, s=(2 / (w * shape.size)) ** 0.5) for w in WIDTHS],
        [np.zeros(shape.filters, np.float32) for _ in WIDTHS],
        normal(len(WIDTHS) * shape.filters, s=0.3),
        0.0,
    )


def forward(model: Model, vectors: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Greatest response [texts, filters of all widths], and the position of each. vectors: words of all texts in
    order, each text followed by two zero rows, so that no window reaches into the next."""
    starts = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]])
    last = np.repeat(starts + sizes - 1, sizes + 2)
    pooled, winners = [], []
    for width, kernel, bias in zip(WIDTHS, model.kernels, model.biases):
        n, size = len(vectors), model.shape.size
        out = np.tile(bias, (n, 1))
        for k in range(width):
            part = vectors[k:] @ kernel[k * size : (k + 1) * size]
            out[: n - k] += part
        out[np.arange(n) > last] = -1e9  # the two zero rows begin no window
        best = np.maximum.reduceat(out, starts, axis=0)
        pooled.append(np.maximum(best, 0))
        winners.append((out, best, starts))
    return np.concatenate(pooled, axis=1), winners


def laid_out(places: np.ndarray, table: np.ndarray, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, sizes, word index of each row, -1 for zero rows)."""
    gap = np.array([-1, -1])
    index = np.concatenate([x for t in texts for x in (t, gap)])
    embedded = np.concatenate([table[places].mean(axis=1), np.zeros((1, table.shape[1]), table.dtype)])
    return embedded[index], np.array([len(t) for t in texts]), index


class Descent:
    """Adagrad steps that follow the winning windows of each batch; `touched` marks the table rows they changed."""

    def __init__(self, model: Model):
        shape, self.model = model.shape, model
        self.seen = [model.table, *model.kernels, *model.biases, model.weight]
        self.squares, self.bias_square = [np.full_like(x, 1e-3) for x in self.seen], 1e-3
        self.touched = np.zeros(shape.rows, bool)
        if model.squares:
            self.squares[0], flat, at = model.squares[0], model.squares[1], 0
            for square in self.squares[1:]:
                square[...] = flat[at : at + square.size].reshape(square.shape)
                at += square.size
            self.bias_square = float(flat[at])

    def dense_squares(self) -> np.ndarray:
        return np.concatenate([*[x.ravel() for x in self.squares[1:]], [self.bias_square]]).astype(np.float32)

    def _descend(self, i: int, grad: np.ndarray, rows=slice(None)) -> None:
        self.squares[i][rows] += grad * grad
        self.seen[i][rows] -= self.model.shape.rate * grad / np.sqrt(self.squares[i][rows])

    def step(self, batch: list[np.ndarray], labels: np.ndarray, places: np.ndarray, weights: np.ndarray | None = None) -> None:
        """One step on texts of word indices; places: the table rows of each index."""
        model, shape = self.model, self.model.shape
        used, inverse = np.unique(np.concatenate([*batch, [0]]), return_inverse=True)
        ends = np.cumsum([len(t) for t in batch])
        local = np.split(inverse[:-1], ends[:-1])
        vectors, sizes, index = laid_out(places[used], model.table, local)
        pooled, winners = forward(model, vectors, sizes)
        z = np.clip(pooled @ model.weight + model.bias, -30, 30)
        error = (1 / (1 + np.exp(-z)) - labels).astype(np.float32) / len(batch)
        if weights is not None:
            error *= weights
        grad_pooled = error[:, None] * model.weight * (pooled > 0)
        grad_weight, grad_bias = pooled.T @ error, float(error.sum())
        word_rows, word_grads, kernel_grads = [], [], []
        for j, width in enumerate(WIDTHS):
            part = slice(j * shape.filters, (j + 1) * shape.filters)
            out, best, starts = winners[j]
            g = grad_pooled[:, part]
            text, filt = np.nonzero(g)
            # position of the winning window: first row of the text that has the greatest response
            at = np.array([starts[t] + np.argmax(out[starts[t] : starts[t] + sizes[t] + 2, f]) for t, f in zip(text, filt)], np.int64)
            value = g[text, filt]
            kernel_grad = np.zeros_like(model.kernels[j])
            for k in range(width):
                if len(at):
                    block = slice(k * shape.size, (k + 1) * shape.size)
                    np.add.at(kernel_grad[block].T, filt, value[:, None] * vectors[at + k])
                    word_rows.append(index[at + k])
                    word_grads.append(value[:, None] * model.kernels[j][block].T[filt])
            kernel_grads.append((kernel_grad, g.sum(axis=0)))
        for j, (kernel_grad, bias_grad) in enumerate(kernel_grads):
            self._descend(1 + j, kernel_grad)
            self._descend(1 + len(WIDTHS) + j, bias_grad)
        self._descend(len(self.seen) - 1, grad_weight)
        self.bias_square += grad_bias**2
        model.bias -= shape.rate * grad_bias / self.bias_square**0.5
        if word_rows:
            rows, grads = np.concatenate(word_rows), np.concatenate(word_grads)
            real = rows >= 0
            table_rows = places[used[rows[real]]]
            touched, where = np.unique(table_rows, return_inverse=True)
            total = np.zeros((len(touched), shape.size), np.float32)
            np.add.at(total, where.reshape(table_rows.shape), (grads[real] / 6)[:, None, :])
            self._descend(0, total, touched)
            self.touched[touched] = True


def fit(texts: list[str], labels: np.ndarray, shape: Shape = Shape()) -> Model:
    """Adagrad on batches with as many toxic as clean texts."""
    model = new_model(shape)
    toxic, clean = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    model.prior = float(labels.mean()) if len(labels) else 0.0
    if not len(toxic) or not len(clean):
        return model
    memory = WordFeatures(shape.rows)
    indexed = [memory.indices(t) for t in texts]
    places = memory.take()
    descent, draw = Descent(model), np.random.default_rng(shape.seed)
    for _ in range(shape.steps):
        half = shape.batch // 2
        chosen = np.concatenate([draw.choice(toxic, half), draw.choice(clean, shape.batch - half)])
        descent.step([indexed[i] for i in chosen], labels[chosen], places)
    model.trained, model.squares = True, [descent.squares[0], descent.dense_squares()]
    return model


class Scorer:
    """Scores of whole texts; remembers the vectors of words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self._renew()

    def _renew(self) -> None:
        self.memory = WordFeatures(self.model.shape.rows)
        self.vectors = np.zeros((0, self.model.shape.size), np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.model.trained:
            return np.full(len(texts), self.model.prior)
        if len(self.memory) > KEPT_WORDS:
            self._renew()
        indexed = [self.memory.indices(t) for t in texts]
        fresh = self.memory.take()
        if len(fresh):
            self.vectors = np.concatenate([self.vectors, self.model.table[fresh].mean(axis=1)])
        return self._pooled_scores(indexed)

    def _pooled_scores(self, indexed: list[np.ndarray], most: int = POOLED) -> np.ndarray:
        # a text of many words is pooled in parts of bounded size that overlap by two words
        cuts, owner = [], []
        for i, t in enumerate(indexed):
            for low in range(0, max(len(t), 1), most):
                cuts.append(t[low : low + most + 2])
                owner.append(i)
        pooled = np.zeros((len(indexed), len(self.model.weight)), np.float32)
        low = 0
        while low < len(cuts):
            high, total = low, 0
            while high < len(cuts) and (high == low or total + len(cuts[high]) <= most):
                total += len(cuts[high])
                high += 1
            gap = np.array([-1, -1])
            index = np.concatenate([x for t in cuts[low:high] for x in (t, gap)])
            vectors = self.vectors[index] if len(self.vectors) else np.zeros((len(index), self.model.shape.size), np.float32)
            vectors[index < 0] = 0
            best, _ = forward(self.model, vectors, np.array([len(t) for t in cuts[low:high]]))
            np.maximum.at(pooled, owner[low:high], best)
            low = high
        z = np.clip(pooled @ self.model.weight + self.model.bias, -30, 30)
        return (1 / (1 + np.exp(-z.astype(np.float64)))).astype(np.float64)


def calibrate(model: Model, texts: list[str], labels: np.ndarray, langs: list[str | None]) -> dict[str, float]:
    """Per language, the middle between the scores that part its labels with the fewest errors; from 0.5 to 0.9."""
    scores, out = Scorer(model).scores(texts), {}
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        s, y = scores[own], labels[own]
        if (y == 1).sum() < 5 or (y == 0).sum() < 5:
            continue
        edges = np.unique(np.concatenate([[0.0], s, [1.0]]))
        middles = (edges[1:] + edges[:-1]) / 2
        errors = [int(((s >= m) != (y == 1)).sum()) for m in middles]
        good = [m for m, e in zip(middles, errors) if e == min(errors)]
        out[lang] = float(np.clip(np.median(good), 0.5, 0.9))
    return out


def labelled_ids(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(l_id, toxic) of every document with a label, once; labels that contradict each other count as toxic."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(F.col("toxic").isin(0, 1)).withColumnRenamed("doc_id", "l_id")
    return store(known.join(docs.select("doc_id"), F.col("l_id") == F.col("doc_id"), "left_semi"), "labelled")


def _order():
    return F.xxhash64(F.lit("order"), "l_id")


def labelled_texts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(l_id, text, toxic, lang) of known ids; a repeated id counts once, with its least text."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    found = texts.join(known, F.col("doc_id") == F.col("l_id"))
    return found.groupBy("l_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"), F.min("lang").alias("lang"))


def first_rows(docs: DataFrame, known: DataFrame, most_rows: int) -> list:
    """At most most_rows (l_id, text, toxic, lang, held) rows for the driver, half of them toxic at most, by hash of the id."""
    by_hash = F.xxhash64(F.lit("sample"), "l_id")
    half = lambda kind, n: known.filter(F.col("toxic") == kind).orderBy(by_hash, "l_id").limit(n)
    rows = store(half(1, most_rows // 2).union(half(0, most_rows - most_rows // 2)), "first")
    picked = labelled_texts(docs, F.broadcast(rows)).orderBy(_order(), "l_id")
    return picked.select("text", "toxic", "lang", (F.pmod(_order(), F.lit(FOLDS)) == 0).alias("held")).collect()


def _changes(chunk: int, rows: np.ndarray, values: np.ndarray, squares: np.ndarray) -> tuple:
    return chunk, rows.astype("<i4").tobytes(), values.astype("<f4").tobytes(), squares.astype("<f4").tobytes()


CHANGES = pa.schema([("share", pa.int32()), ("chunk", pa.int32()), ("rows", pa.binary()), ("delta", pa.binary()), ("squares", pa.binary())])
CHANGES_SQL = "share int, chunk int, rows binary, delta binary, squares binary"


def _batch(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), CHANGES)], schema=CHANGES)


def _mean_changes(changes: pa.Table, size: int) -> pa.Table:
    """Of one chunk: the mean change of each row over the shares that changed it, the sum of its squares."""
    found = sorted(changes.to_pylist(), key=lambda r: r["share"])
    rows = np.concatenate([np.frombuffer(r["rows"], "<i4") for r in found])
    kinds, where, times = np.unique(rows, return_inverse=True, return_counts=True)
    delta, squares = (np.zeros((len(kinds), size)) for _ in range(2))
    np.add.at(delta, where, np.concatenate([np.frombuffer(r["delta"], "<f4").reshape(-1, size) for r in found]))
    np.add.at(squares, where, np.concatenate([np.frombuffer(r["squares"], "<f4").reshape(-1, size) for r in found]))
    chunk = found[0]["chunk"]
    return pa.Table.from_batches([_batch([(0, *_changes(chunk, kinds, delta / times[:, None], squares))])])


def train_round(model: Model, rows: DataFrame, shares: int, toxic_share: float) -> None:
    """Every row (l_id, text, toxic) once, in `shares` tasks that start from the model; it takes their mean change.

    The two kinds weigh the same. A task sends the table rows that it changed; the driver gets each row once."""
    spark, shape = rows.sparkSession, model.shape
    shared = spark.sparkContext.broadcast(pickle.dumps(model))
    weight = np.array([0.5 / (1 - toxic_share), 0.5 / toxic_share], np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, before = pickle.loads(shared.value), pickle.loads(shared.value)
        descent, memory, places = Descent(own), WordFeatures(shape.rows), np.zeros((0, 6), np.int32)
        held, labels = [], []

        def step() -> None:
            nonlocal memory, places
            held_indices = [memory.indices(t) for t in held]
            places = np.concatenate([places, memory.take()])
            if len(places):
                y = np.array(labels)
                descent.step(held_indices, y.astype(np.float32), places, weight[y])
            if len(memory) > KEPT_WORDS:
                memory, places = WordFeatures(shape.rows), np.zeros((0, 6), np.int32)
            held.clear(), labels.clear()

        for batch in batches:
            toxic = batch.column(1).to_pylist()
            for start, texts in text_batches(batch.column(0)):
                for i, text in enumerate(texts):
                    held.append(text)
                    labels.append(toxic[start + i])
                    if len(held) == shape.batch:
                        step()
        if held:
            step()
        share, changed = TaskContext.get().partitionId(), np.flatnonzero(descent.touched)
        delta, squares = own.table[changed] - before.table[changed], descent.squares[0][changed] - before.squares[0][changed]
        cuts = np.searchsorted(changed, np.arange(0, shape.rows + CHUNK, CHUNK))
        for chunk, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if a < b:
                yield _batch([(share, *_changes(chunk, changed[a:b], delta[a:b], squares[a:b]))])
        if len(changed):
            flat, flat_squares = own.dense() - before.dense(), descent.dense_squares() - before.squares[1]
            pad = np.zeros((-len(flat)) % shape.size, np.float32)
            lines = np.arange((len(flat) + len(pad)) // shape.size)
            yield _batch([(share, *_changes(-1, lines, np.concatenate([flat, pad]), np.concatenate([flat_squares, pad])))])
        del own, before, descent, memory, places
        give_back()

    size = shape.size
    shuffled = rows.repartition(shares, "l_id").sortWithinPartitions(_order(), "l_id")
    changes = shuffled.select("text", "toxic").mapInArrow(run, CHANGES_SQL)
    for r in changes.groupBy("chunk").applyInArrow(lambda t: _mean_changes(t, size), CHANGES_SQL).collect():  # each table row once
        lines = np.frombuffer(r["rows"], "<i4")
        delta, squares = (np.frombuffer(r[c], "<f4").reshape(-1, size) for c in ("delta", "squares"))
        if r["chunk"] >= 0:
            model.table[lines] += delta
            model.squares[0][lines] += squares
        else:
            flat = model.dense()
            model.set_dense(flat + delta.ravel()[: len(flat)])
            model.squares[1] += squares.ravel()[: len(flat)]
    shared.destroy()


def calibrate_on_all(model: Model, rows: DataFrame) -> dict[str, float]:
    """As `calibrate`, on all rows (text, toxic, lang): scores are counted in SCORE_BINS bins, their edges are tried."""
    scored = score_documents(rows.filter(F.col("lang").isNotNull()), model, ["lang", "toxic"])
    place = F.least(F.floor(F.col("score") * SCORE_BINS), F.lit(SCORE_BINS - 1)).cast("int")
    counts = scored.groupBy("lang", place.alias("bin")).agg(F.sum(F.col("toxic").cast("long")).alias("bad"), F.count(F.lit(1)).alias("n"))
    by_lang: dict[str, np.ndarray] = {}
    for r in counts.collect():  # SCORE_BINS rows a language at most
        by_lang.setdefault(r.lang, np.zeros((2, SCORE_BINS), np.int64))[:, r.bin] = r.bad, r.n - r.bad
    out = {}
    for lang, (bad, good) in sorted(by_lang.items()):
        if bad.sum() < 5 or good.sum() < 5:
            continue
        # the edge below bin k calls the bins from k on toxic
        errors = np.cumsum(np.append(0, bad)) + good.sum() - np.cumsum(np.append(0, good))
        edges = np.arange(SCORE_BINS + 1) / SCORE_BINS
        out[lang] = float(np.clip(np.median(edges[errors == errors.min()]), 0.5, 0.9))
    return out


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 3000, shape: Shape = Shape()) -> Model:
    """docs: (doc_id, text, lang); labels: (doc_id, toxic), already without rows that must not be learned from.

    Up to most_rows labelled rows are fitted by the driver; of more these begin the model, and all train it."""
    known = labelled_ids(docs, labels)
    count = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    n, toxic = sum(count.values()), count.get(1, 0)
    rows = first_rows(docs, known, most_rows)
    y = np.array([r.toxic for r in rows], np.float32)
    if n == len(rows) or not 0 < toxic < n:
        texts, langs = [r.text or "" for r in rows], [r.lang for r in rows]
        cut = max(1, len(rows) // FOLDS)
        model = fit(texts[cut:], y[cut:], shape)
        if model.trained:
            model.thresholds = calibrate(model, texts[:cut], y[:cut], langs[:cut])
    else:
        begun = [i for i, r in enumerate(rows) if not r.held]
        model = fit([rows[i].text or "" for i in begun], y[begun], shape)
        if not model.trained:  # too few rows to begin with
            model.trained, model.squares = True, [np.full_like(model.table, 1e-3), np.full_like(model.dense(), 1e-3)]
        shares = max(1, min(MOST_SHARES, round(n * len(ROUNDS[0]) / FOLDS / ROWS_PER_SHARE)))
        fold = lambda *k: labelled_texts(docs, small(known.filter(F.pmod(_order(), F.lit(FOLDS)).isin(*k))))
        for folds in ROUNDS:
            train_round(model, fold(*folds), shares, toxic / n)
        model.thresholds = calibrate_on_all(model, fold(0))
    model.squares = []
    return model


def score_documents(docs: DataFrame, model: Model, columns: list[str], text: str = "text") -> DataFrame:
    """The chosen columns, score double; every text is read whole."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    kinds = dict(docs.select(*columns).dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in columns] + ["score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(pickle.loads(shared.value))
        for batch in batches:
            for start, texts in text_batches(batch.column(len(columns))):
                kept = [batch.column(i).slice(start, len(texts)) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(scorer.scores(texts))], [*columns, "score"])
        del scorer
        give_back()

    chosen = docs.select(*columns, F.col(text).cast("string").alias("__text"))
    return chosen.mapInArrow(run, schema)


def threshold_of(model: Model, lang: str = "lang"):
    """The calibrated threshold of a language column."""
    out = F.lit(COMMON_THRESHOLD)
    for name, value in model.thresholds.items():
        out = F.when(F.col(lang) == name, value).otherwise(out)
    return out


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows whose score reaches the threshold of their language; all columns stay."""
    keys = docs.select("doc_id", "lang", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    scored = score_documents(keys, model, ["doc_id", "lang", "h"])
    bad = scored.filter(F.col("score") >= threshold_of(model)).select(F.col("doc_id").alias("b_id"), F.col("h").alias("b_h"))
    bad = store(bad.distinct(), "toxic")
    rows = docs.select(F.struct("*").alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("b_id")) & (F.xxhash64(F.coalesce("row.text", F.lit(""))) == F.col("b_h"))
    return rows.join(small(bad), same, "left_anti").select("row.*")
