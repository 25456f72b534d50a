"""Embedding near-duplicates by tiled comparison in the order of the principal axes.

Vectors are brought to length one and turned onto the principal axes of the whole table, which leaves cosines as
they are and puts most of each vector into its first components. Equal vectors are one class with a weight. Classes
are sorted by their leading components and cut into blocks; two blocks are compared unless the boxes of their
leading components are too far apart. Within two blocks, tile by tile, the products of the leading components are
summed first. What the rest can add is at most the product of the norms of the two suffixes; a pair is given up as
soon as that cannot reach the threshold, and the pairs left go on with the next components. Pairs within MARGIN of
the threshold are decided by a correctly rounded dot product of the vectors as given.

A block pair returns for each vector the number of its links and one edge to the root of its local component, so
a group of many copies leaves a task as a star and not as all its pairs, and no link is lost.

Compute is quadratic in the blocks whose boxes meet, as the method is; each block pair is a task's group of bounded
size. Nothing of a vector passes through the driver: it gets the d x d sums of products.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different length do not link; repeated rows are copies; a null vec_id is answered and never the name of a component
unless all its members have none; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualframe.llm.components import components
from qualframe.llm.ranks import hot_hashes, join_hot, numbered
from qualframe.llm.scratch import small, store

THRESHOLD = 0.9
BLOCK_BYTES = 4_000_000  # of doubles, in one block
MOST_ROWS = 8192  # of a block
TILE = 1024
PAIRS_PER_TASK = 4
AXES = 4  # leading components that sort and box the blocks
ENERGY = (0.35, 0.65)  # a stage ends where the leading axes hold this part of all squares
MARGIN = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length, as doubles."""
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows or vanishes."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        lengths = np.asarray(batch["dim"])
        for dim in np.unique(lengths).tolist():
            yield dim, batch.filter(pa.array(lengths == dim))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for dim, batch in by_length(batches):
        for start in range(0, batch.num_rows, 4096):
            x = unit(_matrix(batch["vector"].slice(start, 4096)))
            sums[dim] = sums.get(dim, 0) + x.T @ x
    for dim, total in sums.items():
        for i in range(dim):
            yield pa.record_batch(
                {
                    "dim": pa.array([dim] * (dim - i), pa.int32()),
                    "i": pa.array([i] * (dim - i), pa.int32()),
                    "j": pa.array(range(i, dim), pa.int32()),
                    "s": pa.array(total[i, i:], pa.float64()),
                }
            )


def principal_axes(vectors: DataFrame) -> dict[int, tuple[np.ndarray, list[int]]]:
    """For each length of vectors (dim, vector): the axes as columns, largest first, and where stages end."""
    sums = vectors.select("dim", "vector").mapInArrow(_products, "dim int, i int, j int, s double")
    found: dict[int, np.ndarray] = {}
    for r in sums.groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).collect():  # dim * dim / 2 numbers
        m = found.setdefault(r.dim, np.zeros((r.dim, r.dim)))
        m[r.i, r.j] = m[r.j, r.i] = r.s
    out = {}
    for dim, m in found.items():
        values, axes = np.linalg.eigh(m)
        share = np.cumsum(np.maximum(values[::-1], 0)) / max(np.trace(m), 1e-300)
        stages = sorted({min(int(np.searchsorted(share, e)) + 1, dim) for e in ENERGY} | {dim})
        out[dim] = (np.ascontiguousarray(axes[:, ::-1]), stages)
    return out


def _leading(axes: dict[int, tuple[np.ndarray, list[int]]], width: float):
    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, batch in by_length(batches):
            z = np.zeros((batch.num_rows, AXES))
            k = min(AXES, dim)
            z[:, :k] = unit(_matrix(batch["vector"])) @ axes[dim][0][:, :k]
            cells = np.floor(z / width).astype(np.int32)
            extra = {f"q{i}": pa.array(cells[:, i]) for i in range(AXES)} | {f"z{i}": pa.array(z[:, i]) for i in range(AXES)}
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra.values()], names=[*batch.schema.names, *extra])

    return lead


def close_pairs(x: np.ndarray, y: np.ndarray, stages: list[int], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, dot) of all pairs whose dot product is at least `least`; x and y are turned unit vectors.

    A stage adds components up to its end and one column with the norm of what follows: the product of the widened
    rows is the most that the whole dot product can be.
    """
    rows, cols = np.arange(len(x)), np.arange(len(y))
    done, partial = 0, np.zeros((len(x), len(y)))
    for end in stages:
        if end < x.shape[1]:
            rest_x = np.sqrt(np.einsum("ij,ij->i", x[rows, end:], x[rows, end:]))
            rest_y = np.sqrt(np.einsum("ij,ij->i", y[cols, end:], y[cols, end:]))
        partial += x[rows, done:end] @ y[cols, done:end].T
        done = end
        if end == x.shape[1]:
            break
        alive = partial + rest_x[:, None] * rest_y[None, :] >= least
        keep_r, keep_c = alive.any(axis=1), alive.any(axis=0)
        if not keep_r.any():
            return rows[:0], cols[:0], np.empty(0)
        left = np.count_nonzero(alive)
        if left * 20 < keep_r.sum() * keep_c.sum():  # few pairs: go on with these alone
            i, j = np.nonzero(alive)
            dots = partial[i, j]
            i, j = rows[i], cols[j]
            for at in range(0, left, 1 << 16):
                part = slice(at, at + (1 << 16))
                dots[part] += np.einsum("ij,ij->i", x[i[part], done:], y[j[part], done:])
            good = dots >= least
            return i[good], j[good], dots[good]
        partial, rows, cols = partial[np.ix_(keep_r, keep_c)], rows[keep_r], cols[keep_c]
    i, j = np.nonzero(partial >= least)
    return rows[i], cols[j], partial[i, j]


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of the pairs (i, j) in label, in place; label[k] is the least member of k's component."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    dot, aa, bb = (math.fsum((p * q).tolist()) for p, q in ((a, b), (a, a), (b, b)))
    return dot / math.sqrt(aa * bb) if 0 < aa * bb < math.inf else math.fsum((unit(a[None])[0] * unit(b[None])[0]).tolist())


def _comparer(axes: dict[int, tuple[np.ndarray, list[int]]], threshold: float):
    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        a, b = key[1].as_py(), key[2].as_py()
        rows = rows.combine_chunks().sort_by([("block", "ascending"), ("c", "ascending")])
        given = _matrix(rows["vector"].combine_chunks())
        turn, stages = axes[given.shape[1]]
        x, weight = unit(given) @ turn, np.asarray(rows["weight"])
        split = int(np.count_nonzero(np.asarray(rows["block"]) == a))
        links, label = np.zeros(len(x), np.int64), np.arange(len(x))
        second = range(split, len(x), TILE) if a != b else range(0, len(x), TILE)
        for r in range(0, split, TILE):
            for s in second:
                if a == b and s < r:
                    continue
                r_end, s_end = min(r + TILE, split), min(s + TILE, len(x))
                i, j, dots = close_pairs(x[r:r_end], x[s:s_end], stages, threshold - MARGIN)
                i, j = i + r, j + s
                good = (dots >= threshold + MARGIN) & (i != j)
                if r == s:
                    good &= i < j
                for k in np.nonzero((dots < threshold + MARGIN) & (i != j))[0]:
                    good[k] = (r != s or i[k] < j[k]) and exact_cosine(given[i[k]], given[j[k]]) >= threshold
                i, j = i[good], j[good]
                links += np.bincount(i, weight[j], len(x)).astype(np.int64) + np.bincount(j, weight[i], len(x)).astype(np.int64)
                merge(label, i, j)
        had = np.nonzero(links)[0]
        rows = rows.select(["c", "vec_id"])
        mine, root = rows.take(had), rows.take(label[had])
        return pa.table(
            {
                "c": mine["c"], "vec_id": mine["vec_id"], "links": pa.array(links[had]),
                "root_c": root["c"], "root_id": root["vec_id"],
            }
        )

    return compare


def block_pairs(blocks: DataFrame, threshold: float) -> DataFrame:
    """(dim, a, b), a <= b: blocks (dim, block, low0.., high0..) whose boxes are near enough for a link."""
    far = 2 - 2 * threshold + 1e-6  # the squared distance of two unit vectors with that cosine
    width = math.sqrt(far)
    first = lambda end: F.floor(F.col(end) / width)
    names = [f"{end}{i}" for end in ("low", "high") for i in range(AXES)]
    left = blocks.select("dim", F.col("block").alias("a"), *names, F.explode(F.sequence(first("low0") - 1, first("high0") + 1)).alias("slab"))
    right = blocks.select("dim", F.col("block").alias("b"), *[F.col(n).alias(f"{n}_") for n in names])
    right = right.withColumn("slab", F.explode(F.sequence(F.floor(F.col("low0_") / width), F.floor(F.col("high0_") / width))))
    apart = F.lit(0.0)
    for i in range(AXES):
        gap = F.greatest(F.lit(0.0), F.col(f"low{i}") - F.col(f"high{i}_"), F.col(f"low{i}_") - F.col(f"high{i}"))
        apart = apart + gap * gap
    return left.join(right, ["dim", "slab"]).where((F.col("a") <= F.col("b")) & (apart <= far)).select("dim", "a", "b").distinct()


def near_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id), one row for each row of df."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0")
    cells = F.col(vector).cast("array<double>")
    sound = (F.size(cells) > 0) & F.forall(cells, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    sound = F.coalesce(sound & F.exists(cells, lambda v: v != 0), F.lit(False))
    plain = F.transform(F.col(vector), lambda v: v + F.lit(0).cast(df.schema[vector].dataType.elementType))  # no -0
    rows = df.select(F.col(vec_id).alias("vec_id"), F.when(sound, plain).alias("vector"))
    kept = rows.where("vector is not null")
    classes = kept.groupBy("vector").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("weight"))
    classes = store(classes.withColumn("dim", F.size("vector")), "classes")
    axes = principal_axes(classes)
    width = math.sqrt(2 - 2 * threshold + 1e-6)
    extra = ", ".join([f"q{i} int" for i in range(AXES)] + [f"z{i} double" for i in range(AXES)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema.fields) + ", " + extra
    led = classes.mapInArrow(_leading(axes, width), schema)
    order = ["dim", *(f"q{i}" for i in range(AXES)), "z0", "vec_id", "vector"]
    placed = numbered(led, order, "placed", "c")
    most = F.greatest(F.lit(64), F.least(F.lit(MOST_ROWS), F.expr(f"{BLOCK_BYTES} div (8 * dim)")))
    placed = store(placed.withColumn("block", F.floor(F.col("c") / most)), "placed")
    ends = [f(f"z{i}").alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(AXES)]
    pairs = store(block_pairs(store(placed.groupBy("dim", "block").agg(*ends), "blocks"), threshold), "pairs")
    sides = pairs.select("dim", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    # little to read and much to compute: as many tasks as block pairs allow, not as few as bytes suggest
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs.count() // PAIRS_PER_TASK)
    dealt = placed.select("dim", "block", "c", "vec_id", "weight", "vector").join(small(sides), ["dim", "block"])
    dealt = dealt.repartition(tasks, "dim", "a", "b")
    id_type = df.schema[vec_id].dataType.simpleString()
    told = dealt.groupBy("dim", "a", "b").applyInArrow(
        _comparer(axes, threshold), f"c long, vec_id {id_type}, links long, root_c long, root_id {id_type}"
    )
    told = store(told, "told")
    node = lambda i, c: F.struct(F.col(i).isNull().alias("nameless"), F.col(i).alias("id"), F.col(c).alias("c"))
    edges = told.where("c <> root_c").select(node("vec_id", "c").alias("a"), node("root_id", "root_c").alias("b"))
    labels = components(edges).select(F.col("node.c").alias("c"), F.col("label.id").alias("component"), F.lit(True).alias("found"))
    counts = told.groupBy("c").agg(F.sum("links").alias("links"))
    answers = placed.select("c", "vector", "vec_id", "weight").join(counts, "c", "left").join(labels, "c", "left")
    answers = store(
        answers.select(
            "vector",
            "weight",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"),
            F.when(F.col("found"), F.col("component")).otherwise(F.col("vec_id")).alias("component_id"),
        ),
        "answers",
    )
    linked = join_hot(kept, F.col("vector"), answers.withColumnRenamed("vector", "v"), F.col("v"), hot_hashes(answers, F.col("vector"), "weight"))
    alone = rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.select("vec_id", "n_links", "component_id").unionByName(alone)
