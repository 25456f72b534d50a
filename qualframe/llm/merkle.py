"""A Merkle manifest of a table: every group of rows is a hash tree, and the groups' roots are one more.

The trees are kept as a content-addressed graph: packs of records digest -> children, each pack under the digest
of its top node and DEPTH levels high. Rows ask for their proofs from the root downwards. A request carries the rank
of its row; each level takes the next digit of that rank, goes to that child and notes the others. A step of the
descent fetches one pack for all requests that are below its top, so the rows exchanged for a step are the packs and
one row for each pack wanted, not one for each request and level. The noted steps run from the root to the row;
turned round they are the proof.

Defined cases: null values count as `-` in a leaf, null groups and keys come first, rows that repeat are leaves of
their own (equal subtrees share one pack), an empty table has no root and no proofs, texts of any length are hashed
where they lie and never moved. Input columns are carried in a struct, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualframe.llm.ranks import numbered_by_group
from qualframe.llm.scratch import store

WIDTH = 2
DEPTH = 10

STEP = "struct<digit int, others string>"
PACK = "g long, rank long, n long, digest string, height int, records array<struct<digest string, children array<string>>>"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields, each as the length of its UTF-8 bytes, a colon and itself; null is a dash."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to; proof runs from the leaf upwards."""

    def join(digest: Column, step: Column) -> Column:
        cut = step["digit"] * 64
        return F.sha2(F.concat(F.substr(step["others"], F.lit(1), cut), digest, F.substr(step["others"], cut + 1)), 256)

    return F.aggregate(proof, leaf, join)


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda s: s["others"]), ""), 256)


@dataclass
class Forest:
    """Trees over (g, rank, n, digest): packs by round, from the leaves up, and (g, digest, rounds) of the roots."""

    rounds: list[DataFrame]
    roots: DataFrame
    width: int
    depth: int


@dataclass
class Manifest:
    """leaves: (row, group, leaf, g, n, rank), row being the input row; groups: (group, g, n); trees: a tree a group;
    top: the tree of their roots."""

    leaves: DataFrame
    groups: DataFrame
    trees: Forest
    top: Forest


def digest_of(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def _packer(width: int, depth: int):
    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        level, n, height, records = rows["digest"].to_pylist(), rows["n"][0].as_py(), 0, []
        while height < depth and n > 1:
            runs = [level[i : i + width] for i in range(0, len(level), width)]
            level = [digest_of(run) for run in runs]
            records += [{"digest": d, "children": run} for d, run in zip(level, runs)]
            n, height = -(-n // width), height + 1
        kind = pa.list_(pa.struct([("digest", pa.string()), ("children", pa.list_(pa.string()))]))
        return pa.table(
            {
                "g": rows["g"][:1],
                "rank": pa.array([rows["rank"][0].as_py() // width**depth], pa.int64()),
                "n": pa.array([n], pa.int64()),
                "digest": pa.array(level, pa.string()),
                "height": pa.array([height], pa.int32()),
                "records": pa.array([records], kind),
            }
        )

    return pack


def build_forest(nodes: DataFrame, most: int, name: str, width: int = WIDTH, depth: int = DEPTH) -> Forest:
    """Trees over nodes (g, rank, n, digest), n being the nodes of g; most: the nodes of the largest g.

    Each round packs `depth` levels: at most width ** depth nodes come together in a task.
    """
    span, rounds = width**depth, []
    ends = [nodes.where("n = 1").select("g", "digest", F.lit(0).alias("rounds"))]
    while most > 1:
        block = F.expr(f"rank div {span}").alias("block")
        packs = nodes.where("n > 1").select("g", "rank", "n", "digest").groupBy("g", block).applyInArrow(_packer(width, depth), PACK)
        rounds.append(store(packs, f"{name}-packs"))
        nodes = rounds[-1]
        ends.append(nodes.where("n = 1").select("g", "digest", F.lit(len(rounds)).alias("rounds")))
        most = -(-most // span)
    return Forest(rounds, store(reduce(DataFrame.union, ends), f"{name}-roots"), width, depth)


def _descender(width: int, span: int):
    def descend(rows: pa.Table) -> pa.Table:
        row = rows.to_pylist()[0]  # one pack and all that is wanted below its top
        children = {r["digest"]: r["children"] for r in row["records"]}
        digests, paths = [], []
        for low in row["digits"]:
            node, path = row["digest"], list(row["path"])
            for level in reversed(range(row["height"])):
                digit, run = low // width**level % width, children[node]
                path.append({"digit": digit, "others": "".join(run[:digit] + run[digit + 1 :])})
                node = run[digit]
            digests.append(node)
            paths.append(path)
        return pa.table(
            {
                "g": pa.array([row["g"]] * len(digests), pa.int64()),
                "rank": pa.array([row["block"] * span + low for low in row["digits"]], pa.int64()),
                "digest": pa.array(digests, pa.string()),
                "path": pa.array(paths, pa.list_(pa.struct([("digit", pa.int32()), ("others", pa.string())]))),
            }
        )

    return descend


def descend(forest: Forest, starts: DataFrame, requests: DataFrame, name: str) -> DataFrame:
    """(g, rank, digest, path) for the distinct requests (g, rank).

    starts: (g, digest, path), the root of each wanted tree and the way to it; path grows from the root downwards.
    """
    span = forest.width**forest.depth
    begin = starts.join(forest.roots.select("g", "rounds"), "g").withColumn("rank", F.lit(0).cast("long"))
    columns = ["g", "rank", "digest", "path"]
    at = begin.where(F.col("rounds") == len(forest.rounds)).select(*columns)
    for step in reversed(range(len(forest.rounds))):
        block, digit = F.expr(f"rank div {span ** (step + 1)}"), F.expr(f"rank div {span**step} % {span}")
        wanted = requests.groupBy("g", block.alias("block")).agg(F.array_sort(F.collect_set(digit)).alias("digits"))
        packs = forest.rounds[step].dropDuplicates(["digest"]).select("digest", "height", "records")
        asked = at.withColumnRenamed("rank", "block").join(wanted, ["g", "block"]).join(packs, "digest")
        found = asked.groupBy("digest", "g", "block").applyInArrow(
            _descender(forest.width, span), f"g long, rank long, digest string, path array<{STEP}>"
        )
        at = begin.where(F.col("rounds") == step).select(*columns).unionByName(found)
        if step:
            at = store(at, f"{name}-way")
    return at


def build_manifest(df: DataFrame, group: str, keys: list[str], leaf: str, width: int = WIDTH, depth: int = DEPTH) -> Manifest:
    """The manifest of df: a tree for each value of group, its leaves in the order of keys, then of the leaf digests."""
    order = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    told = df.select(
        F.struct("*").alias("row"),
        F.col(group).alias("group"),
        F.col(leaf).alias("leaf"),
        *order,
        F.monotonically_increasing_id().alias("copy"),  # tells equal rows apart
    )
    by = [*(f"k{i}" for i in range(len(keys))), "leaf", "copy"]
    leaves, groups = numbered_by_group(store(told, "leaves"), "group", by, "leaves")
    most = groups.agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("groups")).first()
    trees = build_forest(leaves.select("g", "rank", "n", F.col("leaf").alias("digest")), most.most or 0, "trees", width, depth)
    subroots = trees.roots.select(
        F.lit(0).cast("long").alias("g"), F.col("g").alias("rank"), F.lit(most.groups).cast("long").alias("n"), "digest"
    )
    top = build_forest(subroots, most.groups, "top", width, depth)
    return Manifest(leaves.select("row", "group", "leaf", "g", "n", "rank"), groups, trees, top)


def root_of(manifest: Manifest) -> DataFrame:
    """(root): one row, none for an empty table."""
    return manifest.top.roots.select(F.col("digest").alias("root"))


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """(g, rank, leaf, proof) for the distinct (g, rank) in requests; proof runs from the leaf to the root."""
    nothing = F.array().cast(f"array<{STEP}>")
    entry = manifest.top.roots.select("g", "digest", nothing.alias("path"))
    wanted = requests.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("rank")).distinct()
    tops = descend(manifest.top, entry, wanted, "top")
    starts = store(tops.select(F.col("rank").alias("g"), "digest", "path"), "starts")
    found = descend(manifest.trees, starts, requests.select("g", "rank"), "trees")
    return found.select("g", "rank", F.col("digest").alias("leaf"), F.reverse("path").alias("proof"))
