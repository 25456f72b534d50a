"""Token ids in files: frequency ranks in bytes, with control bytes apart.

An id is written as its rank by frequency over all documents, in one to four bytes. Two bits for each id, four
ids to a control byte, say how many. A folder holds `ranks` (rank, id) and `blocks`, one row for at most
about BLOCK_IDS ids of whole documents: part and block (the order), start in the part, the documents' ids and
sizes, and the coded ids. Both are Parquet tables, so that Spark's commit protocol makes retried tasks harmless
and any store that Spark writes will do. Blocks follow each other in ascending document id.

Defined cases: null text has only the end id; null ids come first; rows of one id follow by the checksum of
their ids; a longer document is a block of its own; an empty table has a folder without blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qualframe.llm.bytebpe import encoder
from qualframe.llm.scratch import small, store
from qualframe.llm.words import give_back, text_batches

BLOCK_IDS = 1 << 18
END_ID = 0
#: Byte counts of the four ids of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.uint8) + 1
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of uint32 ranks."""
    ranks = ranks.astype(np.uint32)
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    control = codes[::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    at = np.cumsum(size, dtype=np.int64) - size
    total = int(at[-1]) + int(size[-1]) if len(at) else 0
    data = np.zeros(total + 3, np.uint8)
    for k in reversed(range(int(size.max(initial=0)))):
        # bytes past the end of an id lie on lower bytes of those behind it, which are written after them
        data[at + k] = (ranks >> np.uint32(8 * k)).astype(np.uint8)
    return control.tobytes(), data[:total].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of (control, data): byte counts come from a table, by control byte."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    # four bytes from the first of each id on, of which those of the ids behind it are masked out
    words = np.ndarray(len(data), "<u4", bytes(data) + bytes(3), strides=(1,))
    return words[at] & MASKS[size]


def encoded(docs: DataFrame, description: str, id_col: str, text: str, specials: bool = False) -> DataFrame:
    """(doc, n, crc, ids, counts): little-endian ids with the end id, as two bytes each where the vocabulary allows.

    A task's last row has nothing but counts: how often each id occurs in the task, eight bytes each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(description)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value, specials)
        narrow = id_type(len(own.bytes_of))
        end, counts = np.array([END_ID], np.uint32), np.zeros(len(own.bytes_of), np.int64)
        names = ["doc", "n", "crc", "ids", "counts"]
        try:
            for batch in batches:
                for start, texts in text_batches(batch.column(1)):
                    ids = [np.concatenate([x, end]) for x in own.encode_batch(texts)]
                    counts += np.bincount(np.concatenate(ids), minlength=len(counts))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(start, len(texts)),
                            pa.array([len(x) for x in ids], pa.int64()),
                            pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                            pa.array([x.astype(narrow).tobytes() for x in ids], pa.binary()),
                            pa.nulls(len(ids), pa.binary()),
                        ],
                        names,
                    )
                last = batch.column(0).type
            if counts.any():
                kinds = [last, pa.int64(), pa.int64(), pa.binary()]
                totals = pa.array([counts.astype("<i8").tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in kinds], totals], names)
        finally:
            own.forget()
            give_back()

    chosen = docs.select(F.col(id_col).alias("doc"), F.col(text).cast("string").alias("body"))
    kind = dict(chosen.dtypes)["doc"]
    return chosen.mapInArrow(run, f"doc {kind}, n long, crc long, ids binary, counts binary")


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def frequencies(ids: DataFrame) -> DataFrame:
    """(id, n) over all documents, from one row of counts a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                total = np.frombuffer(x.as_buffer(), "<i8")
                seen = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], ["id", "n"])

    counts = ids.where("counts is not null").select("counts")
    return counts.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(
    docs: DataFrame, description: str, folder: str, id_col: str = "doc_id", text: str = "text", specials: bool = False
) -> None:
    """Encode whole texts with the tokenizers library and write the folder.

    specials: a special token that is written out in a text gets its id, as the library does unless told otherwise.
    """
    spark = docs.sparkSession
    vocabulary = len(encoder(description).bytes_of)
    ids = store(encoded(docs, description, id_col, text, specials), "ids", "zstd")
    ranked = [r.id for r in frequencies(ids).orderBy(F.desc("n"), "id").collect()]  # one row an id
    spark.createDataFrame(list(enumerate(ranked)), "rank int, id int").coalesce(1).write.parquet(f"{folder}/ranks")
    rank_of = np.zeros(vocabulary, np.uint32)
    rank_of[np.array(ranked, np.int64)] = np.arange(len(ranked))
    shared, narrow = spark.sparkContext.broadcast(rank_of), id_type(vocabulary)
    kind = ids.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, ranks, block, start = TaskContext.get().partitionId(), shared.value, 0, 0
        docs_held, held, size = [], [], 0

        def out() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in held], np.uint32)
            packed = [*pack(sizes), *pack(ranks[np.concatenate(held)])]
            names = ["part", "block", "start", "n", "docs", "size_control", "size_data", "control", "data"]
            held_docs = pa.ListArray.from_arrays(pa.array([0, len(docs_held)], pa.int32()), pa.concat_arrays(docs_held))
            values = [pa.array([v], t) for v, t in ((part, pa.int32()), (block, pa.int32()), (start, pa.int64()), (size, pa.int64()))]
            return pa.RecordBatch.from_arrays([*values, held_docs, *[pa.array([b], pa.binary()) for b in packed]], names)

        for batch in batches:
            for i in range(batch.num_rows):
                docs_held.append(batch.column(0).slice(i, 1))
                held.append(np.frombuffer(batch.column(1)[i].as_buffer(), narrow))
                size += len(held[-1])
                if size >= BLOCK_IDS:
                    yield out()
                    block, start, docs_held, held, size = block + 1, start + size, [], [], 0
        if held:
            yield out()

    ordered = ids.where("counts is null").repartitionByRange("doc", "crc").sortWithinPartitions("doc", "crc", "n").select("doc", "ids")
    schema = (
        f"part int, block int, start long, n long, docs array<{kind}>, size_control binary, size_data binary, "
        "control binary, data binary"
    )
    ordered.mapInArrow(run, schema).write.option("compression", "none").parquet(f"{folder}/blocks")


def read_tokens(spark: SparkSession, folder: str, id_col: str = "doc_id", ids: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]): start counts the ids of all documents before, the end id counts."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    kind = blocks.schema["docs"].dataType.elementType.simpleString()
    table = [r.id for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()]  # one row an id
    shared = spark.sparkContext.broadcast(np.array(table, np.uint32))
    sums = blocks.groupBy("part").agg(F.sum("n").alias("in_part"))  # one row a written partition
    before = F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")
    parts = store(sums.select(F.col("part").alias("p"), before.alias("before")), "parts")
    placed = blocks.join(small(parts), F.col("part") == F.col("p")).select(
        (F.col("start") + F.col("before")).alias("start"), "n", "docs", "size_control", "size_data", "control", "data"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                start, n, held = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].values
                sizes = unpack(batch.column(3)[i].as_buffer(), batch.column(4)[i].as_buffer(), len(held)).astype(np.int64)
                values = id_of[unpack(batch.column(5)[i].as_buffer(), batch.column(6)[i].as_buffer(), n)]
                ends = np.cumsum(sizes)
                raw = values.astype("<u4").tobytes()
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                columns = [held, pa.array(start + ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())]
                if ids:
                    edges = pa.array(np.concatenate([[0], ends]), pa.int32())
                    columns.append(pa.ListArray.from_arrays(edges, pa.array(values.astype(np.int32))))
                names = [id_col, "start", "n_tokens", "ids_crc32", "ids"][: len(columns)]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    return placed.mapInArrow(run, schema)
