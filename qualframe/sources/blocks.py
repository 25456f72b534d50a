"""Delimited text cut into records by many tasks, line breaks inside quotes included.

Spark splits a file into blocks of bytes and reads the lines that begin in each. Whether a line begins inside a quoted
cell depends on all lines before it, so each block is first looked at under both assumptions: how many records begin
in it and whether it ends inside quotes. These few numbers are scanned over the blocks of a file, which settles where
each block starts. Then every block is cut by itself; only a record that crosses the end of a block leaves its task,
and its parts are joined by file and record number. The same scan numbers the records, so a row has the same number
however the file was split.

A quote opens a cell only at its beginning and is an ordinary character elsewhere in an unquoted cell. Lines end with
a line feed, with or without a carriage return before it, or with carriage returns alone; which of the two is seen in
the first line of the first file. Records of white space alone are skipped and not numbered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = ("file", "start", "length")
SUMMARY = "file string, start long, length long, starts0 long, starts1 long, end0 boolean, end1 boolean"
PIECE = "file string, record long, start long, text string, whole boolean"


def lines(spark: SparkSession, path: str, ending: str = "\n") -> DataFrame:
    """(file, start, length, value): the lines of each block, in order within a task."""
    read = spark.read.option("lineSep", ending).text(path)
    block = ("file_path", "file_block_start", "file_block_length")
    return read.select(*[F.col(f"_metadata.{m}").alias(name) for m, name in zip(block, BLOCK)], "value")


def ends_inside(line: Column, delimiter: str, begins_inside: bool) -> Column:
    """Whether a line ends inside a quoted cell.

    The texts before each quote decide: inside, a quote closes; outside it opens at the start of a cell, and right
    behind the closing quote, which makes the two a quote that is meant.
    """
    before = F.split(line, '"')

    def quote(at: Column, text: Column) -> Column:
        opens = ~at["inside"] & (text.endswith(delimiter) | (at["closed"] & (text == "")))
        return F.struct(opens.alias("inside"), at["inside"].alias("closed"))

    start = F.struct(F.lit(begins_inside).alias("inside"), F.lit(not begins_inside).alias("closed"))
    walked = F.aggregate(F.slice(before, F.lit(1), F.size(before) - 1), start, quote, lambda at: at["inside"])
    return F.when(line.contains('"'), walked).otherwise(F.lit(begins_inside))


def _flagged(found: DataFrame, delimiter: str, quoted: bool) -> DataFrame:
    value = F.col("value")
    inside = [ends_inside(value, delimiter, b) if quoted else F.lit(False) for b in (False, True)]
    spaces = " \t\r".replace(delimiter, "")
    return found.withColumns({"end0": inside[0], "end1": inside[1], "blank": F.btrim(value, F.lit(spaces)) == ""})


def states_before(end0: np.ndarray, end1: np.ndarray, state: bool) -> tuple[np.ndarray, bool]:
    """(whether each line begins inside, whether the last one ends inside), if the first begins in `state`.

    A line that ends alike whatever it begins in sets the state; between two of these only turns are counted.
    """
    n = len(end0)
    sets, turns = end0 == end1, np.concatenate([[0], np.cumsum(end0 & ~end1)])
    last = np.maximum.accumulate(np.where(sets, np.arange(n), -1))
    base = np.where(last >= 0, end0[last], state)
    after = base ^ ((turns[1:] - turns[last + 1]) % 2 == 1)
    return np.concatenate([[state], after[:-1]]).astype(bool), bool(after[-1]) if n else state


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(block, its next rows); the rows of a block follow each other."""
    for batch in batches:
        if not batch.num_rows:
            continue
        start, file = np.asarray(batch["start"]), batch["file"].dictionary_encode().indices
        cuts = np.nonzero((np.diff(start) != 0) | (np.diff(np.asarray(file)) != 0))[0] + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield tuple(batch[c][low].as_py() for c in BLOCK), batch.slice(low, high - low)


def _summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, starts, state = None, [0, 0], [False, True]

    def told() -> pa.RecordBatch:
        cells = [[at[0]], [at[1]], [at[2]], [starts[0]], [starts[1]], [state[0]], [state[1]]]
        names = (*BLOCK, "starts0", "starts1", "end0", "end1")
        return pa.record_batch(dict(zip(names, map(pa.array, cells))))

    for block, rows in _by_block(batches):
        if at is not None and block != at:
            yield told()
            starts, state = [0, 0], [False, True]
        at = block
        end0, end1, blank = (rows[c].to_numpy(zero_copy_only=False) for c in ("end0", "end1", "blank"))
        for k in (0, 1):
            inside, state[k] = states_before(end0, end1, state[k])
            starts[k] += int(np.count_nonzero(~inside & ~blank))
    if at is not None:
        yield told()


def block_table(flagged: DataFrame) -> DataFrame:
    """(file, start, length, inside, first, crossed): for each block whether it begins inside quotes, the number of
    records that begin before it in all files, and whether one of its records lies in another block too; besides, the
    records in all files before its own, and the files up to it that have records."""
    seen = flagged.select(*BLOCK, "end0", "end1", "blank").mapInArrow(_summarize, SUMMARY)
    in_file = Window.partitionBy("file").orderBy("start")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    sets, turns = F.col("end0") == F.col("end1"), (F.col("end0") & ~F.col("end1")).cast("int")
    seen = seen.withColumns({
        "stretch": F.count_if(sets).over(earlier),
        "base": F.coalesce(F.last(F.when(sets, F.col("end0")), ignorenulls=True).over(earlier), F.lit(False)),
    })
    turned = F.coalesce(F.sum(turns).over(Window.partitionBy("file", "stretch").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = seen.withColumn("inside", F.col("base") != (turned % 2 == 1))
    starts = F.when(F.col("inside"), F.col("starts1")).otherwise(F.col("starts0"))
    seen = seen.withColumns({"starts": starts, "leaves": F.when(F.col("inside"), F.col("end1")).otherwise(F.col("end0"))})
    before = F.coalesce(F.sum("starts").over(earlier), F.lit(0))
    files = seen.groupBy("file").agg(F.sum("starts").alias("in_file"))
    in_order = Window.orderBy("file")
    files = files.withColumns({"in_files": F.sum("in_file").over(in_order) - F.col("in_file"), "headers": F.count_if(F.col("in_file") > 0).over(in_order)})
    return seen.withColumn("before", before).join(F.broadcast(files), "file").select(
        *BLOCK, "inside", (F.col("in_files") + F.col("before")).alias("first"), (F.col("inside") | F.col("leaves")).alias("crossed"),
        "in_files", "headers",
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each block: whole ones, and parts of those that go on beyond it."""
    at, state, record, open_lines, open_whole = None, False, 0, [], True

    def piece(records: list, texts: list, whole: list) -> pa.RecordBatch:
        n = len(records)
        cells = (pa.array([at[0]] * n, pa.string()), pa.array(records, pa.int64()), pa.array([at[1]] * n, pa.int64()))
        return pa.record_batch(dict(zip(("file", "record", "start", "text", "whole"), (*cells, pa.array(texts, pa.string()), pa.array(whole, pa.bool_())))))

    for block, rows in _by_block(batches):
        if block != at:
            if open_lines:
                yield piece([record], ["\n".join(open_lines)], [False])
            at, state, record, open_lines = block, rows["inside"][0].as_py(), rows["first"][0].as_py() - 1, []
            open_whole = False  # what is open at the start of a block began before it
        end0, end1, blank = (rows[c].to_numpy(zero_copy_only=False) for c in ("end0", "end1", "blank"))
        inside, state = states_before(end0, end1, state)
        after = np.concatenate([inside[1:], [state]])
        begins = ~inside & ~blank
        numbers = record + np.cumsum(begins)
        single = np.nonzero(begins & ~after)[0]
        if len(single):
            texts = rows["value"].take(pa.array(single))
            yield piece(numbers[single].tolist(), texts.to_pylist(), [True] * len(single))
        longer = np.nonzero((begins & after) | inside)[0]
        done: tuple[list, list, list] = ([], [], [])
        for i, text in zip(longer.tolist(), rows["value"].take(pa.array(longer)).to_pylist()):
            if begins[i]:
                open_lines, open_whole = [], True
            open_lines.append(text)
            if not after[i]:
                for out, x in zip(done, (int(numbers[i]), "\n".join(open_lines), open_whole)):
                    out.append(x)
                open_lines = []
        if done[0]:
            yield piece(*done)
        record = int(numbers[-1])
    if open_lines:
        yield piece([record], ["\n".join(open_lines)], [False])


def records(spark: SparkSession, path: str, delimiter: str, quoted: bool = True, ending: str = "\n") -> DataFrame:
    """(file, header, row, text): every record of the files, `header` for the first of each file; row numbers the
    others from 0 over all files in the order of their paths, alike for any split.

    Lazy; each use reads the files for the block table (flags of lines only), then to cut them, and where a record
    crosses blocks a third time. A split that the table does not know stops the job: then files were split anew
    between two scans of one job.
    """
    flagged = _flagged(lines(spark, path, ending), delimiter, quoted)
    table = block_table(flagged)
    known = F.xxhash64(*[F.col(c) for c in BLOCK])
    small = table.select(known.alias("key"), "inside", "first", "crossed")
    placed = flagged.withColumn("key", known).join(F.broadcast(small), "key", "left")
    guard = F.when(F.col("first").isNull(), F.raise_error(F.lit("The files changed or were split anew while being read."))).otherwise(F.col("first"))
    placed = placed.withColumn("first", guard)
    shape = ("value", "end0", "end1", "blank", "inside", "first")
    whole = placed.select(*BLOCK, *shape).mapInArrow(_cut, PIECE).where("whole").select("file", "record", "text")
    if quoted:
        parts = placed.where("crossed").select(*BLOCK, *shape).mapInArrow(_cut, PIECE).where("NOT whole")
        pieces = F.array_sort(F.collect_list(F.struct("start", "text")))
        joined = F.array_join(F.transform(pieces, lambda p: p["text"]), "\n")
        whole = whole.union(parts.groupBy("file", "record").agg(joined.alias("text")))
    files = table.groupBy("file").agg(F.first("in_files").alias("in_files"), F.first("headers").alias("headers"))
    return whole.join(F.broadcast(files), "file").select(
        "file",
        (F.col("record") == F.col("in_files")).alias("header"),
        (F.col("record") - F.col("headers")).alias("row"),
        F.regexp_replace("text", "\r$", "").alias("text"),
    )
