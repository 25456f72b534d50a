"""Benchmark decontamination by winnowing.

Of every run of WINDOW - GRAM + 1 consecutive hashes of GRAM words the least one is kept as a fingerprint. Any
WINDOW words shared by a document and a benchmark item cover one such run in both, so they share a fingerprint:
no shared span of WINDOW words is missed. Fingerprints of documents are joined with those of the benchmark, and
every hit is extended to the WINDOW words on each side that contain it, which are compared word for word.
Items of fewer words than WINDOW are one window of their own length; for each such length all runs of that
many words of a document are fingerprints.

Defined cases: null or empty text has no words and is clean; repeated documents are each answered; an item
without words occurs nowhere; items that share a window all count; items with one id and different texts count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualframe.llm.scratch import small, store

WINDOW, GRAM = 10, 5
RUN = WINDOW - GRAM + 1
PLACE_BITS = 30  # a string has fewer than 2^30 words
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_GAPS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of digits, Latin letters and characters beyond ASCII, with A-Z made small."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # lower() is quicker, but also changes capitals beyond ASCII, so it serves only texts without them
    small_text = F.when(text.rlike("[\\x{80}-\\x{10FFFF}&&[^\\p{Ll}\\p{M}\\p{P}\\p{Nd}\\p{Z}]]"), F.translate(text, UPPER, LOWER)).otherwise(
        F.lower(text)
    )
    return F.array_remove(F.split(small_text, WORD_GAPS), "")


def hash_runs(words: str, length: int) -> Column:
    """Hashes of all runs of that many words, in their low bits with the place of the run."""
    packed = lambda i: F.shiftleft(
        F.xxhash64(F.slice(words, i + 1, length)).bitwiseAND(F.lit((1 << 33) - 1)), PLACE_BITS
    ).bitwiseOR(i.cast("long"))
    return F.transform(F.sequence(F.lit(0), F.size(words) - length), packed)


def fingerprints(df: DataFrame, shorter: list[int]) -> DataFrame:
    """df (with `words`) and `marks`: array of (kind, mark, place); kind 0 is winnowed, else the run's length."""
    n = F.size("words")
    df = df.withColumn("packed", F.when(n >= WINDOW, hash_runs("words", GRAM)))
    least = F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.least(*[F.get("packed", i + k) for k in range(RUN)])
    )
    df = df.withColumn("packed", F.array_distinct(F.when(n >= WINDOW, least)))

    def unpack(packed: Column, kind: int) -> Column:
        return F.transform(
            packed,
            lambda p: F.struct(
                F.lit(kind).alias("kind"),
                F.shiftright(p, PLACE_BITS).alias("mark"),
                p.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int").alias("place"),
            ),
        )

    none = F.array().cast("array<struct<kind:int,mark:bigint,place:int>>")
    parts = [F.coalesce(unpack(F.col("packed"), 0), none)]
    for m in shorter:
        parts.append(F.coalesce(F.when(n >= m, unpack(hash_runs("words", m), m)), none))
    return df.withColumn("marks", F.concat(*parts)).drop("packed")


def benchmark_windows(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, words, shorter): shorter is the length of an item below WINDOW words, else 0."""
    words = items.select(F.col(item).alias("item"), words_of(F.col(text)).alias("words"))
    n = F.size("words")
    return words.filter(n > 0).withColumn("shorter", F.when(n < WINDOW, n).otherwise(0))


def run_text(words, start: Column, length: int | Column) -> Column:
    return F.array_join(F.slice(words, start + 1, length), " ")


def overlaps(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_words, n_hit, item_ids): one row per document; item_ids sorted as strings."""
    bench = store(benchmark_windows(items), "benchmark")
    shorter = sorted(r.shorter for r in bench.select("shorter").distinct().collect() if r.shorter)  # 9 at most
    marks = fingerprints(bench, shorter).select("shorter", F.explode("marks").alias("m"))
    # a short item stands only for its whole length, a long one only for its winnowed marks
    marks = marks.filter(F.col("m.kind") == F.col("shorter")).select(
        F.col("m.kind").alias("b_kind"), F.col("m.mark").alias("b_mark")
    )
    marks = store(marks.distinct().withColumn("found", F.lit(True)), "marks")
    length = F.when(F.col("shorter") > 0, F.col("shorter")).otherwise(WINDOW)
    starts = F.explode(F.sequence(F.lit(0), F.size("words") - length)).alias("start")
    windows = bench.select("item", "words", length.alias("length"), starts)
    windows = windows.select("item", run_text("words", F.col("start"), F.col("length")).alias("window")).distinct()
    windows = store(windows, "windows")

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # rows with one id and one text get one answer
    df = docs.select(F.col(doc).alias("doc"), F.xxhash64(body).alias("text_hash"), words_of(body).alias("words"))
    df = fingerprints(df, shorter)
    whole = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("mark"), F.lit(0).alias("place")))
    df = df.select("doc", "text_hash", "words", F.explode(F.concat("marks", whole)).alias("m"))
    low = F.greatest(F.col("m.place") - (RUN - 1), F.lit(0))
    context = F.when(F.col("m.kind") == 0, F.slice("words", low + 1, F.col("m.place") - low + WINDOW)).when(
        F.col("m.kind") > 0, F.slice("words", F.col("m.place") + 1, F.col("m.kind"))
    )
    df = df.select(
        "doc", "text_hash", F.size("words").cast("long").alias("n_words"), "m.kind", "m.mark", "m.place",
        low.alias("low"), context.alias("context"),
    )
    hits = df.join(small(marks), (F.col("kind") == F.col("b_kind")) & (F.col("mark") == F.col("b_mark")), "left")
    hits = store(hits.filter(F.col("found") | (F.col("kind") < 0)).drop("b_kind", "b_mark", "found"), "hits")

    per_doc = hits.filter(F.col("kind") < 0).select("doc", "text_hash", "n_words")
    found = covered(extend(hits.filter(F.col("kind") >= 0)), windows)
    return (
        per_doc.join(
            small(store(found.withColumnsRenamed({"doc": "f_doc", "text_hash": "f_hash"}), "found")),
            F.col("doc").eqNullSafe(F.col("f_doc")) & (F.col("text_hash") == F.col("f_hash")),
            "left",
        )
        .select(
            "doc",
            "text_hash",
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        )
    )


def extend(hits: DataFrame) -> DataFrame:
    """(doc, text_hash, start, window, length): the windows around each hit that lie in the document."""
    last = F.size("context") - WINDOW
    around = F.when(
        F.col("kind") == 0,
        F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct((F.col("low") + i).alias("start"), run_text("context", i, WINDOW).alias("window"), F.lit(WINDOW).alias("length")),
        ),
    ).otherwise(F.array(F.struct(F.col("place").alias("start"), F.array_join("context", " ").alias("window"), F.col("kind").alias("length"))))
    return hits.filter((F.col("kind") > 0) | (last >= 0)).select("doc", "text_hash", F.explode(around).alias("w")).select("doc", "text_hash", "w.*")


def covered(candidates: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc, text_hash, n_hit, item_ids) of documents in which a window occurs."""
    pairs = candidates.join(small(windows), "window")
    places = pairs.groupBy("doc", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct("start", "length"))).alias("places"),
        F.array_sort(F.collect_set(F.coalesce(F.col("item").cast("string"), F.lit("")))).alias("item_ids"),
    )
    # walk the sorted windows; a word counts once however many windows cover it
    walked = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(
            F.greatest(a.end, p.start + p.length).alias("end"),
            (a.n + F.greatest(F.lit(0), p.start + p.length - F.greatest(a.end, p.start))).cast("long").alias("n"),
        ),
        lambda a: a.n,
    )
    return places.select("doc", "text_hash", walked.alias("n_hit"), "item_ids")


def drop_contaminated(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that hold a benchmark window; all columns stay."""
    report = overlaps(docs, items, doc, text)
    bad = report.filter(F.col("n_hit") > 0).select(F.col("doc").alias("b_doc"), F.col("text_hash").alias("b_hash"))
    bad = store(bad.distinct(), "contaminated")
    rows = docs.select(F.struct("*").alias("row"))
    body = F.coalesce(F.col(f"row.{text}").cast("string"), F.lit(""))
    same = F.col(f"row.{doc}").eqNullSafe(F.col("b_doc")) & (F.xxhash64(body) == F.col("b_hash"))
    return rows.join(small(bad), same, "left_anti").select("row.*")
