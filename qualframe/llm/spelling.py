"""Grouping of spelling variants: words one edit apart, each led to a much commoner form.

Counting runs in Arrow batches: letters are single bytes of Latin-1, so a text is mapped and split at once.

Near words are found in sorted lists. A list is scanned once for a whole tile of queries: the edit matrix of the
current word against every query is kept in a band of three diagonals, row by row. The next word of the list shares a
prefix with the last one, whose rows are taken as they are; only the letters behind it make new rows. Queries whose
band exceeds one edit leave the rows below; where none is left but the word itself, every following word with that
prefix is skipped.

Two words of six letters and more that are one edit apart share their first three letters or their last three. So
the vocabulary is sorted twice, as it is and with each word turned round, and cut into tiles of TILE words. Tiles
meet if they share a start of three letters and their common prefixes are within one edit; a pair found backwards
counts only if the first three letters differ. What comes together in a task are two tiles, whatever is common.

Defined cases: null texts have no words, a null id counts as an empty one, rows that repeat are counted each, an empty
table gives no words, texts of any length are read in pieces of a million characters cut between words (a single word
is held whole), other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualframe.llm.ranks import numbered
from qualframe.llm.scratch import small, store

LEAST_LETTERS = 6
LEAST_COUNT = 5
RATIO = 5
SHARED = 3  # letters that near words share at one of their ends; at most (LEAST_LETTERS - 1) // 2 rounded up
TILE = 4096
PAIRS_PER_TASK = 8
PIECE = 1_000_000
HELD = 150_000  # words counted in a task before they are handed on
SHOWN = 16  # letters of a tile's common prefix that the plan of tile pairs looks at

#: Letters A-Z in small, a-z and U+00C0 to U+00FF as they are, all else a space; in Latin-1.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))
NO_LETTER = re.compile("[^A-Za-zÀ-ÿ]")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """text in pieces that end between words."""
    start = 0
    while len(text) - start > size:
        gap = NO_LETTER.search(text, start + size)
        end = gap.end() if gap else len(text)
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def runs(text: str) -> list[bytes]:
    """The runs of letters of text, A-Z in small, as Latin-1."""
    return text.encode("latin-1", "replace").translate(LETTERS).split()


def _counter(least: int, every: int):
    """Partial counts of words; `every`: the share of runs that lose a letter, 0 for none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def handed() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in held]
            out = pa.record_batch({"word": pa.array(words, pa.string()), "n": pa.array(held.values(), pa.int64())})
            held.clear()
            return out

        for batch in batches:
            for i in range(batch.num_rows):
                text = batch["text"][i].as_py()
                if not text:
                    continue
                start = zlib.crc32(f"{batch['id'][i].as_py() or ''}:".encode())
                for piece in pieces(text):
                    found = Counter([w for w in runs(piece) if len(w) >= least])
                    if every:
                        hashes = [zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start) for w in found]
                        for w, h in [(w, h) for w, h in zip(found, hashes) if not h % every]:
                            at = h % len(w)
                            held[w[:at] + w[at + 1 :]] += found.pop(w)
                    held.update(found)
                    if len(held) > HELD:
                        yield handed()
        yield handed()

    return count


def word_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LETTERS, drop_every: int = 0) -> DataFrame:
    """(word, n): words of `least` letters and more in all texts.

    With drop_every = k, a run loses one letter in a document where k divides the CRC-32 of `<id>:<run>`.
    """
    rows = df.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))
    partial = rows.mapInArrow(_counter(least, drop_every), "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.length("word") >= least)


class Tile:
    """Words as one run of code points, each followed by two marks that no letter equals."""

    def __init__(self, words: list[str]):
        self.words, self.sizes = words, np.fromiter(map(len, words), np.int64, len(words))
        joined = "".join(w + "\0\0" for w in words)
        self.codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 2)[:-1]]) if words else np.empty(0, np.int64)

    def letter(self, which: np.ndarray, place: int) -> np.ndarray:
        """The letter at a place (from 0) of each of these words, a mark beyond their ends."""
        return self.codes[self.starts[which] + np.minimum(place, self.sizes[which])]


def shared_prefixes(words: list[str]) -> list[int]:
    """Letters that each word of a sorted list shares with the one before it."""
    out = [0] * len(words)
    for i in range(1, len(words)):
        a, b = words[i - 1], words[i]
        n = min(len(a), len(b))
        out[i] = next((k for k in range(n) if a[k] != b[k]), n)
    return out


def near_in_list(words: list[str], queries: list[str], shared: int = SHARED) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): words[i] and queries[j] are one edit apart and share their first letters; words is sorted, both distinct."""
    tile, lcp = Tile(queries), shared_prefixes(words)
    found_i, found_j = [], []
    starts: dict[str, list[int]] = {}
    for j, q in enumerate(queries):
        starts.setdefault(q[:shared], []).append(j)
    needed = set(lcp)  # only rows that a later word can share are kept
    kept: list[tuple[int, np.ndarray, np.ndarray]] = []
    i = 0
    while i < len(words):
        word, alike = words[i], lcp[i]
        while kept and kept[-1][0] > alike:
            kept.pop()
        if not kept or alike < shared:
            kept.clear()
            who = np.array(starts.get(word[:shared], []), np.int64)
            depth, band = shared, np.repeat(np.array([[1], [0], [1]], np.int8), len(who), axis=1)
            kept.append((depth, who, band))
        depth, who, band = kept[-1]
        dead = len(who) == 0 or (len(who) == 1 and queries[who[0]] == word)
        while depth < len(word) and not dead:
            code = ord(word[depth])
            before, here, after = (tile.letter(who, depth + k) != code for k in (-1, 0, 1))
            left = np.minimum(band[0] + before, band[1] + 1)
            mid = np.minimum(np.minimum(band[1] + here, band[2] + 1), left + 1)
            right = np.minimum(band[2] + after, mid + 1)
            band = np.stack([left, mid, right]).astype(np.int8)
            alive = band.min(axis=0) <= 1
            if not alive.all():
                who, band = who[alive], band[:, alive]
            depth += 1
            if depth in needed:
                kept.append((depth, who, band))
            dead = len(who) == 0 or (len(who) == 1 and queries[who[0]] == word)
        if dead:  # no later word with the first `depth` letters has a near query
            i += 1
            while i < len(words) and lcp[i] >= depth:
                i += 1
            continue
        gap = tile.sizes[who] - len(word)
        fits = np.abs(gap) <= 1
        edits = band[np.clip(gap, -1, 1) + 1, np.arange(len(who))]
        hit = who[fits & (edits == 1)]
        found_i.append(np.full(len(hit), i, np.int64))
        found_j.append(hit)
        i += 1
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.empty(0, np.int64),) * 2


def _finder(backward: str):
    def find(key: tuple, rows: pa.Table) -> pa.Table:
        side, a, b = (k.as_py() for k in key)
        rows = rows.sort_by("key")
        tiles = np.asarray(rows["tile"])
        keys, counts = rows["key"].to_pylist(), np.asarray(rows["n"])
        mine = np.nonzero(tiles == a)[0]
        other = mine if a == b else np.nonzero(tiles == b)[0]
        i, j = near_in_list([keys[k] for k in mine], [keys[k] for k in other])
        i, j = mine[i], other[j]
        if a != b:  # within a tile each word is a query too
            i, j = np.concatenate([i, j]), np.concatenate([j, i])
        if side == backward:
            words = [k[::-1] for k in keys]
            new = np.fromiter((words[x][:SHARED] != words[y][:SHARED] for x, y in zip(i, j)), bool, len(i))
            i, j = i[new], j[new]
        else:
            words = keys
        name = pa.array(words, pa.string())
        return pa.table({"word": name.take(pa.array(i)), "near": name.take(pa.array(j)), "near_n": pa.array(counts[j], pa.int64())})

    return find


def common_letters(a: Column, b: Column, most: int = SHOWN) -> Column:
    """How many letters two texts share at their start, `most` at most."""
    longer = lambda k, i: F.when((k == i - 1) & (F.length(a) >= i) & (F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i)), i)
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.lit(0), lambda k, i: F.coalesce(longer(k, i), k))


def within_one_edit(p: Column, q: Column) -> Column:
    """Whether texts that start with p and q can be at most one edit apart."""
    k = common_letters(p, q)
    fits = lambda x, y: F.startswith(x, y) | F.startswith(y, x)
    rest = lambda x, skip: F.substr(x, k + skip + 1)
    return fits(rest(p, 1), rest(q, 1)) | fits(rest(p, 1), rest(q, 0)) | fits(rest(p, 0), rest(q, 1))


def tile_pairs(lists: DataFrame) -> DataFrame:
    """(side, a, b), a <= b: tiles of lists (side, tile, key) that may hold near words with one start."""
    ends = lists.groupBy("side", "tile").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    prefix = F.substr("low", F.lit(1), common_letters(F.col("low"), F.col("high")))
    ends = store(ends.select("side", "tile", prefix.alias("prefix")), "tiles")
    starts = lists.select("side", "tile", F.substring("key", 1, SHARED).alias("start")).distinct()
    starts = store(starts.join(small(ends), ["side", "tile"]), "starts")
    left = starts.select("side", "start", F.col("tile").alias("a"), F.col("prefix").alias("p"))
    right = starts.select("side", "start", F.col("tile").alias("b"), F.col("prefix").alias("q"))
    both = left.join(right, ["side", "start"]).where("a <= b").select("side", "a", "b", "p", "q").distinct()
    return both.where((F.col("a") == F.col("b")) | within_one_edit(F.col("p"), F.col("q"))).select("side", "a", "b")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, near, near_n): all ordered pairs of distinct words (word, n) that are one edit apart."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), k.alias("key")) for s, k in (("f", F.col("word")), ("r", F.reverse("word")))]))
    lists = vocabulary.select("n", sides.alias("s")).select("s.side", "s.key", "n")
    placed = numbered(lists, ["side", "key"], "lists").withColumn("tile", F.expr(f"at div {TILE}")).drop("at")
    pairs = store(tile_pairs(placed), "tile-pairs")
    uses = pairs.select("side", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("tile"))
    # little to read and much to compute: as many tasks as tile pairs allow, not as few as bytes suggest
    tasks = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs.count() // PAIRS_PER_TASK)
    dealt = placed.join(small(uses), ["side", "tile"]).repartition(tasks, "side", "a", "b")
    return dealt.groupBy("side", "a", "b").applyInArrow(_finder("r"), "word string, near string, near_n long")


def last_forms(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root): where chains of (word, form) of at most `steps` links end; each round doubles the links followed."""
    ways = store(forms.select("word", F.col("form").alias("root")), "ways")
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        on = ways.select(F.col("word").alias("via"), F.col("root").alias("end"))
        ways = store(ways.join(on, F.col("root") == F.col("via"), "left").select("word", F.coalesce("end", "root").alias("root")), "ways")
    return ways


def spelling_forms(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each row of the vocabulary (word, n), whose words are distinct.

    form: the near word of largest n, the least on a tie, if it has `ratio` times the n of the word; root: the last form.
    """
    words = store(vocabulary.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    common = -F.col("best.less") >= ratio * F.col("n")
    told = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(common, F.col("best.near")).alias("form"),
        F.when(common, -F.col("best.less")).cast("long").alias("form_n"),
    )
    told = store(told, "forms")
    ends = words.agg(F.min("n").alias("low"), F.max("n").alias("high")).first()
    links = int(math.log(max(ends.high / max(ends.low, 1), 1), ratio)) + 1 if ends.high else 0
    roots = last_forms(told.where("form is not null"), links)
    return told.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(df: DataFrame, doc_id: str = "doc_id", text: str = "text", drop_every: int = 0) -> DataFrame:
    """`spelling_forms` of the words of df that occur LEAST_COUNT times and more."""
    counted = word_counts(df, doc_id, text, LEAST_LETTERS, drop_every)
    return spelling_forms(counted.where(F.col("n") >= LEAST_COUNT))
