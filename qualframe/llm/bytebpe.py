"""Byte-level BPE with the tokenizers library, over Arrow batches.

Every byte stands for one printable character (the byte table), so that the library works on text; ids are
turned back by reversing the table, and bytes that are no whole character are kept or shown as U+FFFD.

Text is cut before single spaces and single line breaks between two non-blank characters. No match of the split
pattern crosses such a place, nor one between a letter and a mark, so pieces are encoded alone with the same ids as the whole
text, and a task encodes a piece once as long as it remembers it. Arrow cuts the texts of a run and tells its distinct
pieces; only these are looked up, and the ids of the run are gathered from theirs. Texts where blanks meet are cut one
by one. Tokenizers that change the text first or split it by other rules get whole
texts instead. Added tokens of the description that the library finds in a text are taken out first, where it would
find them, and what lies between them is cut.

Defined cases: null text is empty and has no ids; a lone surrogate cannot occur in Spark strings; ids outside
the table stop the job.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from qualframe.llm.words import give_back, text_batches

# Fixed value: the byte-level split pattern, with which cuts before single blanks agree.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT_PIECES = 400_000  # in one task, about 60 MB; a fuller memory starts anew
LONGEST_KEPT = 64  # characters; longer pieces are encoded each time
KEPT_MARKS = 10_000


def byte_table() -> list[str]:
    """The character of each byte: itself where printable, else the next free one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, free = [""] * 256, 256
    for b in range(256):
        if b in shown:
            table[b] = chr(b)
        else:
            table[b] = chr(free)
            free += 1
    return table


BYTES = byte_table()
#: A Latin word with its space, and punctuation after it: two matches of the pattern.
WORD_AND_MARKS = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?%&$*#|()]*)")

#: Stands before a piece that has no space: the start of a text or marks behind a letter. Texts with it are not cut.
BARE = "\x01"
MARKS_BEHIND_LETTER = r"(\pL)([.,;:!?%&$*#|()])"


def can_cut(description: dict) -> bool:
    """Whether a tokenizer leaves the text as it is and splits it by the byte-level pattern only."""
    steps = description.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    *splits, last = steps
    by_pattern = last.get("use_regex") and not splits or [s.get("pattern", {}).get("Regex") for s in splits] == [PATTERN]
    return (
        description.get("normalizer") is None
        and description["model"].get("type") == "BPE"
        and last.get("type") == "ByteLevel"
        and not last.get("add_prefix_space")
        and bool(by_pattern)
    )


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that merge into token last, if only merges of lower rank come before."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], own))
        if ranks.get(parts[best] + parts[best + 1], own) >= own:
            return None
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """A description for the tokenizers library with the same ids as the ranks."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    table = byte_table()
    write = lambda bs: "".join(table[b] for b in bs)
    merges = [last_merge(t, ranks) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
    pairs = [(write(a), write(b)) for a, b in filter(None, merges)]
    # a whole piece that has an id takes it, also where no merges lead there
    own = Tokenizer(models.BPE(vocab={write(t): r for t, r in ranks.items()}, merges=pairs, ignore_merges=True))
    own.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    own.decoder = decoders.ByteLevel()
    return own.to_str()


class Encoder:
    """Ids of whole texts. Built once per Python worker from the description of a tokenizer.

    specials: a special token that is written out in a text gets its id, as the library does unless told otherwise;
    else its characters are text like any other.
    """

    def __init__(self, description: str, specials: bool = False):
        from tokenizers import Tokenizer

        parsed = json.loads(description)  # gone before the tokenizer is built: both at once are a worker's highest point
        added, by_pattern = parsed.get("added_tokens", []), can_cut(parsed)
        del parsed
        self.tokenizer = Tokenizer.from_str(description)
        self.tokenizer.encode_special_tokens = not specials
        back = {c: b for b, c in enumerate(byte_table())}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        del vocab
        for token in added:
            if token["id"] >= len(self.bytes_of):
                self.bytes_of += [b""] * (token["id"] + 1 - len(self.bytes_of))
            self.bytes_of[token["id"]] = token["content"].encode()
        self.model = self.tokenizer.model
        found = [t for t in added if t["content"] and (specials or not t.get("special"))]
        self.added = {t["content"]: np.array([t["id"]], np.uint32).tobytes() for t in found}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        wide = any(t.get(k) for t in found for k in ("lstrip", "rstrip", "single_word"))
        self.cuts = by_pattern and not wide
        self.forget()

    def forget(self) -> None:
        """Drop the pieces learned so far; what stays is the tokenizer."""
        self.cache = PieceIds(self._learn, self._word)
        self.marks = Memo(KEPT_MARKS)

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        if not self.cuts:
            return [np.frombuffer(self._ids(t), np.uint32) for t in texts]
        apart = [BARE in t or any(a in t for a in self.added) for t in texts]
        found = iter(self._by_distinct_pieces([t for t, other in zip(texts, apart) if not other]))
        return [np.frombuffer(self._between_added(t), np.uint32) if other else next(found) for t, other in zip(texts, apart)]

    def _by_distinct_pieces(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without added tokens, each distinct piece of all texts being looked up once."""
        if not texts:
            return []
        cut = pc.replace_substring_regex(pa.array([BARE + t for t in texts]), MARKS_BEHIND_LETTER, rf"\1 {BARE}\2")
        cut = pc.split_pattern(pc.replace_substring(cut, "\n", " \n"), " ")
        coded = cut.flatten().dictionary_encode()
        if len(self.cache) >= KEPT_PIECES:
            self.cache.clear()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.cache.get, pieces))
        blank = np.zeros(len(pieces), bool)  # pieces at which blanks meet
        cache, tokenize, space = self.cache, self.model.tokenize, BYTES[32]
        for i in [i for i, ids in enumerate(known) if ids is None]:
            piece = pieces[i]
            if piece.isascii() and piece.isalpha() and len(piece) <= LONGEST_KEPT and len(cache) < KEPT_PIECES:
                # most pieces: a word, as in _word
                known[i] = cache[piece] = array("I", [t.id for t in tokenize(space + piece)]).tobytes()
                continue
            try:
                known[i] = cache[piece]
            except KeyError:
                known[i], blank[i] = b"", True
        place, ends = coded.indices.to_numpy(), cut.offsets.to_numpy()
        sizes = np.fromiter(map(len, known), np.int32, len(known)) // 4
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        flat, sizes = np.frombuffer(b"".join(known), np.uint32), sizes[place]
        until = np.concatenate([np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)])
        shift = np.repeat(starts[place] - until[:-1], sizes)
        shift += np.arange(len(shift), dtype=np.int32)
        ids, until = flat[shift], until[ends].tolist()
        meet = np.logical_or.reduceat(blank[place], ends[:-1])
        one = lambda i, t: np.frombuffer(self._by_pieces(t), np.uint32) if meet[i] else ids[until[i] : until[i + 1]]
        return [one(i, t) for i, t in enumerate(texts)]

    def _between_added(self, text: str) -> bytes:
        if BARE in text:
            return self._ids(text)
        parts = self.at_added.split(text)
        return b"".join([self.added[p] if i % 2 else self._by_pieces(p) for i, p in enumerate(parts)])

    def _by_pieces(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.replace("\n", " \n").split(" ")
        try:
            if not first or first[-1].isspace():
                raise KeyError(first)
            known = list(map(self.cache.__getitem__, rest))
        except KeyError:
            first, *rest = joined_at_blanks([first, *rest])
            known = [self.cache[p] if stands_alone(p) else self._ids(written(p)) for p in rest]
        return b"".join([self._learn(first.replace(" \n", "\n")), *known])

    def _word(self, letters: str) -> bytes:
        """Ids of a space and letters, which are one match of the pattern."""
        body = letters if letters.isascii() else "".join([BYTES[b] for b in letters.encode()])
        return array("I", [t.id for t in self.model.tokenize(BYTES[32] + body)]).tobytes()

    def _learn(self, piece: str) -> bytes:
        """A word is one match of the pattern and goes to the model at once, marks or a line break beside it likewise."""
        if piece[0] == "\n" and len(piece) > 1 and not piece[1].isspace():
            return self._memo("\n") + self._learn(piece[1:])
        parts = WORD_AND_MARKS.fullmatch(piece)
        if not parts:
            return self._ids(piece)
        word, marks = parts.groups()
        if marks and word[0] == " ":
            return self.cache[word[1:]] + self._memo(marks)
        shown = word.replace(" ", BYTES[32]) if word.isascii() else "".join([BYTES[b] for b in word.encode()])
        ids = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return ids + self._memo(marks) if marks else ids

    def _memo(self, marks: str) -> bytes:
        found = self.marks.get(marks)
        if found is None:
            found = self.marks[marks] = self._ids(marks)
        return found

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Start and end in code points of each id; an id inside a character covers that character."""
        return self.tokenizer.encode(text, add_special_tokens=False).offsets

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that do not make a whole character become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


def stands_alone(piece: str) -> bool:
    """Whether a piece starts (after its line break or BARE) and ends with a character that is not blank."""
    return bool(piece) and not piece[-1].isspace() and not piece[piece[0] in ("\n", BARE)].isspace()


def written(piece: str) -> str:
    """The text of a piece: its space, which pieces leave out unless they start with a line break or BARE, belongs to it."""
    if piece[:1] == BARE:
        return piece[1:]
    return (piece if piece[:1] == "\n" else " " + piece).replace(" \n", "\n")


def joined_at_blanks(parts: list[str]) -> list[str]:
    """Parts of a text that was cut before every space and line break, joined again wherever blanks meet."""
    out = parts[:1]
    for p in parts[1:]:
        start = p[p[:1] == "\n" :][:1]
        if start and not start.isspace() and out[-1] and not out[-1][-1].isspace():
            out.append(p)
        else:
            out[-1] += " " + p
    return out


class PieceIds(dict):
    """Ids of pieces, learned on demand; starts anew when it is full."""

    def __init__(self, learn, learn_word):
        super().__init__()
        self.learn, self.learn_word = learn, learn_word

    def __missing__(self, piece: str) -> bytes:
        if piece.isalpha() and (piece.isascii() or max(piece) <= "\u024f"):
            ids = self.learn_word(piece)
        elif piece == BARE:
            return b""
        elif stands_alone(piece):
            ids = self.learn(written(piece))
        else:
            raise KeyError(piece)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Memo(dict):
    """A dictionary that starts anew when it is full."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def __setitem__(self, key, value):
        if len(self) >= self.most:
            self.clear()
        super().__setitem__(key, value)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(description: str, specials: bool = False) -> Encoder:
    """The worker's encoder for this description; tasks tell it to forget the pieces they made it learn."""
    key = hashlib.md5(description.encode()).hexdigest(), specials
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(description, specials)
        give_back()
    return _encoders[key]


def encode_documents(docs, description: str, id_col: str = "doc_id", text: str = "text", ids: bool = True, digests: bool = True):
    """(id, n_tokens, ids, ids_sha256, decoded_sha256): ids as array<int>; decoded is what the ids give back."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(description)
    kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]
    fields = [f"`{id_col}` {kind}", "n_tokens long"]
    fields += ["ids array<int>"] * ids + ["ids_sha256 string", "decoded_sha256 string"] * digests
    schema = T._parse_datatype_string(", ".join(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        names = [str(i) for i in range(len(own.bytes_of))]
        try:
            for batch in batches:
                for start, texts in text_batches(batch.column(1)):
                    found = own.encode_batch(texts)
                    columns = [batch.column(0).slice(start, len(texts)), pa.array([len(x) for x in found], pa.int64())]
                    if ids:
                        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                        flat = np.concatenate([*found, np.empty(0, np.uint32)]).astype(np.int32)
                        columns.append(pa.ListArray.from_arrays(ends, flat))
                    if digests:
                        listed = (",".join(map(names.__getitem__, x.tolist())) for x in found)
                        columns.append(pa.array([hashlib.sha256(s.encode()).hexdigest() for s in listed]))
                        columns.append(pa.array([hashlib.sha256(own.decode_bytes(x)).hexdigest() for x in found]))
                    yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])
        finally:
            own.forget()
            give_back()

    chosen = docs.select(F.col(id_col), F.col(text).cast("string").alias("__text"))
    return chosen.mapInArrow(run, schema)
