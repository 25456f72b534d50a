"""Word hashes of texts, for operators that run numpy inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

KEPT_WORDS = 300_000  # in one task, about 40 MB; a fuller memory starts anew
EDGES = ".,;:!?\"'()[]{}<>|*#%&$-_/\\`~^+=@«»¿¡“”‘’…–—"


class WordHashes(dict):
    """64-bit hash of a word, in small letters and without punctuation at its ends; 0 if nothing is left."""

    def __missing__(self, word: str) -> int:
        plain = word.lower().strip(EDGES)
        value = self[word] = (xxhash.xxh3_64_intdigest(plain) or 1) if plain else 0
        return value


def word_hashes(text: str, known: WordHashes | None = None) -> np.ndarray:
    """uint64 hash of each word of the whole text, in order; a task hands in what it knows already."""
    known, words = WordHashes() if known is None else known, text.split()
    if len(known) > KEPT_WORDS:
        known.clear()
    found = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    return found[found != 0]


def give_back() -> None:
    """Return what a task has freed to the system: a Python worker outlives its tasks, and idle ones add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters them (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of that many words; of all words, where they are fewer."""
    n = min(length, len(words))
    if n == 0:
        return np.empty(0, np.uint64)
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out + words[k : len(words) - n + 1 + k]) if k else mix(out ^ words[: len(words) - n + 1])
    return out


def text_batches(column: pa.Array, most_bytes: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in runs of bounded size; a longer text is a run of its own, null is empty."""
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > most_bytes:
            yield start, [t or "" for t in column[start:i].to_pylist()]
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, [t or "" for t in column[start:].to_pylist()]
