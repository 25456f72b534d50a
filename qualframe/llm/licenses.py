"""License scans by conditional compression.

Sentences and lines with the words of licences, runs of them, and what is next to such a word are candidate blocks. Each block is compressed alone and
once with each template as raw dictionary; templates are ranked by the bytes that they save. Only those that come
first for some block are looked at further: each is aligned with the words around the block, as far as it may reach, and
confirmed where the span differs from it in nothing but few words, none of them a number or a name of another licence.
Of confirmed spans that overlap, the one that its template shrinks by most bytes is kept, then the one with fewest
differences. What a confirmed span does not cover stays a candidate, a block for each run of such units.
An SPDX identifier is confirmed as the licence it names, each one of an expression.

Defined cases: null and empty texts have no blocks; a block without a confirmed template counts as candidate only;
SPDX identifiers that are not listed here do too; repeated rows are each answered; other columns, whatever their names,
are left out. A very long text is one Python string; what is compressed is a sentence, a line or a run of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualframe.llm.words import text_batches

CUES = r"(?i)licen[sc]e|copyright|permission|warrant|redistribut|spdx|\brights\s+reserved|\brights\s*:"
GAP = 2
MOST_DIFFERENT = 0.1
FIRST = 6  # templates of a block that are aligned, and those that save as much as the last of them
NEAR = 60  # characters on both sides of a cue, so that a short notice in a long sentence comes first for a block
KEPT_BLOCKS = 4096  # ranked blocks that a task remembers
LONG_BLOCK = 4096  # characters of a block that is remembered
NEVER = 1 << 20  # more than any number of differences
# Words that make another licence of a notice.
TELLING = {"lesser", "affero"}
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
#: Numbers of list items, which notices have or leave out.
MARKER = re.compile(r"(?:^|[\n:;.])[^\w\n]*(\d{1,2})[.)](?=\s+[A-Z])")
SPDX = re.compile(r"(?i)spdx-license-identifier:[ \t]*(\(*[\w.+-]+\)*(?:[ \t]+(?:and|or|with)[ \t]+\(*[\w.+-]+\)*)*)")
SPDX_ID = re.compile(r"(?i)(?:\b(and|or|with)[ \t]+)?\(*([\w.+-]+)")

# Published notices, by SPDX name.
BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
    " that the following conditions are met:",
    " Redistributions of source code must retain the above copyright notice, this list of conditions and the"
    " following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of"
    " conditions and the following disclaimer in the documentation and/or other materials provided with the"
    " distribution.",
    " All advertising materials mentioning features or use of this software must display the following"
    " acknowledgement: This product includes software developed by the organization.",
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission.",
]
GNU = (
    "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public"
    " License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any"
    " later version."
)
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of"
        " the Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions: The above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
        " compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,"
        " software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR"
        " CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing"
        " permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        GNU.format("program", "", "3"),
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        GNU.format("program", "", "2"),
    ],
    "LGPL-3.0": [GNU.format("library", "Lesser ", "3")],
    "LGPL-2.1": [GNU.format("library", "Lesser ", "2.1")],
    "LGPL-2.0": [GNU.format("library", "Library ", "2")],
    "AGPL-3.0": [GNU.format("program", "Affero ", "3")],
    "BSD-3-Clause": [BSD[0], BSD[0] + BSD[1] + BSD[3]],
    "BSD-2-Clause": [BSD[0] + BSD[1]],
    "BSD-4-Clause": ["".join(BSD)],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Rights: CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Rights: CC BY 4.0."],
    "CC0-1.0": ["Released under CC0 1.0 Universal license.", "Rights: CC0 1.0."],
    # not a licence, but what a text says of its rights
    "LicenseRef-All-Rights-Reserved": ["All rights reserved."],
}
SPDX_NAMES = [
    *TEMPLATES,
    *"0BSD AFL-3.0 Apache-1.1 Artistic-2.0 BSL-1.0 CC-BY-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0".split(),
    *"CC-BY-SA-4.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-1.0 ISC MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OSL-3.0".split(),
    *"PostgreSQL Unlicense WTFPL X11 Zlib".split(),
]



@dataclass(frozen=True)
class Found:
    start: int
    end: int
    name: str | None  # confirmed licence
    reduction: float  # of the best template
    differences: tuple[str, ...]  # -word of the template, +word of the block


def plain_words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def units(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the sentences of each line."""
    start = 0
    for line in text.split("\n"):
        low = 0
        for m in re.finditer(r"[.!?:;] ", line):
            yield start + low, start + m.end() - 1
            low = m.end()
        yield start + low, start + len(line)
        start += len(line) + 1


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Number, start and end of the units with a cue, also one that a line break divides."""
    cues, out, k = [m.span() for m in re.finditer(CUES, text)], [], 0
    for i, (a, b) in enumerate(units(text)):
        while k < len(cues) and cues[k][1] <= a:
            k += 1
        if k < len(cues) and cues[k][0] < b:
            out.append((i, a, b))
    return out


def runs(found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Start and end of runs of candidates with at most GAP units between them."""
    out, last = [], None
    for i, a, b in found:
        if last is not None and i - last <= GAP + 1:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
        last = i
    return out


def is_fixed(word: str) -> bool:
    return word in TELLING or any(c.isdigit() for c in word)


def least_differences(expected: np.ndarray, removal: np.ndarray, words: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """By end: the least cost of expected against any run of words that ends there."""
    paid = np.concatenate([[0], np.cumsum(extra)])
    row = np.zeros(len(words) + 1, np.int64)
    for w, cost in zip(expected, removal):
        met = row + cost
        met[1:] = np.minimum(met[1:], np.where(words == w, row[:-1], NEVER))
        row = np.minimum.accumulate(met - paid) + paid
    return row


def differing(expected: list[str], words: list[str], extra: list[int]) -> tuple[str, ...]:
    """-word of the template, +word of the block: as few as can be."""
    if expected == words:
        return ()
    removal = [NEVER if is_fixed(w) else 1 for w in expected]
    cost = [[0] * (len(words) + 1) for _ in range(len(expected) + 1)]  # of what is left from there
    for i in range(len(expected), -1, -1):
        for j in range(len(words), -1, -1):
            ways = [cost[i + 1][j] + removal[i]] if i < len(expected) else []
            ways += [cost[i][j + 1] + extra[j]] if j < len(words) else []
            if i < len(expected) and j < len(words) and expected[i] == words[j]:
                ways.append(cost[i + 1][j + 1])
            cost[i][j] = min(ways, default=0)
    out, i, j = [], 0, 0
    while i < len(expected) or j < len(words):
        if i < len(expected) and j < len(words) and expected[i] == words[j] and cost[i][j] == cost[i + 1][j + 1]:
            i, j = i + 1, j + 1
        elif i < len(expected) and cost[i][j] == cost[i + 1][j] + removal[i]:
            out.append("-" + expected[i])
            i += 1
        else:
            out.append("+" + words[j])
            j += 1
    return tuple(out)


class Scanner:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, kept: int = FIRST):
        self.kept = kept
        self.plain = zstandard.ZstdCompressor(level=3)
        self.number: dict[str, int] = {}  # of each word of a template
        self.templates = []
        for name, texts in templates.items():
            for t in texts:
                given = zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                given.precompute_compress(level=3)
                expected = plain_words(t)
                ids = np.array([self.number.setdefault(w, len(self.number)) for w in expected])
                removal = np.array([NEVER if is_fixed(w) else 1 for w in expected])
                self.templates.append((name, expected, ids, removal, zstandard.ZstdCompressor(level=3, dict_data=given)))
        self.reach = max(len(t[1]) + int(MOST_DIFFERENT * len(t[1])) for t in self.templates)
        self.spdx = {n.lower(): n for n in SPDX_NAMES}
        self.known: dict[str, tuple[int, list[int]]] = {}

    def savings(self, block: str) -> tuple[int, list[int]]:
        """Bytes of the compressed block, and how many fewer they are with each template."""
        raw = " ".join(block.lower().split())
        found = self.known.get(raw)
        if found is None:
            coded = raw.encode()
            alone = len(self.plain.compress(coded))
            found = alone, [alone - len(t[4].compress(coded)) for t in self.templates]
            if len(raw) <= LONG_BLOCK:
                if len(self.known) >= KEPT_BLOCKS:
                    self.known.clear()
                self.known[raw] = found
        return found

    def reduction(self, block: str) -> float:
        """By what share the best template makes a block smaller."""
        alone, saved = self.savings(block)
        return max(saved) / alone

    def first(self, block: str) -> set[int]:
        """The templates that save most of a block."""
        saved = self.savings(block)[1]
        least = sorted(saved, reverse=True)[: self.kept][-1]
        return {k for k, n in enumerate(saved) if n >= least}

    def aligned(self, ids: np.ndarray, extra: np.ndarray, chosen: set[int]) -> Iterator[tuple[int, int, int, int]]:
        """Template, first word, word after the last, and differences, of spans of one chosen template that do not overlap."""
        present = np.zeros(len(self.number), bool)
        present[ids[ids >= 0]] = True
        for k in sorted(chosen):
            _, expected, wanted, removal, _ = self.templates[k]
            most = int(MOST_DIFFERENT * len(expected))
            if removal[~present[wanted]].sum() > most:
                continue
            row = least_differences(wanted, removal, ids, extra)
            ends = np.flatnonzero(row <= most)
            taken = np.zeros(len(ids), bool)
            for end in ends[np.argsort(row[ends], kind="stable")].tolist():
                if taken[end - 1]:
                    continue
                low = max(0, end - len(expected) - most)
                back = least_differences(wanted[::-1], removal[::-1], ids[low:end][::-1], extra[low:end][::-1])
                start = end - int(np.argmin(back))
                if start < end and not taken[start:end].any():
                    taken[start:end] = True
                    yield k, start, end, int(back.min())

    def words(self, text: str) -> list[tuple[int, int, str]]:
        """Start, end and word; the parts of a template's word that a line break divides are one."""
        out: list[tuple[int, int, str]] = []
        for m in WORD.finditer(text):
            word = m.group().lower()
            if out and text[out[-1][1] : m.start()] in ("\n", "-\n"):
                a, _, before = out[-1]
                if before + word in self.number and not (before in self.number and word in self.number):
                    out[-1] = (a, m.end(), before + word)
                    continue
            out.append((m.start(), m.end(), word))
        return out

    def notices(self, text: str, cues: list[tuple[int, int, int]]) -> list[Found]:
        """Confirmed templates around the candidate units."""
        spans = self.words(text)
        words = [w for _, _, w in spans]
        starts = np.array([a for a, _, _ in spans], np.int64)
        markers = {m.start(1) for m in MARKER.finditer(text)}
        ids = np.array([self.number.get(w, -1) for w in words], np.int64)
        extra = np.array([NEVER if is_fixed(w) and a not in markers else 1 for w, a in zip(words, starts.tolist())], np.int64)
        near = ((max(0, m.start() - NEAR), min(len(text), m.end() + NEAR)) for m in re.finditer(CUES, text))
        blocks = sorted({*runs(cues), *((a, b) for _, a, b in cues), *near})
        regions: list[tuple[int, int, set[int]]] = []  # of words, with the templates that came first for a block in it
        for a, b in blocks:
            low, high = np.searchsorted(starts, [a, b])
            low, high = max(0, int(low) - self.reach), min(len(words), int(high) + self.reach)
            chosen = self.first(text[a:b])
            if regions and low <= regions[-1][1]:
                before = regions.pop()
                regions.append((before[0], max(before[1], high), before[2] | chosen))
            else:
                regions.append((low, high, chosen))
        ranked = []
        for low, high, chosen in regions:
            for k, a, b, n in self.aligned(ids[low:high], extra[low:high], chosen):
                a, b = low + a, low + b
                stop = re.compile(r"[^\w\s]*").match(text, spans[b - 1][1]).end()
                alone, saved = self.savings(text[spans[a][0] : stop])
                ranked.append((-saved[k], n, k, a, b, stop, alone))
        out, taken = [], np.zeros(len(words), bool)
        for less, _, k, a, b, stop, alone in sorted(ranked):
            if not taken[a:b].any():
                taken[a:b] = True
                name, expected = self.templates[k][:2]
                out.append(Found(spans[a][0], stop, name, -less / alone, differing(expected, words[a:b], extra[a:b].tolist())))
        return out

    def identifiers(self, text: str) -> Iterator[Found]:
        """Confirmed licences of SPDX lines; the first one's span starts with the line's key."""
        for line in SPDX.finditer(text):
            start = line.start()
            for m in SPDX_ID.finditer(text, line.start(1), line.end(1)):
                written = re.sub(r"(?i)(-only|-or-later)$", "", m.group(2).rstrip(".+"))
                name = self.spdx.get(written.lower())
                if name and (m.group(1) or "").lower() != "with":
                    yield Found(start, m.end(2), name, self.reduction(text[start : m.end(2)]), ())
                    start = m.end(2)
                else:
                    start = m.start(2)

    def scan(self, text: str) -> list[Found]:
        cues = candidates(text)
        if not cues:
            return []
        out = sorted([*self.notices(text, cues), *self.identifiers(text)], key=lambda f: (f.start, f.end))
        left, k = [], 0
        for i, a, b in cues:
            while k < len(out) and out[k].end <= a:
                k += 1
            if k == len(out) or out[k].start >= b:
                left.append((i, a, b))
        for a, b in runs(left):
            # a run is divided where a confirmed span lies in it
            inside = [f for f in out if f.name and a < f.start and f.end < b]
            edges = [a, *[x for f in inside for x in (f.start, f.end)], b]
            for low, high in zip(edges[::2], edges[1::2]):
                own = [(x, y) for _, x, y in left if low <= x and y <= high]
                if own:
                    out.append(Found(own[0][0], own[-1][1], None, self.reduction(text[own[0][0] : own[-1][1]]), ()))
        return sorted(out, key=lambda f: (f.start, f.end))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_blocks, n_confirmed, licenses, spans): one row per document; licenses sorted and comma-joined.

    spans: start and end in code points, the confirmed licence or null, the best reduction, the differing words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        span = pa.struct(
            [
                ("start", pa.int64()),
                ("end", pa.int64()),
                ("license", pa.string()),
                ("reduction", pa.float64()),
                ("differences", pa.list_(pa.string())),
            ]
        )
        for batch in batches:
            for start, texts in text_batches(batch.column(1)):
                found = [scanner.scan(t) if t else [] for t in texts]
                names = [sorted({f.name for f in fs if f.name}) for fs in found]
                spans = [
                    [{"start": f.start, "end": f.end, "license": f.name, "reduction": f.reduction, "differences": list(f.differences)} for f in fs]
                    for fs in found
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(texts)),
                        pa.array([len(fs) for fs in found], pa.int64()),
                        pa.array([sum(f.name is not None for f in fs) for fs in found], pa.int64()),
                        pa.array([",".join(n) for n in names]),
                        pa.array(spans, pa.list_(span)),
                    ],
                    ["doc", "n_blocks", "n_confirmed", "licenses", "spans"],
                )

    body = F.col(text).cast("string")
    # texts without any cue are not sent to Python
    chosen = docs.select(F.col(id_col).alias("doc"), F.when(body.rlike(CUES), body).alias("body"))
    kind = dict(chosen.dtypes)["doc"]
    out = chosen.mapInArrow(
        run,
        f"doc {kind}, n_blocks long, n_confirmed long, licenses string, spans array<struct<start:long,end:long,"
        "license:string,reduction:double,differences:array<string>>>",
    )
    return out.withColumnRenamed("doc", id_col)
