"""License scan: an exact set-similarity join of text blocks with license templates, and phrase places.

Words are runs of letters, digits and non-ASCII characters, lower-cased A-Z.  The tokens of the join are
pairs of neighbouring words, so that a set of them holds the order of the words.  A block is any stretch of
words up to a quarter longer than the template; a block meets a template when it holds at least
``threshold`` of the template's distinct pairs.  Every stretch counts, wherever it starts.

The join is exact.  Template pairs are ordered by their frequency in the whole corpus (one aggregate over a
vocabulary bounded by the templates; the templates go to every task, the texts do not move).  With an
overlap of o needed of n template pairs, a block without one of the n - o + 1 rarest cannot meet it (prefix
filter); a text with fewer than o places of the template's pairs cannot (length filter); and only stretches that
reach from a prefix pair with o - 1 further places within their length can (positional filter).  What passes
is counted in full.

A label stands for the terms, not for a word of them: "cc by nc" holds all words of "cc by" but not its
pairs, so the longer name is not labelled as the shorter.  Of blocks that overlap, one gives way to another
label's that holds as many pairs and a greater share of its template, so two versions of a notice are told apart.

Defined results: null text counts as empty (no words, no labels, null places, score 0); repeated rows are
scanned row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlake.llm.common import raw, read_table, slices

# What ends a word, the phrases with their labels, and the published notices and short forms of each license.
BREAKS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = {
    "apache-2": [
        "licensed under the apache license version 2 0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
        and limitations under the License.""",
    ],
    "bsd": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.""",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
        THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
        CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
        LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
        SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ],
    "cc-by": ["licensed under cc by 4 0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nc-nd": ["licensed under cc by nc nd 4 0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "cc-by-nc-sa": ["licensed under cc by nc sa 4 0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "cc-by-nd": ["licensed under cc by nd 4 0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "gpl-2": [
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
        Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
        "licensed under the gnu general public license version 2",
    ],
    "gpl-3": [
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
        Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
        "licensed under the gnu general public license version 3",
    ],
    "isc": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies.""",
    ],
    "mit": [
        "released under the mit license",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction""",
    ],
    "mpl-2": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
        You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}
THRESHOLD = 0.85

_TABLE = bytearray(range(256))
for _b in range(0x41, 0x5B):
    _TABLE[_b] = _b + 32
for _b in BREAKS:
    _TABLE[_b] = 0x20
TABLE = bytes(_TABLE)

SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
BLOCKS = "doc_id long, label string, first_word long, last_word long, containment double"
Pair = tuple[bytes, bytes]


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def pairs(tokens: list[bytes]) -> list[Pair]:
    return list(zip(tokens, tokens[1:]))


def needed(size: int, threshold: float) -> int:
    return max(1, ceil(threshold * size - 1e-9))


def stretch(n_pairs: int) -> int:
    """Places of pairs in the longest block for a template of so many."""
    return n_pairs + -(-n_pairs // 4)


@dataclass(frozen=True)
class Template:
    label: str
    ranks: tuple[int, ...]  # distinct pairs, rarest first
    need: int
    reach: int


class Scanner:
    """Templates against texts; ``order`` lists the templates' pairs from the rarest on."""

    def __init__(self, templates: dict[str, list[str]], threshold: float, order: list[Pair], phrases: dict[str, str] = PHRASES):
        self.rank = {p: i for i, p in enumerate(order)}
        self.templates, self.prefix, self.of = [], {}, {}
        for label, texts in sorted(templates.items()):
            for text in texts:
                all_ = pairs(words(text.encode()))
                ranks = tuple(sorted({self.rank[p] for p in all_}))
                self.templates.append(Template(label, ranks, needed(len(ranks), threshold), stretch(len(all_))))
        for t, x in enumerate(self.templates):
            for r in x.ranks[: len(x.ranks) - x.need + 1]:
                self.prefix.setdefault(r, []).append(t)
            for r in x.ranks:
                self.of.setdefault(r, []).append(t)
        self.rare = frozenset(p for p, r in self.rank.items() if r in self.prefix)
        self.phrases = [(b" " + b" ".join(words(p.encode())) + b" ", label) for p, label in phrases.items()]

    def blocks(self, tokens: list[bytes]) -> Iterator[tuple[str, int, int, float]]:
        """(label, first word, last word, containment) of blocks that meet a template: the fullest one first, then the fullest of those that do not touch it, and so on.

        Not those that overlap one of another label that holds as many pairs and a greater share of its template.
        """
        here = pairs(tokens)
        if self.rare.isdisjoint(here):
            return
        rank = self.rank
        held = [(i, rank[p]) for i, p in enumerate(here) if p in rank]
        candidates = {t for _, r in held for t in self.prefix.get(r, ())}
        places: dict[int, list[tuple[int, int]]] = {t: [] for t in candidates}
        for i, r in held:
            for t in self.of[r]:
                if t in candidates:
                    places[t].append((i, r))
        found = []
        for t in sorted(candidates):
            x, at = self.templates[t], places[t]
            if len(at) < x.need:
                continue
            prefix = set(x.ranks[: len(x.ranks) - x.need + 1])
            rare = [i for i, r in at if r in prefix]
            inside: dict[int, int] = {}
            stop = 0
            for start, (i, r) in enumerate(at):  # the stretch from each place on, its pairs counted as it moves
                while stop < len(at) and at[stop][0] < i + x.reach:
                    inside[at[stop][1]] = inside.get(at[stop][1], 0) + 1
                    stop += 1
                near = bisect_left(rare, i)
                if stop - start >= x.need and near < len(rare) and rare[near] < i + x.reach and len(inside) >= x.need:
                    found.append((i, at[stop - 1][0] + 1, len(inside), len(inside) / len(x.ranks), t))
                inside[r] -= 1
                if not inside[r]:
                    del inside[r]
        found.sort()
        label = [self.templates[x[4]].label for x in found]
        starts, longest = [x[0] for x in found], max((b - a for a, b, *_ in found), default=0)
        taken: dict[int, list[tuple[int, int]]] = {}
        stay = []
        for i, (a, b, n, share, t) in enumerate(found):
            near = range(bisect_left(starts, a - longest), bisect_left(starts, b + 1))
            if not any(label[j] != label[i] and found[j][1] >= a and found[j][2] >= n and found[j][3] > share for j in near):
                stay.append((t, -n, a, b, share))
        for t, _, a, b, share in sorted(stay):
            if all(b < c or d < a for c, d in taken.get(t, ())):
                taken.setdefault(t, []).append((a, b))
                yield self.templates[t].label, a, b, share

    def places(self, tokens: list[bytes]) -> list[tuple[int, str]]:
        """Word numbers at which the words of a phrase stand one behind the other, with the phrase's label."""
        joined = b" " + b" ".join(tokens) + b" "
        out = []
        for phrase, label in self.phrases:
            at = joined.find(phrase)
            while at >= 0:
                out.append((joined.count(b" ", 0, at), label))
                at = joined.find(phrase, at + 1)
        return out


def frequency_order(df: DataFrame, vocabulary: set[Pair], text_col: str = "text") -> list[Pair]:
    """The vocabulary from the rarest to the most frequent pair of the corpus; one row a pair comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = dict.fromkeys(vocabulary, 0)
        for part in slices(batches, column=0):
            for text in raw(part.column(0)):
                for p in pairs(words(text)):
                    if p in counts:
                        counts[p] += 1
        found = [(b" ".join(p), n) for p, n in counts.items() if n]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], names=["pair", "n"])

    rows = df.select(F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, "pair binary, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    counts = {tuple(bytes(r["pair"]).split()): r["n"] for r in rows}
    return sorted(vocabulary, key=lambda p: (counts.get(p, 0), p))


def scanner(df: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD, text_col: str = "text") -> Scanner:
    vocabulary = {p for texts in templates.values() for t in texts for p in pairs(words(t.encode()))}
    return Scanner(templates, threshold, frequency_order(df, vocabulary, text_col))


def scan(df: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: words, phrase places, labels of phrases and of met templates, and the greatest containment."""
    using = scanner(df, templates, threshold, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for text in raw(part.column(1)):
                tokens = words(text)
                places = using.places(tokens)
                met = list(using.blocks(tokens))
                base = {label for _, label in places}
                score = 1.0 if places else max((x[3] for x in met), default=0.0)
                at = [i for i, _ in places]
                rows.append((len(tokens), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x[0] for x in met})), score))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), k) for c, k in zip(zip(*rows), kinds))], names=[x.split()[0] for x in SCAN.split(", ")])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, SCAN)


def blocks(df: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each block that meets a template: id, label, first and last word, containment."""
    using = scanner(df, templates, threshold, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [(doc, *x) for doc, text in zip(part.column(0).to_pylist(), raw(part.column(1))) for x in using.blocks(words(text))]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in BLOCKS.split(", ")])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, BLOCKS)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


def oracle(templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD, phrases: dict[str, str] = PHRASES) -> str:
    """The same in DuckDB SQL: every stretch from each place of a template's pair on is counted, without filters."""
    quoted = lambda x: "'" + x + "'"
    rows, sizes = [], []
    for label, texts in sorted(templates.items()):
        for i, text in enumerate(texts):
            all_ = pairs(words(text.encode()))
            distinct, name = sorted(set(all_)), f"{label}/{i}"
            sizes.append(f"({quoted(name)}, {quoted(label)}, {len(distinct)}, {needed(len(distinct), threshold)}, {stretch(len(all_))})")
            rows += [f"({quoted(name)}, {quoted(b' '.join(p).decode())})" for p in distinct]
    said = ", ".join(f"({quoted(' '.join(w.decode() for w in words(p.encode())))}, {quoted(label)}, {len(words(p.encode()))})" for p, label in phrases.items())
    return f"""
    WITH t(name, label, size, need, reach) AS (VALUES {", ".join(sizes)}),
    v(name, pair) AS (VALUES {", ".join(rows)}),
    s(phrase, label, n) AS (VALUES {said}),
    d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    e AS (SELECT k, w, unnest(range(len(w))) AS i FROM d),
    b AS (SELECT k, i, label FROM e JOIN s ON array_to_string(w[i + 1 : i + n], ' ') = phrase),
    base AS (SELECT k, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY k),
    h AS (SELECT k, name, i, pair FROM (SELECT k, i, w[i + 1] || ' ' || w[i + 2] AS pair FROM e WHERE i + 1 < len(w)) JOIN v USING (pair)),
    o AS (SELECT k, name FROM h JOIN t USING (name) GROUP BY k, name HAVING count(DISTINCT pair) >= any_value(need)),
    m AS (SELECT a.k, a.name, a.i, max(z.i) + 1 AS j, count(DISTINCT z.pair) AS n FROM h a SEMI JOIN o USING (k, name) JOIN t USING (name)
          JOIN h z ON z.k = a.k AND z.name = a.name AND z.i >= a.i AND z.i < a.i + reach GROUP BY a.k, a.name, a.i),
    x AS (SELECT k, label, i, j, n, n / size AS share FROM m JOIN t USING (name) WHERE n >= need),
    met AS (SELECT k, label, share FROM x WHERE NOT EXISTS (
            SELECT 1 FROM x y WHERE y.k = x.k AND y.label <> x.label AND y.i <= x.j AND y.j >= x.i AND y.n >= x.n AND y.share > x.share)),
    every AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT k, label FROM b UNION ALL SELECT k, label FROM met) GROUP BY k),
    top AS (SELECT k, max(share) AS share FROM met GROUP BY k)
    SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
           CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
    FROM d LEFT JOIN base USING (k) LEFT JOIN every USING (k) LEFT JOIN top USING (k)
    """
