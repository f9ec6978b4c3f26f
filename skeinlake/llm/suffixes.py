"""Repeated windows by a depth-limited radix sort of suffixes.

A suffix takes part only with its first ``width`` tokens (bytes or words); two suffixes that are equal to
that depth are a repeated window, and every token under one is removed.  The sort goes from the most
significant digit on, and a group of one leaves it at once:

1. The first digit of a window is its minimiser, the ``gram`` tokens with the least hash (leftmost on
   ties), with their place in the window.  Neighbouring windows have the same minimiser, so one row (an
   anchor) stands for a run of windows, about 2 / (width - gram + 2) rows a token.  Minimisers that occur
   once leave the sort: one aggregate and one join on the minimiser.
2. The second digit is the whole stretch under an anchor's run.  Anchors with an equal stretch repeat in
   every window; only one of them goes on, for the others to be compared with.  Equal anchors of one
   slice of texts travel as one row with a list of places, at most a slice's, so that a frequent passage
   makes a row a slice instead of a row an occurrence.  Places go back to their slice, where the spans of a
   document are joined before they are dealt out.
3. What is left is compared window by window: the next digits are 64-bit hashes of the window's first and
   second half, groups of one leaving after each.  Equal groups are the repeated windows.  Minimisers with
   up to ``crowd`` different stretches are sorted within a task; those with more are dealt out as single
   windows and counted by an aggregate, so that no group, whatever its size, meets in one task.

Digits are 64-bit hashes; a window counts as repeated only if all of them agree.

Defined results: a null text counts as empty; texts shorter than the window keep everything; equal texts
of at least the window's length lose everything, repeated rows included; windows never cross rows; an
empty table gives an empty result; other columns are ignored by ``digests`` and kept by ``remove``, whatever
their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlake.llm.common import discard, each_salt, free_name, keep, numbered, parted, raw, read_table, salt_mask, salt_of, shuffle_partitions, slices

WIDTH, WORDS_WIDTH = 400, 50
#: Different stretches of one minimiser that are sorted in one task.
CROWD = 2048
#: Shares that the rows of a frequent stretch or window are dealt into.
SALTS = 32
#: Members sorted together in a task.
MEMBERS = 4096
PLACE_BITS = 20
BUFFER = 1 << PLACE_BITS
#: Tokens hashed at once; each takes about a hundred bytes of a worker's memory.
AT_ONCE = 1 << 18
_FIELD = 12  # bits of a place within a window, in an anchor's packed position

MULTIPLIER = 0x9E3779B97F4A7C15
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

ANCHORS = "minimiser long, stretch long, doc long, pos long, more array<struct<doc: long, pos: long>>, slice long"
DRAWN = "minimiser long, doc long, pos long, tokens binary, half_a long, half_b long, start long"
SPANS = "doc long, first long, last long"
DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the multiplier and of its inverse modulo 2**64, made when first asked for."""

    up = down = None

    @classmethod
    def get(cls) -> tuple[np.ndarray, np.ndarray]:
        if cls.up is None:
            cls.up = np.cumprod(np.r_[np.uint64(1), np.full(BUFFER, MULTIPLIER, np.uint64)])
            cls.down = np.cumprod(np.r_[np.uint64(1), np.full(BUFFER, pow(MULTIPLIER, -1, 1 << 64), np.uint64)])
        return cls.up, cls.down


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIER))


class Hashes:
    """Hashes of any stretch of a token buffer from one running sum.

    ``local`` numbers the tokens of each of several texts laid end to end, for buffers of any length.
    """

    def __init__(self, values: np.ndarray, local: np.ndarray | None = None):
        self.up, down = Powers.get()
        self.local = local
        self.sums = np.r_[np.uint64(0), np.cumsum(values * (down[: len(values)] if local is None else down[local]))]

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.up[start if self.local is None else self.local[start]]


class Tokens:
    """Texts as token values; bytes or words."""

    def __init__(self, unit: str):
        if unit not in ("bytes", "words"):
            raise ValueError(f"unit {unit!r} is neither bytes nor words")
        self.unit = unit
        self.known: dict[bytes, int] = {}

    def stored(self, text: bytes) -> np.ndarray:
        """Tokens as kept in a row: bytes themselves, words as 64-bit hashes."""
        if self.unit == "bytes":
            return np.frombuffer(text, np.uint8)
        import xxhash

        words, known = text.split(), self.known
        if len(known) > 400_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.array([known[w] for w in words], np.uint64)

    def values(self, stored: np.ndarray) -> np.ndarray:
        return BYTE_VALUES[stored] if self.unit == "bytes" else mix(stored)

    @property
    def kind(self) -> type:
        return np.uint8 if self.unit == "bytes" else np.uint64


def slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def runs(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of texts laid end to end: place, first and last window start, minimiser, stretch hash."""
    n = len(values)
    long = stops - starts >= width
    if n < width or not long.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    hashes = Hashes(values)
    at = np.arange(n - gram + 1)
    grams = hashes.of(at, at + gram)
    keys = (mix(grams) >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | at.astype(np.uint64)
    least = slide_min(keys, width - gram + 1)
    inside = np.zeros(n + 2, np.int64)
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, stops[long] - width + 1, -1)
    window = np.nonzero(np.cumsum(inside)[: len(least)] > 0)[0]
    place = (least[window] & np.uint64(BUFFER - 1)).astype(np.int64)
    new = np.r_[True, place[1:] != place[:-1]]
    first = window[new]
    last = window[np.r_[new[1:], True]]
    place = place[new]
    stretch = mix(hashes.of(first, last + width) + mix((place - first).astype(np.uint64) * np.uint64(BUFFER) + (last - first).astype(np.uint64)))
    return place, first, last, mix(grams[place] + np.uint64(1)), stretch


def combined(minimiser: np.ndarray, stretch: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """One row for each minimiser and stretch of a slice: its first place, its further ones as a list (null: none), and one of the slice's documents, the same in all of its rows."""
    slice_ = doc.min() if len(doc) else 0
    order = np.lexsort((stretch, minimiser))
    minimiser, stretch, doc, pos = minimiser[order], stretch[order], doc[order], pos[order]
    new = np.ones(len(order), bool)
    new[1:] = (minimiser[1:] != minimiser[:-1]) | (stretch[1:] != stretch[:-1])
    begin = np.nonzero(new)[0]
    further = np.diff(np.r_[begin, len(order)]) - 1
    values = pa.StructArray.from_arrays([pa.array(doc[~new], pa.int64()), pa.array(pos[~new], pa.int64())], names=["doc", "pos"])
    more = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(further)], pa.int32()), values, mask=pa.array(further == 0))
    heads = [minimiser.view(np.int64), stretch.view(np.int64), doc, pos]
    return pa.RecordBatch.from_arrays([*(pa.array(x[begin], pa.int64()) for x in heads), more, pa.array(np.full(len(begin), slice_), pa.int64())], names=["minimiser", "stretch", "doc", "pos", "more", "slice"])


def joined_spans(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal spans of each document, ``last`` exclusive."""
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    new = np.ones(len(doc), bool)
    number = np.cumsum(np.r_[True, doc[1:] != doc[:-1]][: len(doc)])  # documents one behind the other on one line, so that one running maximum serves all
    room = int(last.max(initial=0)) + 1
    reach = np.maximum.accumulate(last + number * room) - number * room
    new[1:] = (doc[1:] != doc[:-1]) | (first[1:] > reach[:-1])
    begin = np.nonzero(new)[0]
    return doc[begin], first[begin], reach[np.r_[begin[1:], len(doc)] - 1] if len(doc) else last


def places(rows: DataFrame, width: int) -> DataFrame:
    """Spans of rows (slice, doc, pos, more), those of a document joined where they meet: rows of a slice come together, and a passage under many anchors leaves as one span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            more = batch.column(3).flatten()
            doc = np.r_[batch.column(1).to_numpy(), more.field("doc").to_numpy(zero_copy_only=False).astype(np.int64)]
            _, first, last = unpack(np.r_[batch.column(2).to_numpy(), more.field("pos").to_numpy(zero_copy_only=False).astype(np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in joined_spans(doc, first, last + width)], names=["doc", "first", "last"])

    dealt = rows.select("slice", "doc", "pos", "more").repartition(shuffle_partitions(rows.sparkSession), "slice")
    return dealt.sortWithinPartitions("slice").mapInArrow(run, SPANS)


def pieces(lengths: list[int], width: int, most: int = BUFFER) -> Iterator[list[tuple[int, int, int]]]:
    """Buffers of (text, from, to); a text longer than a buffer is cut so that each window lies in one piece."""
    held, room = [], most
    for i, n in enumerate(lengths):
        at = 0
        while n - at >= width:
            size = min(n - at, most)
            if size > room:
                yield held
                held, room = [], most
            held.append((i, at, at + size))
            room -= size
            at = n if at + size == n else at + size - width + 1
    if held:
        yield held


def anchors(docs: DataFrame, unit: str, width: int, gram: int) -> DataFrame:
    """The anchors of every row of (doc, compressed text), equal ones of a slice in one row; positions are in tokens of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(unit)
        for part in slices(batches, most=1 << 20):
            docs_ = part.column(0).to_numpy()
            texts = [tokens.stored(zlib.decompress(t)) for t in part.column(1).to_pylist()]
            found = []
            for buffer in pieces([len(t) for t in texts], width, AT_ONCE):
                sizes = np.array([b - a for _, a, b in buffer])
                stops = np.cumsum(sizes)
                starts = stops - sizes
                values = tokens.values(np.concatenate([texts[i][a:b] for i, a, b in buffer]))
                place, first, last, minimiser, stretch = runs(values, starts, stops, width, gram)
                which = np.searchsorted(stops, place, side="right")
                moved = np.array([a for _, a, _ in buffer])[which] - starts[which]
                pos = (place + moved) << (2 * _FIELD) | (place - last) << _FIELD | (place - first)
                doc = docs_[np.array([i for i, _, _ in buffer])[which]]
                found.append((minimiser, stretch, doc, pos))
            if found:
                yield combined(*map(np.concatenate, zip(*found)))

    return docs.mapInArrow(run, ANCHORS)


def unpack(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, first and last window start of packed positions."""
    place, field = pos >> (2 * _FIELD), (1 << _FIELD) - 1
    return place, place - (pos & field), place - (pos >> _FIELD & field)


def window_halves(hashes: Hashes, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    half = width // 2
    return hashes.of(start, start + half), hashes.of(start + half, start + width)


def repeated(group: np.ndarray, digits: tuple[np.ndarray, ...]) -> np.ndarray:
    """Positions whose group and digits all occur elsewhere too: a pass for each digit, groups of one leave after each."""
    live = np.arange(len(group))
    for digit in digits:
        if not len(live):
            break
        key = mix(group[live] * np.uint64(MULTIPLIER) + digit[live])
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.r_[True, key[1:] != key[:-1]]
        alone = new & np.r_[new[1:], True]
        group = group.copy()
        group[live[order]] = key
        live = live[order][~alone]
    return live


def sort_members(minimiser: np.ndarray, doc: np.ndarray, pos: np.ndarray, stored: list[np.ndarray], tokens: Tokens, width: int) -> tuple[np.ndarray, ...]:
    """Spans (doc, first, last) of windows that members of the same minimiser share."""
    _, first, last = unpack(pos)
    place = pos >> (2 * _FIELD)
    n = last - first + 1
    sizes = np.array([len(x) for x in stored])
    at = np.cumsum(sizes) - sizes
    hashes = Hashes(tokens.values(np.concatenate(stored)), np.arange(sizes.sum()) - np.repeat(at, sizes))
    member = np.repeat(np.arange(len(n)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    group = mix(minimiser[member].view(np.uint64)) + (place - first)[member].astype(np.uint64) - offset.astype(np.uint64)
    live = np.sort(repeated(group, window_halves(hashes, at[member] + offset, width)))
    if not len(live):
        return live, live, live
    new = np.r_[True, (np.diff(live) > 1) | (member[live][1:] != member[live][:-1])]
    begin, end = live[new], live[np.r_[new[1:], True]]
    m = member[begin]
    return doc[m], first[m] + offset[begin], first[m] + offset[end] + width


def compare(drawn: DataFrame, unit: str, width: int) -> DataFrame:
    """Spans of the members drawn for sorting within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, held = Tokens(unit), []

        def out(rows):
            minimiser, doc, pos = (np.array([r[i] for r in rows], np.int64) for i in range(3))
            spans = sort_members(minimiser, doc, pos, [np.frombuffer(r[3], tokens.kind) for r in rows], tokens, width)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in spans], names=["doc", "first", "last"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if len(held) >= MEMBERS and held[-1][0] != row[0]:
                    yield out(held)
                    held = []
                held.append(row)
        if held:
            yield out(held)

    rows = drawn.filter("tokens is not null").select("minimiser", "doc", "pos", "tokens")
    return rows.repartition(shuffle_partitions(drawn.sparkSession), "minimiser").sortWithinPartitions("minimiser").mapInArrow(run, SPANS)


def draw(docs: DataFrame, wanted: DataFrame, unit: str, width: int) -> DataFrame:
    """For each wanted anchor the tokens under its run, or its single windows' digits where it is crowded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(unit)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in DRAWN.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for doc, text, wants in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                stored = tokens.stored(zlib.decompress(text))
                for want in {(w["minimiser"], w["pos"], w["crowded"]) for w in wants}:
                    place, first, last = (int(x) for x in unpack(np.array(want[1])))
                    under = stored[first : last + width]
                    if not want[2]:
                        rows.append((want[0], doc, want[1], under.tobytes(), None, None, None))
                        continue
                    offset = np.arange(last - first + 1)
                    a, b = window_halves(Hashes(tokens.values(under)), offset, width)
                    salt = mix(np.array([want[0]], np.int64).view(np.uint64)) + (place - first - offset).astype(np.uint64)
                    rows += [(None, doc, None, None, x, y, s) for x, y, s in zip(mix(a + salt).view(np.int64).tolist(), b.view(np.int64).tolist(), (first + offset).tolist())]
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
                    rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("minimiser", "pos", "crowded")).alias("wants"))
    return docs.join(lists, "doc").select("doc", "text", "wants").mapInArrow(run, DRAWN)


def packed(docs: DataFrame) -> DataFrame:
    """The column ``text`` compressed, null as empty; other columns as they are."""
    names = docs.columns
    docs = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for part in slices(batches, column=at):
            small = pa.array([zlib.compress(t, 1) for t in raw(part.column(at))], pa.binary())
            yield pa.RecordBatch.from_arrays([small if i == at else part.column(i) for i in range(len(names))], names=names)

    return docs.mapInArrow(run, docs.schema)


def spans(docs: DataFrame, unit: str = "bytes", width: int = WIDTH, gram: int | None = None, crowd: int = CROWD) -> DataFrame:
    """(doc, list of (first, last)) of the tokens under repeated windows, for rows (doc, compressed text) with distinct ``doc``; lists may overlap."""
    gram = gram or max(1, width // (12 if unit == "bytes" else 6))
    if not 1 <= gram <= width < 1 << _FIELD:
        raise ValueError(f"the window has 1 to {(1 << _FIELD) - 1} tokens and its minimiser no more")
    salt = salt_of(F.col("doc"), SALTS).alias("salt")
    every = keep(anchors(docs, unit, width, gram).select("*", salt), "suffix-anchors")
    # a minimiser or class knows which salts its rows have, so that it meets them salt by salt and no task holds all rows of a frequent one
    number = F.when(F.col("more").isNull(), 1).otherwise(1 + F.size("more"))
    twice = every.groupBy("minimiser").agg(F.sum(number).alias("n"), salt_mask(F.col("salt")).alias("salts")).filter("n > 1").select("minimiser", each_salt(F.col("salts"), SALTS).alias("salt"))
    some = keep(every.join(twice, ["minimiser", "salt"]).select("minimiser", "stretch", "doc", "pos", "more", "slice", "salt"), "suffix-candidates")
    classes = keep(some.groupBy("minimiser", "stretch").agg(F.sum(number).alias("n"), F.min(F.struct("doc", "pos")).alias("one"), salt_mask(F.col("salt")).alias("salts")), "suffix-classes")
    whole = some.join(classes.filter("n > 1").select("minimiser", "stretch", each_salt(F.col("salts"), SALTS).alias("salt")), ["minimiser", "stretch", "salt"])
    shared = classes.withColumn("share", salt_of(F.col("stretch"), SALTS))
    per = shared.groupBy("minimiser").agg(F.count("*").alias("stretches"), salt_mask(F.col("share")).alias("shares")).filter("stretches > 1").select("minimiser", "stretches", each_salt(F.col("shares"), SALTS).alias("share"))
    wanted = shared.join(per, ["minimiser", "share"]).select("minimiser", F.col("one.doc").alias("doc"), F.col("one.pos").alias("pos"), (F.col("stretches") > crowd).alias("crowded"))
    drawn = keep(draw(docs, wanted, unit, width), "suffix-drawn")
    single = drawn.filter("tokens is null").select("half_a", "half_b", "doc", "start", salt)
    again = single.groupBy("half_a", "half_b").agg(F.count("*").alias("n"), salt_mask(F.col("salt")).alias("salts")).filter("n > 1")
    again = keep(again.select("half_a", "half_b", each_salt(F.col("salts"), SALTS).alias("salt")), "suffix-crowded")
    crowded = single.join(again, ["half_a", "half_b", "salt"]).select("doc", F.col("start").alias("first"), (F.col("start") + width).alias("last"))
    found = places(whole, width).unionByName(compare(drawn, unit, width)).unionByName(crowded)
    out = keep(found.groupBy("doc").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "suffix-spans")
    discard(every, some, classes, drawn, again)
    return out


def merge(found: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal spans in order."""
    out: list[list[int]] = []
    for a, b in sorted((x["first"], x["last"]) for x in found or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def kept_bytes(text: bytes, cut: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in cut:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def whole_characters(text: bytes, cut: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans drawn in so that no character is cut."""
    out = []
    for a, b in cut:
        while a < b and a < len(text) and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def word_spans(text: bytes, cut: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans of spans of words."""
    if not cut:
        return []
    places = [m.span() for m in WORD.finditer(text)]
    return [(places[a][0], places[b - 1][1]) for a, b in cut]


def digests(df: DataFrame, width: int = WIDTH, gram: int | None = None, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, bytes, bytes removed, maximal removed spans, a digest of the bytes that stay, and the text that stays.

    The digest is of the bytes exactly; in the text a character stays whole if one of its bytes stays.
    """
    docs = numbered(packed(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))), "suffix-docs", "doc")
    found = spans(docs.select("doc", "text"), "bytes", width, gram, crowd)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=1 << 20):
            rows = []
            for small, spans_ in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                whole, cut = zlib.decompress(small), merge(spans_)
                stays = kept_bytes(whole, cut)
                text = stays if whole.isascii() or not cut else kept_bytes(whole, whole_characters(whole, cut))
                rows.append((len(whole), sum(b - a for a, b in cut), len(cut), hashlib.sha256(stays).hexdigest(), text.decode()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=[x.split()[0] for x in DIGESTS.split(", ")])

    joined = docs.join(found, "doc", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, DIGESTS)


def remove(df: DataFrame, unit: str = "words", width: int | None = None, gram: int | None = None, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with the tokens under repeated windows cut out of their text; null texts stay null."""
    width = width or (WORDS_WIDTH if unit == "words" else WIDTH)
    number, held = free_name(df, "number"), free_name(df, "spans")
    rows = numbered(df, "suffix-rows", number)
    docs = keep(packed(rows.select(F.col(number).alias("doc"), F.col(text_col).alias("text"))), "suffix-docs")
    found = spans(docs, unit, width, gram, crowd)
    discard(docs)
    found = found.select(F.col("doc").alias(number), F.col("spans").alias(held))
    asked, others = parted(rows, number, found, "suffix-marks")

    @F.pandas_udf("string")
    def cut_out(texts, found_):
        out = []
        for t, spans_ in zip(texts, found_):
            if t is None or spans_ is None or not len(spans_):
                out.append(t)
                continue
            b = t.encode()
            cut = merge(list(spans_))
            out.append(kept_bytes(b, word_spans(b, cut) if unit == "words" else whole_characters(b, cut)).decode("utf-8", "replace"))
        return pd.Series(out, dtype=object)

    cut = asked.join(found, number, "left").withColumn(text_col, cut_out(F.col(text_col), F.col(held)))
    return cut.select(*df.columns).unionByName(others.withColumn(text_col, F.col(text_col).cast("string")).select(*df.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))


def oracle(width: int = WIDTH) -> str:
    """The same in DuckDB SQL: a digest of every window of every text, cut from pieces of a window's length and their successors."""
    lead = lambda at: f"CASE WHEN substr(h, 2 * ({at}) + 1, 1) IN ('8', '9', 'A', 'B') THEN 0 ELSE 1 END"
    ahead = f"CASE WHEN {lead('a')} = 1 THEN 0 WHEN {lead('a + 1')} = 1 THEN 1 WHEN {lead('a + 2')} = 1 THEN 2 ELSE 3 END"
    back = f"CASE WHEN {lead('b')} = 1 THEN 0 WHEN {lead('b - 1')} = 1 THEN 1 WHEN {lead('b - 2')} = 1 THEN 2 ELSE 3 END"
    between = "string_agg(substr(h, 2 * coalesce(past, 0) + 1, 2 * ({a} - coalesce(past, 0))), '' ORDER BY {a}) || substr(any_value(h), 2 * max({b}) + 1)"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
    c AS (SELECT k, n, unnest(range(n // {width} + 1)) AS j, h FROM d WHERE n >= {width}),
    p AS (SELECT k, n, j, substr(h, {2 * width} * j + 1, {4 * width}) AS piece FROM c),
    o AS (SELECT k, n, j, piece, unnest(range({width})) AS i FROM p),
    w AS (SELECT k, j * {width} + i AS s, md5_number(substr(piece, 2 * i + 1, {2 * width})) AS m FROM o WHERE j * {width} + i + {width} <= n),
    r AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
    u AS (SELECT k, s, CASE WHEN s > lag(s) OVER (PARTITION BY k ORDER BY s) + {width} THEN 1 ELSE 0 END AS new FROM w SEMI JOIN r USING (m)),
    g AS (SELECT k, s, sum(new) OVER (PARTITION BY k ORDER BY s) AS span FROM u),
    x AS (SELECT k, span, min(s) AS a, max(s) + {width} AS b FROM g GROUP BY k, span),
    e AS (SELECT k, a, b, lag(b) OVER (PARTITION BY k ORDER BY a) AS past, h FROM x JOIN d USING (k)),
    kept AS (SELECT k, sum(b - a) AS n_removed, count(*) AS n_spans, {between.format(a="a", b="b")} AS kept_hex FROM e GROUP BY k),
    z AS (SELECT k, h, a + {ahead} AS a, b - CASE WHEN 2 * b >= length(h) THEN 0 ELSE {back} END AS b FROM e),
    y AS (SELECT k, h, a, b, lag(b) OVER (PARTITION BY k ORDER BY a) AS past FROM z WHERE a < b),
    texts AS (SELECT k, {between.format(a="a", b="b")} AS text_hex FROM y GROUP BY k)
    SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
           sha256(unhex(coalesce(kept_hex, h))) AS kept_sha256, decode(unhex(coalesce(text_hex, h))) AS text
    FROM d LEFT JOIN kept USING (k) LEFT JOIN texts USING (k)
    """
