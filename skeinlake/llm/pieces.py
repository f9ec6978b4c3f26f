"""SentencePiece encoding and decoding for merge-type vocabularies.

``PieceCodec`` merges adjacent symbol pairs from an agenda ordered by piece score (ties: leftmost).
No piece of such a vocabulary crosses from another character into the space mark (checked when the
model is loaded), so a text is the concatenation of its space-led chunks; a worker remembers the ids
of the chunks it has met in a bounded table.  Every chunk that the agenda encodes is compared with the
sentencepiece library in the same Arrow slice; a difference stops the job.

Defined results: a null text is encoded as empty (no ids); repeated rows are encoded row by row; an
empty table gives an empty result; characters outside the vocabulary fall back to byte pieces; other
columns of the input are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlake.llm.common import slices, table_path

SPACE = "▁"
NO_PLACE = 2**31 - 1
#: Distinct chunks that a worker remembers; beyond it only those of the slice at hand stay.
MEMO = 250_000
#: Symbols of a chunk up to which its agenda is a row of an array, above a heap; rows of an array.
SHORT, ROWS = 48, 8192
#: Slots of a pair table and its hash multipliers.
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
HASHES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.vocab: dict[str, float] = {}  # piece -> minus its score
        self.ids: dict[str, int] = {}
        self.bytes = [lib.unk_id()] * 256
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (lib.is_unknown(i) or lib.is_control(i) or lib.is_unused(i)):
                self.vocab[piece], self.ids[piece] = -lib.get_score(i), i
        if any(SPACE in piece.lstrip(SPACE) for piece in self.vocab):
            raise ValueError(f"{path}: a piece has a space mark behind another character")
        if lib.encode("a ") != [*lib.encode("a"), self.ids[SPACE]] or lib.decode(lib.encode("  a  b")) != "  a  b":
            raise ValueError(f"{path}: the model's normalizer changes white space")
        self.memo: dict[str, int] = {}  # chunk -> its place in the two columns below
        self.memo_ends, self.memo_ids = np.zeros(1, np.int64), np.zeros(0, np.int32)
        written = [f"{i},".encode() for i in range(lib.get_piece_size())]
        self.digits = np.frombuffer(b"".join(written), np.uint8)
        self.digits_n = np.array([len(x) for x in written])
        self.digits_at = np.cumsum(self.digits_n) - self.digits_n
        self._pair_table()

    def _pair_table(self) -> None:
        """Adjacent pairs whose joined symbol is a piece: a hash table by (left id, right id) with the pair's place in score order and joined id."""
        ids = self.ids
        order = {score: place for place, score in enumerate(sorted(set(self.vocab.values())))}
        left, right, place, joined = [], [], [], []
        for piece, score in self.vocab.items():
            for cut in range(1, len(piece)):
                a, b = ids.get(piece[:cut]), ids.get(piece[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    place.append(order[score])
                    joined.append(ids[piece])
        keys = np.array(left, np.int64) << 20 | np.array(right, np.int64)
        self.slots: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rest, place_, joined_ = keys, np.array(place, np.int32), np.array(joined, np.int32)
        for turn in range(len(HASHES)):  # what finds its slot taken goes to the next table
            table = np.full(SLOTS, -1, np.int64)
            at = self._slot(rest, turn)
            first = np.unique(at, return_index=True)[1]
            table[at[first]] = rest[first]
            places, joins = np.full(SLOTS, NO_PLACE, np.int32), np.zeros(SLOTS, np.int32)
            places[at[first]], joins[at[first]] = place_[first], joined_[first]
            self.slots.append((table, places, joins))
            more = np.ones(len(rest), bool)
            more[first] = False
            rest, place_, joined_ = rest[more], place_[more], joined_[more]
            if not len(rest):
                break
        if len(rest):
            raise ValueError("the pair table is too small for this vocabulary")
        self.char_ids = np.full(0x110000, -1, np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.char_ids[ord(piece)] = i

    @staticmethod
    def _slot(keys: np.ndarray, turn: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(HASHES[turn])) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in score order (NO_PLACE: not a piece) and joined id of pairs of symbols."""
        keys = left.astype(np.int64) << 20 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        place, joined = np.full(keys.shape, NO_PLACE, np.int32), np.zeros(keys.shape, np.int32)
        for turn, (table, places, joins) in enumerate(self.slots):
            at = self._slot(keys, turn)
            hit = table[at] == keys
            place[hit], joined[hit] = places[at[hit]], joins[at[hit]]
        return place, joined

    def merged_many(self, chunks: list[str]) -> list[list[int]]:
        """Ids of many chunks of up to SHORT symbols: one agenda row a chunk, all best pairs (ties: leftmost) merged at once."""
        sizes = np.array([len(c) for c in chunks])
        width = int(sizes.max())
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = np.full((len(chunks), width + 1), -1, np.int32)
        filled = np.arange(width + 1) < sizes[:, None]
        symbols[filled] = np.where((known := self.char_ids[codes]) >= 0, known, -2 - codes.astype(np.int32))
        agenda, joins = np.full((len(chunks), width), NO_PLACE, np.int32), np.zeros((len(chunks), width), np.int32)
        both = filled[:, 1:]
        agenda[both], joins[both] = self.pairs(symbols[:, :-1][both], symbols[:, 1:][both])
        live = np.arange(len(chunks))
        columns = np.arange(width)
        out = np.full((len(chunks), width), -1, np.int32)
        while len(live):
            best = agenda.argmin(axis=1)
            rows = np.arange(len(live))
            done = agenda[rows, best] == NO_PLACE
            if done.any():
                out[live[done]] = symbols[done, :width]
                left = ~done
                live, best, symbols, agenda, joins = live[left], best[left], symbols[left], agenda[left], joins[left]
                rows = np.arange(len(live))
                if not len(live):
                    break
            behind = columns > best[:, None]
            symbols[rows, best] = joins[rows, best]
            symbols[:, :-1] = np.where(behind, symbols[:, 1:], symbols[:, :-1])[:, :] if width else symbols[:, :-1]
            symbols[:, -1] = -1
            behind = columns[:-1] >= best[:, None]
            agenda[:, :-1] = np.where(behind, agenda[:, 1:], agenda[:, :-1])
            joins[:, :-1] = np.where(behind, joins[:, 1:], joins[:, :-1])
            agenda[:, -1] = NO_PLACE
            agenda[rows, best], joins[rows, best] = self.pairs(symbols[rows, best], symbols[rows, best + 1])
            inner = best > 0
            at, b = rows[inner], best[inner] - 1
            agenda[at, b], joins[at, b] = self.pairs(symbols[at, b], symbols[at, b + 1])
        kept = out != -1
        ends = np.cumsum(kept.sum(axis=1)).tolist()
        flat = out[kept].tolist()
        found = [flat[a:b] for a, b in zip([0, *ends], ends)]
        for i in np.nonzero((out < -1).any(axis=1))[0].tolist():  # symbols outside the vocabulary
            found[i] = [y for x in found[i] for y in ([x] if x >= 0 else [self.bytes[z] for z in chr(-2 - x).encode()])]
        return found

    def merged_long(self, chunk: str) -> list[str]:
        """Pieces of a chunk of any length: pop the best-scored adjacent pair from a heap, merge, push the pairs it now forms."""
        vocab, symbols = self.vocab, list(chunk)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        pairs: list[tuple[float, int, int, str]] = []
        for i in range(n - 1):
            joined = symbols[i] + symbols[i + 1]
            if joined in vocab:
                pairs.append((vocab[joined], i, i + 1, joined))
        heapq.heapify(pairs)
        while pairs:
            _, a, b, joined = heapq.heappop(pairs)
            if not symbols[a] or right[a] != b or len(symbols[a]) + len(symbols[b]) != len(joined):
                continue  # one of the two has been merged meanwhile
            symbols[a], symbols[b] = joined, ""
            c = right[a] = right[b]
            if c < n:
                left[c] = a
                more = joined + symbols[c]
                if more in vocab:
                    heapq.heappush(pairs, (vocab[more], a, c, more))
            c = left[a]
            if c >= 0:
                more = symbols[c] + joined
                if more in vocab:
                    heapq.heappush(pairs, (vocab[more], c, a, more))
        return [x for x in symbols if x]

    def agenda(self, chunks: list[str]) -> list[list[int]]:
        """Ids of marked chunks; those of about the same length share an array."""
        out: list[list[int]] = [[]] * len(chunks)
        short = sorted((len(c), i) for i, c in enumerate(chunks) if len(c) <= SHORT)
        at = 0
        while at < len(short):
            end = at
            while end < len(short) and end - at < ROWS and short[end][0] <= short[at][0] + 3:
                end += 1
            some = [i for _, i in short[at:end]]
            for i, ids in zip(some, self.merged_many([chunks[i] for i in some])):
                out[i] = ids
            at = end
        for i, c in enumerate(chunks):
            if len(c) > SHORT:
                out[i] = [y for x in self.merged_long(c) for y in ([self.ids[x]] if x in self.ids else [self.bytes[z] for z in x.encode()])]
        return out

    def chunks(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct chunks of texts, the chunk of each place, and places per text.

        A text, led by a space mark, is cut before each mark that follows another character.  A chunk is kept
        without the first of its marks, so that words cut at single spaces are chunks as they are.
        """
        marked = pa.array([t.replace(SPACE, " ") for t in texts], pa.string())
        lists = pc.split_pattern(marked, " ")
        for i, t in enumerate(texts):
            if not t or "  " in t or t[0] == " " or t[-1] == " " or SPACE in t:
                break
        else:
            coded = lists.flatten().dictionary_encode()
            return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.diff(lists.offsets.to_numpy())
        out, sizes = [], []
        for t in marked.to_pylist():
            before = len(out)
            words, marks = t.split(" ") if t else [], ""
            for word in words:
                if word:
                    out.append(marks + word)
                    marks = ""
                else:
                    marks += " "
            if marks:
                out.append(marks[:-1])
            sizes.append(len(out) - before)
        coded = pa.array(out, pa.string()).dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.array(sizes, np.int64)

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and ids per text."""
        distinct, places, sizes = self.chunks(texts)
        memo = self.memo
        at = np.fromiter((memo.get(c, -1) for c in distinct), np.int64, len(distinct))
        missing = np.nonzero(at < 0)[0]
        if len(memo) + len(missing) > MEMO:
            known = np.nonzero(at >= 0)[0]
            ids, lengths = self.recall(at[known])
            self.memo = memo = {distinct[i]: k for k, i in enumerate(known.tolist())}
            self.memo_ends, self.memo_ids = np.r_[0, np.cumsum(lengths)], ids
            at[known] = np.arange(len(known))
        if len(missing):
            new = [distinct[i] for i in missing.tolist()]
            found = self.agenda([SPACE + c.replace(" ", SPACE) for c in new])
            self.compare(new, found)
            sizes_ = np.fromiter(map(len, found), np.int64, len(found))
            at[missing] = np.arange(len(new)) + len(memo)
            memo.update(zip(new, range(len(memo), len(memo) + len(new))))
            self.memo_ids = np.r_[self.memo_ids, np.fromiter(chain.from_iterable(found), np.int32, int(sizes_.sum()))]
            self.memo_ends = np.r_[self.memo_ends, self.memo_ends[-1] + np.cumsum(sizes_)]
        ids, lengths = self.recall(at[places])
        reach = np.r_[0, np.cumsum(lengths)][np.r_[0, np.cumsum(sizes)]]
        return ids, np.diff(reach)

    def recall(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of remembered chunks end to end, and ids per chunk."""
        starts = self.memo_ends[at]
        lengths = self.memo_ends[at + 1] - starts
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.memo_ids[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)], lengths

    def joined(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Decimal ids of each text joined by commas."""
        lengths = self.digits_n[ids]
        ends = np.cumsum(lengths)
        data = self.digits[np.repeat(self.digits_at[ids] - (ends - lengths), lengths) + np.arange(int(lengths.sum()))].tobytes()
        cuts = np.r_[0, ends][np.r_[0, np.cumsum(sizes)]].tolist()
        return [data[a : max(a, b - 1)] for a, b in zip(cuts, cuts[1:])]

    def compare(self, new: list[str], ids_of: list[list[int]]) -> None:
        """The library on the same chunks: joined by spaces, those of nothing but spaces one by one (a lone mark has no text of its own)."""
        own = dict(zip(new, ids_of))
        plain = [c for c in new if c.strip(" ")]
        groups = [plain[at : at + 500] for at in range(0, len(plain), 500)] + [[c] for c in new if c and not c.strip(" ")]
        found = self.library.encode([" ".join(g) for g in groups], num_threads=1)
        for group, ids in zip(groups, found):
            if ids != list(chain.from_iterable([own[c] for c in group])):
                for c in group:
                    if self.library.encode(c) != own[c]:
                        raise ValueError(f"the agenda and the library differ on {c!r}")
                raise ValueError(f"the agenda and the library differ on a group of {len(group)} chunks")

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, sizes = self.encode_flat(texts)
        ends = np.cumsum(sizes).tolist()
        flat = ids.tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1) if ids else []


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One per worker process; workers are used again for later tasks."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
        gc.collect()
        gc.freeze()
        gc.set_threshold(100_000, 50, 1000)  # the table of chunks holds many small lists and no cycles
    return _CODECS[path]


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(df: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and the piece ids of its text."""
    path = model or table_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=1 << 20):
            ids = codec(path).encode([x or "" for x in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _rows(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and the text of its piece ids; null ids decode to the empty text."""
    path = model or table_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=1 << 20):
            texts = codec(path).decode([x or [] for x in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(df: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text in one Arrow pass; per row: id, number of ids and digests of ids and decoded text."""
    path = model or table_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        own = codec(path)
        for part in slices(batches, most=2 << 20):
            texts = [x or "" for x in part.column(1).to_pylist()]
            ids, sizes = own.encode_flat(texts)
            ends = np.cumsum(sizes).tolist()
            decoded = own.decode([ids[a:b].tolist() for a, b in zip([0, *ends], ends)])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array([sha(x).hexdigest() for x in own.joined(ids, sizes)]),
                    pa.array([sha(x.encode()).hexdigest() for x in decoded]),
                    pa.array([a == b for a, b in zip(texts, decoded)], pa.bool_()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"],
            )

    return _rows(df, id_col, text_col).mapInArrow(run, DIGESTS)
