"""Language-model scoring by deleted interpolation of n-gram estimates.

P(w | h) = l2 c(h w) / c(h) + l1 c(w) / N + l0 / (V + 1), with the three weights chosen by the frequency
bucket of the context h.  The weights come from expectation-maximisation on a fold that is deleted from
the counts meanwhile; scores then use the counts of all training documents.

No table of n-grams is sent around.  Documents are packed into batches of tokens, written once.  Each
batch asks for the counts of its distinct words and word pairs, sorted and dealt by hash range; one task
a range adds the counts of all batches and answers each in the order it asked; the answers meet the
batch again.  A word or pair goes to its range once a batch however often it occurs, so frequent ones do
not weigh on a task, and what is shuffled is packed bytes rather than rows.

Rows of the exchange are batches times ranges.  For them to stay few beside the tokens, a batch's tokens and
a range's pairs both grow as the root of the corpus, sqrt(256 tokens) where that is above the least: a terabyte
of text has some 6 million tokens a batch, and the rows are a 256th of the tokens at any size.  A task holds
one batch or one range at a time, so beyond ``MOST`` tokens, which 12 TB of text reach, they stay at it and
the rows grow faster than the tokens; raise it with the executors' memory.

Words are lower-cased A-Z and cut at ASCII white space; one end token follows each text and counts as a
token.  Words and pairs are told apart by 64-bit hashes.

Defined results: a null text is empty (one token, the end); a null id is folded as the empty string;
repeated rows are separate documents; without training documents only the uniform part remains; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlake.llm.common import keep, raw, read_table, shuffle_partitions, slices
from skeinlake.llm.suffixes import mix

# Folds by crc32 of the id; the one held out from everything and the one deleted for the weights.
FOLDS, HELD_OUT, DELETED = 7, 2, 3
MAIN, WEIGHTS, OUT = 0, 1, 2  # uses of a document
START, END = np.uint64(2), np.uint64(3)
BATCH = 1_000_000  # tokens of a batch, and pairs that are asked of a range, at least
MOST = 24_000_000  # and at most
BYTES_A_TOKEN = 6  # for the first guess
CONTEXT_BUCKETS = 48  # octaves of a context's frequency, 10 ** 14 and more
#: EM reads the deleted fold as a histogram: a context bucket by quarter octaves of both estimates, with their means.
CELLS_2, CELLS_1 = 160, 200
ROUNDS = 100
WORDS, PAIRS = 0, 1
MEMO = 200_000

PACKED = "batch long, part int, n_docs long, n_tokens long, docs binary, sizes binary, words binary, tokens binary"
ASKED = "range long, kind int, batch long, part int, keys binary, counts binary"
ANSWERED = "kind int, range long, batch long, part int, total binary, main binary, vocabulary long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def fold(doc: int | None) -> int:
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % FOLDS


def use(doc: int | None) -> int:
    f = fold(doc)
    return OUT if f == HELD_OUT else WEIGHTS if f == DELETED else MAIN


def pack(x: np.ndarray) -> bytes:
    """Bytes of a number column, plane by plane, compressed."""
    x = np.ascontiguousarray(x)
    return zlib.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def packed_batches(docs: DataFrame, most: int = BATCH) -> DataFrame:
    """Rows of up to about ``most`` tokens of documents with the same use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        one = xxhash.xxh64_intdigest
        known: dict[bytes, int] = {}
        held: dict[int, list] = {MAIN: [], WEIGHTS: [], OUT: []}
        size = dict.fromkeys(held, 0)
        number = TaskContext.get().partitionId() << 32

        def out(part: int) -> pa.RecordBatch:
            nonlocal number
            rows, number = held[part], number + 1
            words, tokens = np.unique(np.concatenate([h for _, h in rows]), return_inverse=True)
            ids = np.array([0 if d is None else d for d, _ in rows], np.int64)
            known_ids = np.array([d is not None for d, _ in rows], np.int64)
            sizes = np.array([len(h) for _, h in rows], np.uint32)
            row = (number, part, len(rows), int(sizes.sum()), pack(np.r_[ids, known_ids]), pack(sizes), pack_sorted(words), pack(tokens.reshape(-1).astype(np.uint32)))
            held[part], size[part] = [], 0
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=[x.split()[0] for x in PACKED.split(", ")])

        for piece in slices(batches, most=4 << 20):
            for doc, text in zip(piece.column(0).to_pylist(), raw(piece.column(1))):
                words = text.lower().split()
                if len(known) > MEMO:
                    known.clear()
                for w in set(words).difference(known):
                    known[w] = max(4, one(w))
                hashes = np.array([*[known[w] for w in words], int(END)], np.uint64)
                part = use(doc)
                held[part].append((doc, hashes))
                size[part] += len(hashes)
                if size[part] >= most:
                    yield out(part)
        for part in held:
            if held[part]:
                yield out(part)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, PACKED)


@dataclass
class Batch:
    """A batch read back: token words, pair keys and where documents start."""

    words: np.ndarray
    tokens: np.ndarray
    sizes: np.ndarray

    def __post_init__(self):
        self.starts = np.cumsum(self.sizes) - self.sizes
        previous = np.r_[START, self.words[self.tokens[:-1]]]
        previous[self.starts] = START
        self.keys = mix(mix(previous) * np.uint64(0x9E3779B97F4A7C15) + self.words[self.tokens])
        self.keys[self.keys == 0] = 1

    @classmethod
    def read(cls, words: bytes, tokens: bytes, sizes: bytes) -> Batch:
        return cls(unpack_sorted(words), unpack(tokens, np.uint32).astype(np.int64), unpack(sizes, np.uint32).astype(np.int64))


def asked(packed: DataFrame, ranges: int) -> DataFrame:
    """Each batch's distinct words and pairs with their counts in it, by hash range."""
    edges = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in batches:
            for number, part, words, tokens, sizes in zip(*(piece.column(i).to_pylist() for i in range(5))):
                b = Batch.read(words, tokens, sizes)
                rows = []
                word_counts = np.bincount(b.tokens, minlength=len(b.words))
                pairs, pair_counts = np.unique(b.keys, return_counts=True)
                starts = np.array([START], np.uint64)
                for kind, keys, counts in ((WORDS, np.r_[starts, b.words], np.r_[len(b.sizes), word_counts]), (PAIRS, pairs, pair_counts)):
                    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                        if hi > lo:
                            rows.append((i * 2 + kind, kind, number, part, pack_sorted(keys[lo:hi]), pack(counts[lo:hi].astype(np.uint32))))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in ASKED.split(", ")])

    return packed.select("batch", "part", "words", "tokens", "sizes").mapInArrow(run, ASKED)


def answered(requests: DataFrame) -> DataFrame:
    """Counts of every asked word and pair over all training batches, and over those not deleted, in the order asked."""

    def add(table: pa.Table) -> pa.Table:
        kind, number, part = (table.column(x).to_pylist() for x in ("kind", "batch", "part"))
        keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
        counts = [unpack(x, np.uint32) for x in table.column("counts").to_pylist()]
        sizes = [len(k) for k in keys]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        place = place.reshape(-1)
        per = np.repeat(np.array(part), sizes)
        flat = np.concatenate(counts).astype(np.float64)
        main = np.bincount(place, weights=flat * (per == MAIN), minlength=len(distinct)).astype(np.uint64)
        total = main + np.bincount(place, weights=flat * (per == WEIGHTS), minlength=len(distinct)).astype(np.uint64)
        vocabulary = int(((total > 0) & (distinct != START)).sum()) if kind[0] == WORDS else 0
        at, rows = 0, []
        for k, n, p, size in zip(kind, number, part, sizes):
            mine = place[at : at + size]
            at += size
            rows.append((k, table.column("range")[0].as_py(), n, p, pack(total[mine]), pack(main[mine]) if p == WEIGHTS else None, vocabulary))
            vocabulary = 0
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in ANSWERED.split(", ")])

    return requests.groupBy("range").applyInArrow(add, ANSWERED)


def context_bucket(count: np.ndarray) -> np.ndarray:
    """Octave of the context's frequency; 0 for contexts not seen."""
    out = np.zeros(len(count), np.int64)
    seen = count > 0
    out[seen] = np.minimum(CONTEXT_BUCKETS - 1, 1 + np.floor(np.log2(count[seen].astype(np.float64))).astype(np.int64))
    return out


def estimates(b: Batch, words: np.ndarray, pairs: np.ndarray, n_tokens: float) -> tuple[np.ndarray, ...]:
    """Per token: context bucket, pair estimate, word estimate, word count; counts in the order the batch asked for them."""
    starts, words = words[0], words[1:]
    count = words[b.tokens].astype(np.float64)
    context = np.r_[0.0, count[:-1]]
    context[b.starts] = float(starts)
    _, place = np.unique(b.keys, return_inverse=True)
    pair = pairs[place.reshape(-1)].astype(np.float64)
    p2 = np.divide(pair, context, out=np.zeros_like(pair), where=context > 0)
    return context_bucket(context), p2, count / n_tokens if n_tokens else np.zeros_like(count), count


def fit(bucket: np.ndarray, p2: np.ndarray, p1: np.ndarray, p0: float, n: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (l0, l1, l2) of each context bucket by expectation-maximisation on cells with their token counts.

    A bucket without tokens takes the weights of all tokens together; one token's worth of these is added to each.
    """

    def em(rows: np.ndarray, weights: np.ndarray, prior: np.ndarray) -> np.ndarray:
        for _ in range(rounds):
            parts = np.stack([np.full(rows.sum(), p0), p1[rows], p2[rows]]) * weights[:, None]
            share = (parts / parts.sum(axis=0) * n[rows]).sum(axis=1) + prior
            weights = share / share.sum()
        return weights

    flat = np.full(3, 1 / 3)
    everything = em(np.ones(len(n), bool), flat, np.full(3, 1e-3)) if len(n) else flat
    out = np.tile(everything, (CONTEXT_BUCKETS, 1))
    for k in range(CONTEXT_BUCKETS):
        if (bucket == k).any():
            out[k] = em(bucket == k, flat, everything)
    return out


def _quarter(p: np.ndarray, cells: int) -> np.ndarray:
    """Quarter octave below 1, from 1 on; 0 for zero."""
    out = np.zeros(len(p), np.int64)
    some = p > 0
    out[some] = np.clip(1 + np.floor(-4 * np.log2(p[some])), 1, cells - 1).astype(np.int64)
    return out


@dataclass
class Model:
    packed: DataFrame
    answers: DataFrame
    n_train: int
    vocabulary: int
    weights: np.ndarray
    batches: int

    def meet(self, part: int | None = None) -> DataFrame:
        return _meet(self.packed, self.answers, self.batches, part)


def _meet(packed: DataFrame, answers: DataFrame, batches: int, part: int | None = None) -> DataFrame:
    """Batches with their answers."""
    if part is not None:
        packed, answers = packed.filter(F.col("part") == part), answers.filter(F.col("part") == part)
    n = max(shuffle_partitions(packed.sparkSession), batches)  # a task a batch
    lists = answers.repartition(n, "batch").groupBy("batch").agg(F.collect_list(F.struct("kind", "range", "total", "main")).alias("answers"))
    return packed.repartition(n, "batch").join(lists, "batch").select("words", "tokens", "sizes", "docs", "part", "answers")


def _counts(answers: list[dict], field: str) -> tuple[np.ndarray, np.ndarray]:
    ordered = sorted(answers, key=lambda x: x["range"])
    words, pairs = ([unpack(x[field], np.uint64) for x in ordered if x["kind"] == kind] for kind in (WORDS, PAIRS))
    return np.concatenate(words), np.concatenate(pairs)


def batch_tokens(tokens: int, least: int = BATCH, most: int = MOST) -> int:
    """Tokens of a batch, and pairs asked of a range, for a corpus of so many."""
    return max(least, min(most, isqrt(256 * tokens)))


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: int | None = None) -> Model:
    """Pack and count the corpus, then learn the weights on the deleted fold."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if batch is None:
        guess = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))) / BYTES_A_TOKEN + F.count("*")).first()[0]
        batch = batch_tokens(int(guess or 0))
    packed = keep(packed_batches(docs, batch), "lm-packed")
    size = packed.agg(F.sum("n_tokens").alias("all"), F.sum(F.when(F.col("part") != OUT, F.col("n_tokens"))).alias("train"), F.sum(F.when(F.col("part") == MAIN, F.col("n_tokens"))).alias("main"), F.count("*").alias("n")).first()
    ranges = max(shuffle_partitions(spark), -(-(size["all"] or 0) // batch))
    answers = keep(answered(asked(packed, ranges).repartition(ranges, "range")), "lm-answers")  # a task a range, however many
    vocabulary = answers.agg(F.sum("vocabulary")).first()[0] or 0
    n_main, p0 = float(size["main"] or 0), 1.0 / (vocabulary + 1)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in batches:
            for words, tokens, sizes, answers_ in zip(*(piece.column(i).to_pylist() for i in (0, 1, 2, 5))):
                bucket, p2, p1, _ = estimates(Batch.read(words, tokens, sizes), *_counts(answers_, "main"), n_main)
                cell, place = np.unique((bucket * CELLS_2 + _quarter(p2, CELLS_2)) * CELLS_1 + _quarter(p1, CELLS_1), return_inverse=True)
                place = place.reshape(-1)
                sums = [np.bincount(place, weights=x, minlength=len(cell)) for x in (np.ones_like(p2), p2, p1)]
                yield pa.RecordBatch.from_arrays([pa.array(cell), *map(pa.array, sums)], names=["cell", "n", "p2", "p1"])

    table = _meet(packed, answers, size["n"], WEIGHTS).mapInArrow(cells, "cell long, n double, p2 double, p1 double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1")).orderBy("cell").collect()
    cell, n, p2, p1 = (np.array([r[c] for r in table]) for c in ("cell", "n", "p2", "p1"))
    weights = fit(cell // (CELLS_1 * CELLS_2), p2 / n, p1 / n, p0, n) if len(table) else fit(*(np.zeros(0) for _ in range(3)), p0, np.zeros(0))
    return Model(packed, answers, int(size["train"] or 0), vocabulary, weights, size["n"])


def score(model: Model) -> DataFrame:
    """Per document: tokens, known tokens, and its log10 probability under add-one unigrams and under the model."""
    n_train, vocabulary, weights = model.n_train, model.vocabulary, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in batches:
            for words, tokens, sizes, docs, part, answers in zip(*(piece.column(i).to_pylist() for i in range(6))):
                b = Batch.read(words, tokens, sizes)
                bucket, p2, p1, count = estimates(b, *_counts(answers, "total"), float(n_train))
                p = weights[bucket, 0] / (vocabulary + 1) + weights[bucket, 1] * p1 + weights[bucket, 2] * p2
                base = np.log10((count + 1) / (n_train + vocabulary + 1))
                ids, known_ids = unpack(docs, np.int64).reshape(2, -1)
                out = [
                    pa.array(ids, mask=known_ids == 0),
                    pa.array(np.full(len(ids), part == OUT)),
                    pa.array(b.sizes),
                    pa.array(np.add.reduceat((count > 0).astype(np.int64), b.starts)),
                    pa.array(np.full(len(ids), n_train, np.int64)),
                    pa.array(np.add.reduceat(base, b.starts)),
                    pa.array(np.add.reduceat(np.log10(p), b.starts)),
                ]
                yield pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in SCORES.split(", ")])

    return model.meet().mapInArrow(run, SCORES)


def query(spark, sf_dir: str) -> DataFrame:
    return score(learn(read_table(spark, sf_dir, "documents")))
