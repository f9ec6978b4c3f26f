"""Quality classifier by co-training a text view and a metadata view.

Two logistic models see different columns: the text view words, word beginnings and the surface of the
text, the metadata view source, language and length.  Both are fitted on labelled documents and calibrated;
then every other document is scored by both, each view hands the other those of which it is confident, with
its labels, and both are fitted again.  The views' calibrated log odds are combined by a third small model
fitted on rows that neither was trained on.  The same is done for two labels, quality and toxic; a document is
kept if it is likely of quality and not toxic.

What is fitted on is bounded, what is looked at is not.  Labelled documents are drawn by a hash of the id, up
to ``LABELLED`` in equal shares from each pair of labels, so that a rare label is not thinned out; the odds are put
right for that afterwards.  In an exchange all documents outside that sample are scored in one pass over the
table, the confident ones are counted in full, and of each view, label and class up to ``EXCHANGED`` are drawn by
hash to fit on; the pseudo-labels of a view together weigh no more than the labels.  Slots are chosen by how far
their share of a class stands out of what chance does among so many slots.  Scoring covers every document in
one Arrow pass with a weight table of at most ``FEATURES`` a view and label.

Defined results: null or empty text has no word features; null metadata is a value of its own; without
labels of both kinds a label's probability is its share among the labels (one half without any), and
nothing is rejected for toxicity without toxic labels; repeated rows are scored row by row; labels of the
same id count each; labels without a document, and null labels, say nothing; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlake.llm.common import keep, raw, read_table, slices

LABELLED, EXCHANGED, FEATURES = 10_000, 500, 2_048
#: Sampled documents that must have a slot for it to be looked at.
LEAST_SEEN = 3
ROUNDS, CONFIDENT = 2, 0.97  # fits, with an exchange between one and the next
TARGETS = ("quality", "toxic")
METADATA = ("lang", "source", "n_chars")
SPACE = 1 << 24
BEGINNING = 5
HELD = 0.3  # share of the labelled rows for calibration and combination
MEMO_BYTES = 32 << 20  # of words whose slots a worker remembers
AT_ONCE = 1 << 18  # features looked at together on the driver

SAMPLED = "id long, quality double, toxic double, weight double, given array<double>, text array<int>, surface array<double>, meta array<int>"
SCORED = "doc_id long, quality double, toxic double, text_quality double, meta_quality double, text_toxic double, meta_toxic double, keep boolean"
N_SURFACE = 7


def slot(name: bytes) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(name) & (SPACE - 1)


def surface(text: bytes, words: list[bytes], distinct: int) -> list[float]:
    """Shares of words that are upper case, end in doubled signs, are a lone sign, repeat the one before; richness, length, letters a word."""
    n = len(words)
    if not n:
        return [0.0] * N_SURFACE
    upper = sum(map(bytes.isupper, words)) / n
    doubled = sum([w[-1:] == w[-2:-1] and not w[-1:].isalnum() and w[-1] < 128 for w in words]) / n
    lone = sum([len(w) == 1 and not w.isalnum() and w[0] < 128 for w in words]) / n
    again = sum(map(eq, words, words[1:])) / n
    rich = np.log(distinct + 1) / np.log(n + 1)
    return [upper, doubled, lone, again, float(rich), float(np.log10(n + 1)) / 5, min(len(text) / n, 30.0) / 30]


def word_sets(text: bytes) -> tuple[list[bytes], set[bytes], set[bytes]]:
    words = text.split()
    low = set(text.lower().split())
    return words, low, {w[:BEGINNING] for w in low}


def text_slots(low: set[bytes], beginnings: set[bytes]) -> list[int]:
    return sorted({slot(b"w" + w) for w in low} | {slot(b"b" + w) for w in beginnings})


def meta_slots(lang: str | None, source: str | None, n_chars: int | None) -> list[int]:
    length = "none" if n_chars is None else str(int(n_chars).bit_length())
    names = [f"l{lang}", f"s{source}", f"n{length}", f"x{lang}/{source}", f"y{lang}/{length}"]
    return sorted({slot(x.encode()) for x in names})


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def among(slots: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``index`` are among the sorted slots, and the place of each there."""
    place = np.clip(np.searchsorted(slots, index), 0, len(slots) - 1)
    return slots[place] == index, place


@dataclass
class Rows:
    """Sparse binary features by row, with dense ones beside them."""

    index: np.ndarray
    row: np.ndarray
    dense: np.ndarray
    slots: np.ndarray | None = None  # those of ``index``, sorted

    def __post_init__(self):
        if self.slots is None:
            self.slots = np.unique(self.index)

    @classmethod
    def of(cls, lists: pa.Array, dense: np.ndarray) -> Rows:
        """Without the slots of fewer than ``LEAST_SEEN`` rows, which are most of them."""
        sizes, index = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
        slots, seen = np.unique(index, return_counts=True)
        slots = slots[seen >= LEAST_SEEN]
        if not len(slots):
            return cls(np.zeros(0, np.int32), np.zeros(0, np.int32), dense)
        kept_ = np.concatenate([among(slots, index[at : at + AT_ONCE])[0] for at in range(0, len(index), AT_ONCE)])
        return cls(index[kept_], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[kept_], dense, slots)

    def __len__(self):
        return len(self.dense)

    def found(self, slots: np.ndarray, use: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, place in ``slots``) of the features whose slot is there, in rows in use, a stretch at a time: the driver's memory holds no second copy of all."""
        for at in range(0, len(self.index) if len(slots) else 0, AT_ONCE):
            row = self.row[at : at + AT_ONCE]
            hit, place = among(slots, self.index[at : at + AT_ONCE])
            if use is not None:
                hit &= use[row]
            yield row[hit], place[hit]

    def entries(self, slots: np.ndarray, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``found`` in one."""
        parts = [(np.zeros(0, np.int32), np.zeros(0, np.int64)), *self.found(slots, use)]
        return np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])


@dataclass
class View:
    """A logistic model over chosen slots and dense features, with its calibration."""

    slots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    dense: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    def margin(self, x: Rows) -> np.ndarray:
        out = self.bias + (x.dense @ self.dense if x.dense.shape[1] else 0.0)
        if len(self.slots):
            row, place = x.entries(self.slots)
            out = out + np.bincount(row, weights=self.weights[place], minlength=len(x))
        return out + np.zeros(len(x))

    def log_odds(self, x: Rows) -> np.ndarray:
        return self.scale * self.margin(x) + self.shift


def choose(x: Rows, y: np.ndarray, use: np.ndarray, most: int = FEATURES) -> np.ndarray:
    """Slots whose presence tells the classes apart best: deviations of their share of a class from the class's share, beyond what the largest of so many would reach by chance."""
    slots = x.slots
    pos, n = np.zeros(len(slots)), np.zeros(len(slots), np.int64)
    for row, place in x.found(slots, use):
        pos += np.bincount(place, weights=y[row], minlength=len(slots))
        n += np.bincount(place, minlength=len(slots))
    rows, positive = max(1, use.sum()), y[use].sum()
    share = positive / rows
    z = np.abs(pos - n * share) / np.sqrt(n * max(share * (1 - share), 1e-9) + 1)
    seen = n >= LEAST_SEEN
    z[~seen] = 0
    telling = np.sqrt(2 * np.log(max(2, seen.sum()))) + 0.5
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(slots[best[z[best] > telling]])


def logistic(x: Rows, y: np.ndarray, use: np.ndarray, slots: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1.0, dense_penalty: float = 0.05, steps: int = 150) -> View:
    """Penalised logistic regression by full-batch adaptive steps; the few dense features are held back less than the slots."""
    row, column = x.entries(slots, use)
    n, d = max(1, use.sum()), x.dense.shape[1]
    weight = level(np.ones(len(x)) if weight is None else weight, use)
    w = np.zeros(len(slots) + d + 1)
    held_back = np.r_[np.full(len(slots), penalty), np.full(d, dense_penalty)]
    m, v = np.zeros_like(w), np.zeros_like(w)
    share = np.clip(np.average(y[use], weights=weight[use]) if use.any() else 0.5, 1e-3, 1 - 1e-3)
    w[-1] = np.log(share / (1 - share))
    for t in range(1, steps + 1):
        p = np.bincount(row, weights=w[column], minlength=len(x)) + x.dense @ w[len(slots) : -1] + w[-1]
        g = np.where(use, weight * (sigmoid(p) - y), 0.0)
        grad = np.r_[np.bincount(column, weights=g[row], minlength=len(slots)), x.dense.T @ g, g.sum()]
        grad[:-1] += held_back * w[:-1]
        grad /= n
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * (1 - t / (steps + 1))
    return View(slots.astype(np.int64), w[: len(slots)], w[len(slots) : -1], float(w[-1]))


def level(weight: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Weights with a mean of 1 over the rows in use."""
    mean = weight[use].mean() if use.any() else 1.0
    return weight / mean if mean > 0 else np.ones_like(weight)


def plain_logistic(features: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Newton's method on a few dense features; the last weight is the intercept."""
    x = np.c_[features, np.ones(len(y))]
    w = np.zeros(x.shape[1])
    w[: x.shape[1] - 1] = 1.0 / max(1, x.shape[1] - 1)
    prior = w.copy()
    for _ in range(30):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + penalty * (w - prior))
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Judge:
    """Both views of one label and their combination; ``constant`` where there was nothing to learn from."""

    text: View = field(default_factory=View)
    meta: View = field(default_factory=View)
    mixing: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0]))
    constant: float | None = None
    exchanged: dict[str, int] = field(default_factory=dict)  # documents that each view handed over


VIEWS = ("text", "meta")


@dataclass
class Trainer:
    """Co-training of one label over rows: ``label`` is NaN where it is not known; ``given`` holds, a view, the labels it was handed (NaN: none)."""

    rows: dict[str, Rows]
    label: np.ndarray
    ids: np.ndarray
    weight: np.ndarray
    given: dict[str, np.ndarray]

    def __post_init__(self):
        known = ~np.isnan(self.label)
        self.y = np.where(known, self.label, 0.0)
        spread = (self.ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        held = known & (spread % 1000 < HELD * 1000)
        apart = held
        if any(len(np.unique(self.y[some])) < 2 for some in (held, known & ~held)):
            held, apart = known, np.zeros_like(known)  # too few rows to set any aside
        self.known, self.held, self.fitted = known, held, known & ~apart

    @property
    def constant(self) -> float | None:
        """The probability where there is nothing to learn from."""
        y = self.y[self.known]
        if len(y) and y.min() < y.max():
            return None
        return float(np.average(y, weights=self.weight[self.known])) if len(y) else 0.5

    def fit(self) -> Judge:
        if self.constant is not None:
            return Judge(constant=self.constant)
        views, y, held = {}, self.y, self.held
        # the drawn rows have more of a rare class than the table; the odds are put right by the difference
        real, drawn = np.average(y[held], weights=self.weight[held]), y[held].mean()
        shift = float(np.log(real / (1 - real)) - np.log(drawn / (1 - drawn))) if 0 < real < 1 else 0.0
        for name, x in self.rows.items():
            got = self.given[name]
            pseudo = ~np.isnan(got) & ~self.known
            target, use = np.where(pseudo, got, y), self.fitted | pseudo
            weight = np.where(pseudo, min(1.0, self.fitted.sum() / max(1, pseudo.sum())), 1.0)
            views[name] = view = logistic(x, target, use, choose(x, target, use), weight)
            w = plain_logistic(view.margin(x)[held][:, None], y[held])
            view.scale, view.shift = float(w[0]), float(w[1]) + shift
        both = np.c_[views["text"].log_odds(self.rows["text"]), views["meta"].log_odds(self.rows["meta"])][held]
        mixing = plain_logistic(both, y[held])
        if mixing[1] < 0:  # the metadata view only repeats the base rate
            alone = plain_logistic(both[:, :1], y[held])
            mixing = np.array([alone[0], 0.0, alone[1]])
        mixing[2] += shift
        return Judge(views["text"], views["meta"], mixing)


def unit(tag: str) -> Column:
    """A fixed number in [0, 1) of the id."""
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit(tag)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def draw_labels(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(doc_id, labels, weight): up to about ``most`` labels, an equal share of them from each pair of labels."""
    have = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(t).cast("double").alias(t) for t in TARGETS]).filter("doc_id is not null")
    strata = [(tuple(r[t] for t in TARGETS), r["count"]) for r in have.groupBy(*TARGETS).count().collect()]  # two labels of two values and null
    if len(strata) > 9:
        raise ValueError("the labels are 0, 1 or null")
    left, share, rate = most, {}, F.lit(0.0)
    for i, (key, n) in enumerate(sorted(strata, key=lambda x: x[1])):
        share[key] = min(1.0, left / (len(strata) - i) / n)
        left -= share[key] * n
        here = reduce(lambda a, b: a & b, [F.col(t).eqNullSafe(F.lit(v).cast("double")) for t, v in zip(TARGETS, key)])
        rate = F.when(here, F.lit(share[key])).otherwise(rate)
    return have.withColumn("weight", F.try_divide(F.lit(1.0), rate)).filter(unit("labelled") < rate)


def featured(rows: DataFrame) -> pa.Table:
    """Features of the drawn rows (doc_id, labels, weight, given, text, metadata), on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column=5):
            text, dense, meta = [], [], []
            for t, lang, source, n in zip(raw(part.column(5)), *(part.column(i).to_pylist() for i in (6, 7, 8))):
                words, low, begin = word_sets(t)
                text.append(text_slots(low, begin))
                dense.append(surface(t, words, len(low)))
                meta.append(meta_slots(lang, source, n))
            lists = [pa.array(x, pa.list_(k)) for x, k in ((text, pa.int32()), (dense, pa.float64()), (meta, pa.int32()))]
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(5)] + lists, names=[x.split()[0] for x in SAMPLED.split(", ")])

    columns = [F.col("text").cast("string").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars")]
    table = rows.select("doc_id", *TARGETS, "weight", "given", *columns).mapInArrow(run, SAMPLED).toArrow()
    return distinct_rows(table) if table.num_rows else table


def distinct_rows(table: pa.Table) -> pa.Table:
    """Each text and label once, by id: copies of a text would make its own words tell its label."""
    seen, first, columns = set(), [], [table.column(c) for c in ("text", "surface", "given", *TARGETS)]
    for i in pc.sort_indices(table, [("id", "ascending")]).to_pylist():
        row = [c[i] for c in columns]
        key = (*(hash(x.values.to_numpy(zero_copy_only=False).tobytes()) for x in row[:2]), str(row[2]), *(x.as_py() for x in row[3:]))
        if key not in seen:
            seen.add(key)
            first.append(i)
    return table.take(first)


def _column(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name)
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def _floats(column: pa.Array) -> np.ndarray:
    return np.array(column.to_numpy(zero_copy_only=False), np.float64)


def trainers(table: pa.Table) -> dict[str, Trainer]:
    dense = _floats(_column(table, "surface").flatten()).reshape(-1, N_SURFACE)
    rows = {"text": Rows.of(_column(table, "text"), dense), "meta": Rows.of(_column(table, "meta"), np.zeros((table.num_rows, 0)))}
    ids, weight = _column(table, "id").to_numpy(zero_copy_only=False), _floats(_column(table, "weight"))
    given = _floats(_column(table, "given").flatten()).reshape(-1, len(TARGETS) * len(VIEWS))
    return {t: Trainer(rows, _floats(_column(table, t)), ids, weight, {v: given[:, 2 * k + i] for i, v in enumerate(VIEWS)}) for k, t in enumerate(TARGETS)}


def exchange(docs: DataFrame, judges: dict[str, Judge], fitted: DataFrame, most: int = EXCHANGED) -> tuple[DataFrame, dict[str, dict[str, int]]]:
    """Rows with pseudo-labels for the next fit, and how many documents each view handed over, by label.

    Every document that is not among the ``fitted`` ones is scored.  A confident view's label goes to the other
    view; of those of one view, label and class up to about ``most`` are drawn by a hash of the id.
    """
    scored = keep(score(docs, judges).select("doc_id", *[f"{v}_{t}" for t in TARGETS for v in VIEWS]).filter("doc_id is not null").join(F.broadcast(fitted.select("doc_id").distinct()), "doc_id", "left_anti"), "co-scores")
    open_ = [(t, v) for t in TARGETS for v in VIEWS if judges[t].constant is None]
    sure = {(t, v, c): (F.col(f"{v}_{t}") >= CONFIDENT) if c else (F.col(f"{v}_{t}") <= 1 - CONFIDENT) for t, v in open_ for c in (0, 1)}
    counts = scored.agg(F.count("*").alias("n"), *[F.count_if(x).alias("_".join(map(str, k))) for k, x in sure.items()]).first()
    n = {k: counts["_".join(map(str, k))] for k in sure}
    drawn = {k: sure[k] & (unit("_".join(map(str, k))) < F.lit(min(1.0, most / max(1, n[k])))) for k in sure}
    given, any_ = [], F.lit(False)
    for t in TARGETS:
        for to in VIEWS:
            v, label = VIEWS[1 - VIEWS.index(to)], F.lit(None).cast("double")
            for c in (0, 1) if (t, v) in open_ else ():
                label, any_ = F.when(drawn[t, v, c], F.lit(float(c))).otherwise(label), any_ | drawn[t, v, c]
            given.append(F.coalesce(label, F.lit(float("nan"))))
    picked = scored.filter(any_).select("doc_id", F.array(*given).alias("given")).dropDuplicates(["doc_id"])
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long")).select("doc_id", "text", *METADATA).join(F.broadcast(picked), "doc_id")
    rows = rows.select("*", F.lit(1.0).alias("weight"), *[F.lit(None).cast("double").alias(t) for t in TARGETS])
    return rows, {t: {v: sum(n.get((t, v, c), 0) for c in (0, 1)) for v in VIEWS} for t in TARGETS}


def learn(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, exchanged: int = EXCHANGED, rounds: int = ROUNDS) -> dict[str, Judge]:
    drawn = draw_labels(labels, labelled)
    none = F.array(*[F.lit(float("nan"))] * (len(TARGETS) * len(VIEWS)))
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long")).select("doc_id", "text", *METADATA).join(F.broadcast(drawn), "doc_id").withColumn("given", none)
    table = featured(rows)
    if not table.num_rows:
        return {t: Judge(constant=0.5) for t in TARGETS}
    judges = {t: x.fit() for t, x in trainers(table).items()}
    for _ in range(rounds - 1):
        if all(j.constant is not None for j in judges.values()):
            break
        more, handed = exchange(docs, judges, drawn, exchanged)
        new = featured(more)
        fits = trainers(pa.concat_tables([table, new.cast(table.schema)]).combine_chunks() if new.num_rows else table)
        judges = {t: x.fit() for t, x in fits.items()}
        for t in TARGETS:
            judges[t].exchanged = handed[t]
    table = new = fits = None  # the driver's memory is free for what comes next
    pa.default_memory_pool().release_unused()
    return judges


class Scorer:
    """Scores Arrow columns (text bytes, lang, source, n_chars) with learned judges."""

    def __init__(self, judges: dict[str, Judge], threshold: float = 0.5):
        self.judges, self.threshold = judges, threshold
        self.text = [dict(zip(judges[t].text.slots.tolist(), judges[t].text.weights.tolist())) for t in TARGETS]
        self.meta = [dict(zip(judges[t].meta.slots.tolist(), judges[t].meta.weights.tolist())) for t in TARGETS]
        self.wanted = set().union(*self.text)
        self.slots_of: dict[bytes, int] = {}
        self.held = 0

    def found(self, names: set[bytes], mark: bytes) -> set[int]:
        """Slots of a text's words that carry a weight; a worker remembers which words do."""
        known, wanted = self.slots_of, self.wanted
        if self.held > MEMO_BYTES:
            known.clear()
            self.held = 0
        out = set()
        for w in names:
            key = mark + w
            s = known.get(key)
            if s is None:
                s = slot(key)
                s = known[key] = s if s in wanted else -1
                self.held += len(key) + 100
            if s >= 0:
                out.add(s)
        return out

    def columns(self, texts: list[bytes], langs: list, sources: list, chars: list) -> dict[str, np.ndarray]:
        n = len(texts)
        margins, dense = np.zeros((n, 2 * len(TARGETS))), np.zeros((n, N_SURFACE))
        for i, (t, lang, source, c) in enumerate(zip(texts, langs, sources, chars)):
            words, low, begin = word_sets(t)
            dense[i] = surface(t, words, len(low))
            on, meta = self.found(low, b"w") | self.found(begin, b"b"), meta_slots(lang, source, c)
            for k in range(len(TARGETS)):
                by_text, by_meta = self.text[k], self.meta[k]
                margins[i, 2 * k] = sum([by_text[s] for s in on if s in by_text])
                margins[i, 2 * k + 1] = sum([by_meta[s] for s in meta if s in by_meta])
        out: dict[str, np.ndarray] = {}
        for k, name in enumerate(TARGETS):
            j = self.judges[name]
            if j.constant is not None:
                out[name] = out[f"text_{name}"] = out[f"meta_{name}"] = np.full(n, j.constant)
                continue
            text = j.text.scale * (margins[:, 2 * k] + dense @ j.text.dense + j.text.bias) + j.text.shift
            meta = j.meta.scale * (margins[:, 2 * k + 1] + j.meta.bias) + j.meta.shift
            out[f"text_{name}"], out[f"meta_{name}"] = sigmoid(text), sigmoid(meta)
            out[name] = sigmoid(j.mixing[0] * text + j.mixing[1] * meta + j.mixing[2])
        good = (out["quality"] >= self.threshold) | (self.judges["quality"].constant is not None)
        clean = (out["toxic"] < self.threshold) | (self.judges["toxic"].constant is not None)
        out["keep"] = good & clean
        return out


def score(docs: DataFrame, judges: dict[str, Judge], threshold: float = 0.5) -> DataFrame:
    """Per row: probabilities of both labels, by view and combined, and whether the row is kept."""
    names = [c.split()[0] for c in SCORED.split(", ")][1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(judges, threshold)
        for part in slices(batches):
            out = scorer.columns(raw(part.column(1)), *(part.column(k).to_pylist() for k in (2, 3, 4)))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(out[c]) for c in names)], names=["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))
    return rows.mapInArrow(run, SCORED)


def kept(docs: DataFrame, judges: dict[str, Judge], threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that the judges keep: one pass, no join."""
    at = [docs.columns.index(c) for c in ("text", *METADATA)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(judges, threshold)
        for part in slices(batches, column=at[0]):
            out = scorer.columns(raw(part.column(at[0])), *(part.column(k).to_pylist() for k in at[1:]))
            yield part.filter(pa.array(out["keep"]))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, learn(docs, read_table(spark, sf_dir, "labels")))
