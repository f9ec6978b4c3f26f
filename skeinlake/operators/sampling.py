"""Sampling as an access path: each round adds a further share of a table, rounds never overlap.

``random``        rows whose hash bucket is below round x rate
``contiguous``    the next rows in file order, as ranges of row positions that reach the Parquet scan
``random_start``  a contiguous run from a seeded start, wrapping once at the end
``outlier``       rows within mean ± sigma deviations, then ``random``
``all``           every row

Tables with fewer than ``SMALL`` rows are read whole in every mode, so that joins with them lose nothing.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlake.operators.stats import TableStats, collect_stats, within_sigma
from skeinlake.sources.shared import fresh

MODES = ("all", "random", "contiguous", "random_start", "outlier")
BUCKETS = 10_000
#: Tables with fewer rows are read whole.
SMALL = 1000


@dataclass(frozen=True)
class SamplePlan:
    mode: str = "all"
    rate: float = 0.01
    round: int = 1
    seed: int = 42
    sigma: float = 2.0

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode {self.mode!r} is none of {MODES}")
        if not 0 < self.rate <= 1 or self.round < 1:
            raise ValueError("rate lies in (0, 1] and rounds start at 1")

    def advanced(self) -> SamplePlan:
        return replace(self, round=self.round + 1)

    @property
    def share(self) -> float:
        return min(1.0, self.rate * self.round)


# Odd multipliers of the mixing below, under 2 ** 32 and under 2 ** 31 so that products of 32-bit numbers fit a long.
MULTIPLIERS = (2654435761, 1597334677)


def spread(row: Column, seed: int) -> Column:
    """32 well-mixed bits of a row position and a seed, in whole-number arithmetic that any engine has."""
    x = ((row + F.lit(seed * 7919)) % F.lit(1 << 31)) * F.lit(MULTIPLIERS[0]) % F.lit(1 << 32)
    x = x.bitwiseXOR(F.shiftright(x, 15))
    x = x % F.lit(1 << 32) * F.lit(MULTIPLIERS[1]) % F.lit(1 << 32)
    return x.bitwiseXOR(F.shiftright(x, 13))


def spread_sql(row: str, seed: int) -> str:
    """``spread`` as SQL text of bigint arithmetic."""
    x = f"((({row} + {seed * 7919}) % {1 << 31}) * {MULTIPLIERS[0]} % {1 << 32})"
    x = f"(xor({x}, {x} >> 15) * {MULTIPLIERS[1]} % {1 << 32})"
    return f"xor({x}, {x} >> 13)"


def position(df: DataFrame) -> Column:
    """A number for each row of a file table: its place in the file, moved by a hash of the name where there are several files."""
    row = F.col("_metadata.row_index")
    return row if len(df.inputFiles()) < 2 else row + F.crc32(F.col("_metadata.file_path").cast("binary")) * F.lit(65_537)


def bucket(df: DataFrame, seed: int) -> Column:
    return spread(position(df), seed) % F.lit(BUCKETS)


def file_counts(df: DataFrame) -> list[tuple[str, int]]:
    """Rows of each file in path order; no column is read, the counts come from the files' footers."""
    rows = df.select(F.col("_metadata.file_path").alias("f")).groupBy("f").agg(F.count("*").alias("n")).collect()
    return sorted((r["f"], r["n"]) for r in rows)


def _range(counts: list[tuple[str, int]], start: int, stop: int) -> Column:
    """Rows [start, stop) of the files laid end to end: full files by name, the two at the ends by position."""
    out, at = F.lit(False), 0
    for name, n in counts:
        lo, hi = max(start - at, 0), min(stop - at, n)
        if lo < hi:
            here = (F.col("_metadata.file_path") == name) if len(counts) > 1 else F.lit(True)
            if lo > 0:
                here = here & (F.col("_metadata.row_index") >= lo)
            if hi < n:
                here = here & (F.col("_metadata.row_index") < hi)
            out = here if out is None else out | here
        at += n
    return out


def _laid_out(df: DataFrame, pieces: list[tuple[int, int]]) -> DataFrame:
    """Rows of several ranges of the files laid end to end."""
    counts = file_counts(df)
    return df.filter(reduce(lambda a, b: a | b, [_range(counts, a, b) for a, b in pieces if a < b], F.lit(False)))


def sample(df: DataFrame, plan: SamplePlan, stats: TableStats | None = None, n_rows: int | None = None) -> DataFrame:
    """The rows of rounds 1 … ``plan.round`` of a file table (one read by ``spark.read``)."""
    return between(df, plan, 0, plan.round, stats, n_rows)


def between(df: DataFrame, plan: SamplePlan, done: int, upto: int, stats: TableStats | None = None, n_rows: int | None = None) -> DataFrame:
    """The rows that rounds ``done`` + 1 … ``upto`` add to those before; all of a small table in the first."""
    if plan.mode == "all":
        return df
    total = df.count() if n_rows is None else n_rows  # from Parquet footers
    if total < SMALL:
        return df if not done else df.limit(0)
    low, high = min(1.0, plan.rate * done), min(1.0, plan.rate * upto)
    if plan.mode in ("random", "outlier"):
        at = bucket(df, plan.seed)
        picked = df if not done and high >= 1 else df.filter((at >= int(low * BUCKETS)) & (at < int(high * BUCKETS)))
        return picked if plan.mode == "random" else within_sigma(picked, stats or collect_stats(df), plan.sigma)
    if not done and high >= 1:
        return df
    reached = [-(-int(total * share * 1_000_000) // 1_000_000) for share in (low, high)]
    start = zlib.crc32(str(plan.seed).encode()) % total if plan.mode == "random_start" else 0
    first, last = start + reached[0], start + reached[1]
    return _laid_out(df, [(first, min(last, total)), (max(0, first - total), last - total)])


def sample_by_key(df: DataFrame, key: Column, plan: SamplePlan, buckets: int = 100) -> DataFrame:
    """``random`` by a key expression that any engine can compute: rows with key mod buckets below the round."""
    return df.filter(F.pmod(key, F.lit(buckets)) < int(round(plan.share * buckets)))


def contiguous_by_order(df: DataFrame, order: list[str], start: int, k: int, n_rows: int | None = None) -> DataFrame:
    """Rows [start, start + k) in the order of ``order``, on from the first row past the last of the ``n_rows``, if they are given.

    The sort is written to the shared folder, a file a range of the order, and the rows are read by their places
    in the files: an offset or a limit would bring ``start + k`` rows, or ``k`` of each task, to one task.
    """
    path = fresh(df.sparkSession, "ordered")
    df.orderBy(*order).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    wrapped = 0 if n_rows is None else max(0, start + k - n_rows)
    return _laid_out(out, [(start, start + k - wrapped), (0, wrapped)])


def fixed_size(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """``k`` rows picked uniformly: top ``k`` by a seeded hash of position."""
    at = position(df)
    return df.select("*", spread(at, seed).alias("__at"), at.alias("__row")).orderBy("__at", "__row").limit(k).drop("__at", "__row")


def stratified(df: DataFrame, column: str, fractions: dict, seed: int = 42) -> DataFrame:
    """True stratification: a share of each stratum."""
    return df.sampleBy(column, fractions, seed)
