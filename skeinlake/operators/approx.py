"""Estimates of whole-table aggregates from a sample, and their error against exact results.

COUNT and SUM are scaled by rows-in-table / rows-in-sample, AVG is the sample's mean, MAX and MIN are the
sample's extreme or mean ± 3 standard deviations, whichever lies further out; strings stay as observed.
Scaling holds for a bare scan with or without grouping; behind a filter or join it is off unless
``scale_filters`` asks for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinlake.operators.stats import TableStats, collect_stats

AGGREGATES = ("count", "sum", "avg", "min", "max")
INTEGRAL = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
EXTREME_SIGMAS = 3.0


def estimator(kind: str, column: str | None, stats: TableStats, integral: bool = False, scaled: bool = True, spread: bool = True) -> Column:
    """The estimating expression of one aggregate."""
    if kind not in AGGREGATES:
        raise ValueError(f"{kind} is none of {AGGREGATES}")
    factor = stats.n_hat / stats.n if scaled and stats.n else 1.0
    x = F.lit(1) if column in (None, "*") else F.col(f"`{column}`")
    known = stats.columns.get(column or "")
    if kind == "count":
        return F.floor(F.count(x) * F.lit(factor)).cast("long")
    if kind == "sum":
        out = F.sum(x) * F.lit(factor if known else 1.0)
        return F.floor(out).cast("long") if integral else out
    if kind == "avg":
        return F.avg(x)
    observed = F.max(x) if kind == "max" else F.min(x)
    if not (scaled and spread and known):
        return observed
    reach = EXTREME_SIGMAS * known.std
    bound = F.lit(known.mean + reach if kind == "max" else known.mean - reach)
    out = (F.greatest if kind == "max" else F.least)(observed.cast("double"), bound)
    return out.cast("long") if integral else out


@dataclass
class SampledRelation:
    """A sample with what is known of its table; ``bare`` falls once it is filtered or joined."""

    df: DataFrame
    stats: TableStats
    bare: bool = True
    scale_filters: bool = False
    keys: tuple = ()

    @classmethod
    def of(cls, sample: DataFrame, n_hat: int, stats: TableStats | None = None, **kw) -> SampledRelation:
        stats = stats or collect_stats(sample)
        stats.n_hat = n_hat
        return cls(sample, stats, **kw)

    def _with(self, **kw) -> SampledRelation:
        return SampledRelation(**{**self.__dict__, **kw})

    def filter(self, condition) -> SampledRelation:
        return self._with(df=self.df.filter(condition), bare=False)

    def join(self, other: DataFrame, on, how: str = "inner") -> SampledRelation:
        return self._with(df=self.df.join(other, on, how), bare=False)

    def group_by(self, *keys) -> SampledRelation:
        return self._with(keys=keys)

    def agg(self, spread: bool = True, **wanted: tuple[str, str | None]) -> DataFrame:
        """``alias=(aggregate, column)``; estimates in one grouped aggregate."""
        kinds = {f.name: f.dataType for f in self.df.schema}
        scaled = self.bare or self.scale_filters
        out = [
            estimator(kind, column, self.stats, isinstance(kinds.get(column or ""), INTEGRAL), scaled, spread and self.bare).alias(alias)
            for alias, (kind, column) in wanted.items()
        ]
        return self.df.groupBy(*self.keys).agg(*out) if self.keys else self.df.agg(*out)

    def standard_error(self, column: str) -> DataFrame:
        """Extension: standard error of AVG, with the correction for a finite table."""
        left = max(0.0, 1 - self.stats.n / self.stats.n_hat) if self.stats.n_hat else 1.0
        x = F.col(f"`{column}`")
        return self.df.groupBy(*self.keys).agg((F.stddev_samp(x) / F.sqrt(F.count(x)) * F.lit(left**0.5)).alias("standard_error"))


def percent_error(estimate: Column, exact: Column) -> Column:
    """Absolute error in percent; NULL where the exact value is 0."""
    return F.abs(F.try_divide(estimate - exact, exact)) * 100


def mean_percent_error(estimates: DataFrame, exact: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean absolute percent error over the groups that both have."""
    both = exact.select(*keys, F.col(value).alias("__exact")).join(estimates.select(*keys, F.col(value).alias("__estimate")), keys)
    return both.agg(F.avg(percent_error(F.col("__estimate"), F.col("__exact"))).alias("mape"), F.count("*").alias("n_groups"))


def trial_means(trials: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """Per group, the mean of a value over repeated trials."""
    whole = trials[0]
    for t in trials[1:]:
        whole = whole.unionByName(t)
    return whole.groupBy(*keys).agg(F.avg(value).alias(value), F.count("*").alias("n_trials"))
