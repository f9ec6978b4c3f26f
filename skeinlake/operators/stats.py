"""Column statistics in one pass, merged over rounds, kept as JSON beside a table."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class ColumnStats:
    mean: float = 0.0
    m2: float = 0.0
    n: int = 0

    @property
    def std(self) -> float:
        """Population standard deviation."""
        return math.sqrt(self.m2 / self.n) if self.n else 0.0

    def merge(self, other: ColumnStats) -> ColumnStats:
        """Mean and squared deviations of both parts together."""
        n = self.n + other.n
        if not n:
            return ColumnStats()
        delta = other.mean - self.mean
        return ColumnStats(self.mean + delta * other.n / n, self.m2 + other.m2 + delta * delta * self.n * other.n / n, n)


@dataclass
class TableStats:
    n: int = 0
    n_hat: int = 0
    round: int = 0
    columns: dict[str, ColumnStats] = field(default_factory=dict)

    def merge(self, other: TableStats) -> TableStats:
        names = [*self.columns, *(c for c in other.columns if c not in self.columns)]
        merged = {c: self.columns.get(c, ColumnStats()).merge(other.columns.get(c, ColumnStats())) for c in names}
        return TableStats(self.n + other.n, max(self.n_hat, other.n_hat), max(self.round, other.round), merged)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> TableStats:
        read = json.loads(text)
        return cls(read["n"], read["n_hat"], read["round"], {k: ColumnStats(**v) for k, v in read["columns"].items()})


def save_stats(spark: SparkSession, stats: TableStats, path: str) -> None:
    """One small text file beside the table, through Spark's file system."""
    spark.createDataFrame([(stats.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_stats(spark: SparkSession, path: str) -> TableStats:
    return TableStats.from_json(spark.read.text(path).first()[0])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def collect_stats(df: DataFrame, columns: list[str] | None = None) -> TableStats:
    """One aggregate over the scan: count, mean and squared deviations of each numeric column."""
    names = numeric_columns(df) if columns is None else columns
    parts = [F.count("*").alias("n")]
    for i, c in enumerate(names):
        x = F.col(f"`{c}`").cast("double")
        parts += [F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}"), F.count(x).alias(f"c{i}")]
    row = df.agg(*parts).first()
    columns_ = {c: ColumnStats(row[f"m{i}"] or 0.0, (row[f"v{i}"] or 0.0) * row[f"c{i}"], row[f"c{i}"]) for i, c in enumerate(names)}
    return TableStats(row["n"], row["n"], 0, columns_)


def stats_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The same as rows (column, n, mean, std, m2), in one pass: all columns as a map of named doubles, exploded after aggregation."""
    names = numeric_columns(df) if columns is None else columns
    parts = []
    for c in names:
        x = F.col(f"`{c}`").cast("double")
        parts.append(F.struct(F.lit(c).alias("column_name"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), (F.var_pop(x) * F.count(x)).alias("m2")))
    return df.agg(F.array(*parts).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def within_sigma(df: DataFrame, stats: TableStats, sigma: float = 2.0) -> DataFrame:
    """Rows whose every numeric value lies within ``sigma`` deviations of its mean."""
    keep = F.lit(True)
    for c, s in stats.columns.items():
        keep = keep & (F.abs(F.col(f"`{c}`").cast("double") - F.lit(s.mean)) <= F.lit(sigma * s.std))
    return df.filter(keep)
