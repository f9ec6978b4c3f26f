"""Progressive loading as a stream: files arrive a few at a time and running aggregates refine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_round: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_round).parquet(folder)


def running_estimates(stream: DataFrame, keys: list[str], value: str, total_rows: int) -> DataFrame:
    """COUNT, SUM and AVG by key, with the rows read so far; scale by ``total_rows`` / rows read at the sink.

    State holds one row a key.
    """
    x = F.col(value)
    return stream.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean")).withColumn("table_rows", F.lit(total_rows))


def scaled(rounds: DataFrame) -> DataFrame:
    """Estimates of a finished round of ``running_estimates``."""
    read = rounds.agg(F.sum("n").alias("__read"))
    factor = F.try_divide(F.col("table_rows").cast("double"), F.col("__read").cast("double"))
    return rounds.crossJoin(F.broadcast(read)).withColumn("n", F.floor(F.col("n") * factor)).withColumn("total", F.col("total") * factor).drop("__read", "table_rows")


def windowed_counts(stream: DataFrame, time_col: str, key: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts by event-time window; rows later than the watermark are left out."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window), F.col(key)).agg(F.count("*").alias("n"))
