"""Shared helpers: reading tables, Arrow slicing and tables kept in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handed to one Python step at once, in bytes; a single longer text forms its own slice.
SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch between Spark and a Python step, where the session names none; Spark's own 64 MB stand twice in each task.
BATCH_BYTES = 8 << 20
#: Bits of the bitmap by which ``parted`` tells rows apart; it is broadcast, as 262,144 words at most.
MARKS = 1 << 24


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``BATCH_BYTES``, unless it has a size of its own; results do not depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where the session names none and runs on one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = kept.get() if kept.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="skeinlake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    small_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/skeinlake/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def discard(*kept: DataFrame) -> None:
    """Remove the files of kept tables that nothing reads any more."""
    for df in kept:
        spark, path = df.sparkSession, df._kept_at
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, tag: str, name: str) -> DataFrame:
    """``df`` kept, with a column of row numbers that are distinct, and the same whenever they are read: file, then place in it.

    A hash of the row could meet another row's; repeated rows would share one.
    """
    out = keep(df, tag)
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)-", 1).cast("long")
    cut = F.regexp_extract(F.col("_metadata.file_name"), r"c(\d+)\.", 1).cast("long")
    rows = out.select("*", (F.shiftleft(part, 40) + F.shiftleft(F.coalesce(cut, F.lit(0).cast("long")), 32) + F.col("_metadata.row_index")).alias(name))
    rows._kept_at = out._kept_at
    return rows


def digest_pair(*columns: Column) -> Column:
    """128 bits of a row's columns, as two differently seeded 64-bit hashes."""
    return F.struct(F.xxhash64(*columns).alias("h"), F.xxhash64(F.lit("second"), *columns).alias("k"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def salt_of(column: Column, salts: int) -> Column:
    """The share, of ``salts``, that a row is dealt into."""
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


def salt_mask(salt: Column) -> Column:
    """Aggregate: the salts of a group as bits of a long, which a hash aggregate holds at fixed size."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), salt))


def each_salt(mask: Column, salts: int) -> Column:
    """One row for each bit of ``salt_mask``."""
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda x: F.call_function("shiftright", mask, x).bitwiseAND(F.lit(1).cast("long")) == 1))


def parted(rows: DataFrame, number: str, some: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those whose ``number`` may be in the column ``number`` of ``some``, and those whose is certainly not.

    A bitmap of hashed numbers tells, so that a join with ``some`` moves the first part only.  The bitmap does not grow with
    the table: the more numbers it holds beyond its bits, the more rows the first part has.
    """
    word, bits = free_name(rows, "word"), free_name(rows, "bits")
    at = F.pmod(F.xxhash64(number), F.lit(MARKS))
    of_word, bit = F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    marks = keep(some.groupBy(of_word.alias(word)).agg(F.bit_or(bit).alias(bits)), tag)
    marked = rows.withColumn(word, of_word).join(F.broadcast(marks), word, "left")
    may = F.coalesce(F.col(bits).bitwiseAND(bit) != 0, F.lit(False))
    return marked.filter(may).drop(word, bits), marked.filter(~may).drop(word, bits)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    if not pa.types.is_binary(column.type):
        column = column.cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` of each piece holds about ``most`` bytes.

    At the end Arrow's free memory goes back to the system: a worker serves many stages, others run beside it.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = max(1, min(batch.num_rows, batch.num_rows * most // max(1, batch.column(column).nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def table_path(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)
