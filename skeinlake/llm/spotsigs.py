"""Document fingerprints from spot signatures.

At every common word (anchor) a signature is the anchor with the chain of the next content words.  A text's
fingerprint is the sorted set of its signatures' 64-bit hashes, written as hexadecimal digits, sixteen each;
the likeness of two fingerprints is the Jaccard measure of the two sets and follows from them alone.
``similar`` compares two fingerprints against a threshold: sets are partitioned by length so that those at
least so alike lie in the same or the next partition, others are told apart by their lengths, and the
comparison stops once the threshold is out of reach.  ``similar_pairs`` joins a whole table that way.

Defined results: a null text counts as empty; a text without a signature has one, of its whole word
sequence, so that equal texts stay equal and different short ones differ; repeated rows are separate
documents, in the order of (id, text); null ids come last; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlake.llm.common import keep, read_table, shuffle_partitions
from skeinlake.llm.licenses import words

# Common words of the four languages, the anchors.
ANCHORS = frozenset(
    w.encode()
    for w in (
        "a an and are as at be by for from he in is it of on or that the this to was with "
        "als auf das dem den der des die ein eine für im ist mit nicht sich und von zu "
        "au avec dans de des du en est et la le les par pas pour que qui sur un une "
        "con de del el en es la las los no para por que se su una y"
    ).split()
)
CHAIN, THRESHOLD = 2, 0.8
#: Hashes of the smaller set that are looked up before the bound is tried again.
STEP_SIZE = 64

PAIRS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long, similar_edited boolean, similar_next boolean"
NAMES = [x.split()[0] for x in PAIRS.split(", ")]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.bool_(), pa.bool_()]
#: Ranges of ids for each shuffle partition.
RANGES = 4


def signatures(text: str, anchors: frozenset = ANCHORS, chain: int = CHAIN) -> set[bytes]:
    tokens = words(text.encode("utf-8", "replace"))
    content = [w for w in tokens if w not in anchors]
    last, at, out = len(content) - chain, 0, set()
    for w in tokens:
        if w not in anchors:
            at += 1
        elif at <= last:
            out.add(b" ".join([w, *content[at : at + chain]]))
    return out or {b"\0" + b" ".join(tokens)}


def hashes(found: set[bytes]) -> np.ndarray:
    import xxhash

    return np.unique(np.array([xxhash.xxh64_intdigest(x) for x in found], np.uint64))


def fingerprint(h: np.ndarray) -> str:
    return h.astype(">u8").tobytes().hex()


def of_fingerprint(digits: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(digits), ">u8").astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard measure of two sorted sets."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def partition_step(threshold: float) -> float:
    """Logarithm of a partition's longest over its shortest length; above zero at a threshold of 1 too."""
    return max(1e-6, -math.log(threshold))


def partition(n: int, threshold: float) -> int:
    """Sets at least ``threshold`` alike lie in the same partition by length or in neighbouring ones."""
    return math.floor(math.log(n) / partition_step(threshold) + 1e-9)


def similar(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float | None:
    """The likeness if it reaches ``threshold``, else None: partitions and lengths first, then stretches of the smaller set while it can."""
    if len(a) > len(b):
        a, b = b, a
    if partition(len(b), threshold) - partition(len(a), threshold) > 1 or len(a) < threshold * len(b):
        return None
    missing, most = 0, math.floor(len(a) - threshold / (1 + threshold) * (len(a) + len(b)) + 1e-9)
    for at in range(0, len(a), STEP_SIZE):
        some = a[at : at + STEP_SIZE]
        place = np.minimum(np.searchsorted(b, some), len(b) - 1)
        missing += int((b[place] != some).sum())
        if missing > most:
            return None
    common = len(a) - missing
    return common / (len(a) + len(b) - common)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(doc, text: str, following: str, mine: np.ndarray | None = None, theirs: np.ndarray | None = None) -> tuple:
    mine = hashes(signatures(text)) if mine is None else mine
    theirs = hashes(signatures(following)) if theirs is None else theirs
    changed = edited(text, following)
    new = hashes(signatures(changed))
    digest = hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest()
    return (doc, len(text), digest, fingerprint(mine), fingerprint(new), likeness(mine, new), likeness(mine, theirs), len(mine), similar(mine, new) is not None, similar(mine, theirs) is not None)


def _ranges(cuts: list[int], column: Column, low: int = 0) -> Column:
    """The number of the range between ``cuts`` that a value lies in, by halving."""
    if not cuts:
        return F.lit(low)
    mid = len(cuts) // 2
    return F.when(column < F.lit(cuts[mid]), _ranges(cuts[:mid], column, low)).otherwise(_ranges(cuts[mid + 1 :], column, low + mid + 1))


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its edited text and the next document in the order of ids.

    Ids are cut into ranges at their quantiles, a few for each task.  The first document of each range is
    also dealt to the range before it, so one shuffle of the texts brings every document beside the one
    behind it.  To the driver come the quantiles and one id a range.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = shuffle_partitions(df.sparkSession)
    cuts = sorted({int(x) for x in docs.select(F.col("doc_id").cast("double")).approxQuantile("doc_id", [i / (RANGES * n) for i in range(1, RANGES * n)], 0.1 / (RANGES * n))})
    last = len(cuts) + 1  # of null ids
    dealt = docs.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(_ranges(cuts, F.col("doc_id"))))
    least = sorted((r["range"], r["doc_id"]) for r in dealt.filter("doc_id is not null").groupBy("range").agg(F.min("doc_id").alias("doc_id")).collect())
    heads = dealt.filter(F.col("doc_id").isin([i for _, i in least])) if least else dealt.limit(0)
    heads = heads.unionByName(dealt.filter("doc_id is null")).groupBy("range").agg(F.min("text").alias("text"))
    there = [r for r, _ in least] + ([last] if docs.filter("doc_id is null").limit(1).count() else [])
    before = df.sparkSession.createDataFrame(list(zip(there, there[-1:] + there[:-1])), "range int, before int")
    behind = heads.join(before, "range").select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("before").alias("range"))
    both = dealt.withColumn("behind", F.lit(False)).unionByName(behind.withColumn("behind", F.lit(True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = []
            for doc, text, end in zip(*(batch.column(i).to_pylist() for i in range(3))):
                sigs = hashes(signatures(text))
                if held is not None:
                    rows.append(_row(held[0], held[1], text, held[2], sigs))
                held = None if end else (doc, text, sigs)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(KINDS)], names=NAMES)

    order = ["range", "behind", F.col("doc_id").asc_nulls_last(), "text"]
    return both.select("doc_id", "text", "behind", "range").repartition(n, "range").sortWithinPartitions(*order).mapInArrow(run, PAIRS)


def signature_sets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fingerprint and the sorted 64-bit hashes of its signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [hashes(signatures(text or "")) for text in batch.column(1).to_pylist()]
            prints = [hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest() for x in sets]  # a key of the set; the set is beside it
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["doc_id", "fingerprint", "signatures"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string, signatures array<long>")


def similar_pairs(df: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pairs between fingerprint classes with their Jaccard, membership of documents in classes).

    Classes of equal signature sets are represented once.  The rarest signatures of each set are its
    prefix; classes meet where they share a prefix signature and lie in the same or the next partition by
    set length, are kept once, and compared by ``similar``.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            near = [similar(np.array(x).view(np.uint64), np.array(y).view(np.uint64), threshold) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
            rows = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(near, pa.float64())], names=["class_a", "class_b", "jaccard"])
            yield rows.filter(rows.column(2).is_valid())

    sets = keep(signature_sets(df, id_col, text_col), "spot-sets")
    members = sets.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"), F.first("signatures").alias("signatures"))
    classes = keep(members, "spot-classes")
    membership = sets.select("doc_id", "fingerprint").join(classes.select("fingerprint", "class_id"), "fingerprint").select("doc_id", "class_id")
    each = classes.select("fingerprint", F.size("signatures").alias("n"), F.explode("signatures").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("fingerprint").orderBy("often", "s"))
    prefix = each.join(often, "s").withColumn("r", rank).filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(partition_step(threshold)) + F.lit(1e-9))
    mine = prefix.filter("often > 1").select("s", "fingerprint", "n", "r", part.alias("part"))
    theirs = mine.select("s", F.col("fingerprint").alias("other"), F.col("n").alias("m"), F.col("r").alias("q"), F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    overlap = F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("m"))
    reach = 1 + F.least(F.col("n") - F.col("r"), F.col("m") - F.col("q")) + F.least("r", "q") - 1
    pairs = (
        mine.join(theirs, ["s", "part"]).filter("fingerprint <> other").filter(F.least("n", "m") >= F.lit(threshold) * F.greatest("n", "m")).filter(reach >= overlap - 1e-9)
        .select(F.least("fingerprint", "other").alias("a"), F.greatest("fingerprint", "other").alias("b")).distinct()
    )
    full = classes.select("fingerprint", "class_id", "signatures")
    compared = pairs.join(full.toDF("a", "class_a", "set_a"), "a").join(full.toDF("b", "class_b", "set_b"), "b")
    return compared.select("class_a", "class_b", "set_a", "set_b").mapInArrow(compare, "class_a long, class_b long, jaccard double"), membership


def query(spark, sf_dir: str) -> DataFrame:
    return with_next(read_table(spark, sf_dir, "documents"))
