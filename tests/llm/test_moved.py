"""How much of the texts a stage's last join deals out, whatever Spark would broadcast."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skeinlake.llm import mixing, simhash, suffixes
from skeinlake.llm.common import BATCH_BYTES, keep, parted


@pytest.fixture
def unbroadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def exchanges(df):
    """Rows of ``df``, and the bytes that each of its shuffles wrote."""
    rows, out = df.collect(), []

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec":
            out.append(node.metrics().apply("shuffleBytesWritten").value())
        below = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        for x in below:
            walk(x)

    walk(df._jdf.queryExecution().executedPlan())
    return rows, out


def corpus(n=120, words=300):
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(words))) for i in range(n)]
    passage = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(60))
    rows[3] = (3, rows[3][1] + " " + passage)
    rows[9] = (9, passage + " " + rows[9][1])
    return [*rows, (n, rows[5][1])], passage


def test_parted_keeps_every_row(spark):
    rows = spark.range(5000).withColumnRenamed("id", "n").withColumn("word", F.lit("x"))
    some = spark.range(0, 10000, 50).withColumnRenamed("id", "n")
    asked, others = (part.collect() for part in parted(rows, "n", some, "test-marks"))
    assert sorted(r.n for r in asked + others) == list(range(5000)) and {r.word for r in asked + others} == {"x"}
    assert set(range(0, 5000, 50)) <= {r.n for r in asked} and len(asked) < 150
    asked, others = parted(rows, "n", some.filter("false"), "test-marks")
    assert (asked.count(), others.count()) == (0, 5000)


def test_texts_without_a_repeat_stay_where_they_are(unbroadcast, docs_of):
    rows, passage = corpus()
    kept, moved = exchanges(suffixes.remove(docs_of(rows[:-1]), "words", 50))
    assert {r.doc_id: r.text for r in kept} == {i: t.replace(passage, "") for i, t in rows[:-1]}
    assert sum(moved) < 0.1 * sum(len(t) for _, t in rows)


def test_texts_without_a_near_copy_stay_where_they_are(unbroadcast, docs_of):
    rows, _ = corpus()
    kept, moved = exchanges(simhash.dedup(docs_of(rows)))
    assert {r.doc_id: r.text for r in kept} == dict(rows[:-1])
    assert sum(moved) < 0.1 * sum(len(t) for _, t in rows)


def test_the_mix_deals_texts_out_once(unbroadcast, docs_of):
    rows, _ = corpus()
    taken, moved = exchanges(mixing.mixture(docs_of(rows)))
    assert 150 < len(taken) < 200 and {(r.doc_id, r.text) for r in taken} <= set(rows)
    assert sum(x > 0.3 * sum(len(t) for _, t in rows) for x in moved) == 1


def test_batches_to_python_are_small(spark):
    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    texts = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("0123456789"), 500).alias("text"))
    sizes = [r.n for r in keep(texts.mapInArrow(size, "n long"), "test-batches").collect()]
    assert sum(sizes) >= 30_000_000 and max(sizes) < 1.1 * BATCH_BYTES
