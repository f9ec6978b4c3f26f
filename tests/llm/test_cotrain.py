import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from skeinlake.llm import cotrain
from skeinlake.llm.common import read_table


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    train, test = labels.filter("pmod(xxhash64(doc_id), 4) > 0"), labels.filter("pmod(xxhash64(doc_id), 4) = 0")
    judges = cotrain.learn(docs, train)
    rows = cotrain.score(docs, judges).join(test.withColumnRenamed("quality", "q").withColumnRenamed("toxic", "t"), "doc_id").collect()
    assert len(rows) > 500 and judges["quality"].exchanged["text"] > 0
    quality = np.mean([(r.quality >= 0.5) == bool(r.q) for r in rows])
    toxic = np.mean([(r.toxic >= 0.5) == bool(r.t) for r in rows])
    clean = [r.keep for r in rows if r.q == 1 and r.t == 0]
    bad = [r.keep for r in rows if r.q == 0 or r.t == 1]
    assert quality > 0.97 and toxic > 0.96 and np.mean(clean) > 0.98 and np.mean(bad) < 0.15
    brier = np.mean([(r.quality - r.q) ** 2 for r in rows])
    assert brier < 0.03
    again = {r.doc_id: r.quality for r in cotrain.score(docs.limit(50), cotrain.learn(docs.repartition(5), train)).collect()}
    assert all(abs(again[r.doc_id] - r.quality) < 1e-6 for r in rows if r.doc_id in again)


def test_edges(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "text"), (3, "text"), (None, "no id"), (4, "w " * 60_000)])
    labels = spark.createDataFrame([(3, 1, 0), (2, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = cotrain.score(docs, cotrain.learn(docs, labels)).collect()
    assert len(out) == 6 and all(0 <= r.quality <= 1 and r.toxic == 0.0 for r in out)
    none = cotrain.learn(docs, labels.limit(0))
    assert none["quality"].constant == 0.5 and cotrain.kept(docs, none).count() == 6
    assert cotrain.score(docs_of([]), cotrain.learn(docs_of([]), labels)).count() == 0
    assert cotrain.kept(docs, none).columns == docs.columns


def views_that_tell(n, labelled):
    """Labels that the source tells for nearly every document, and rare words, two a document, for each; few labels."""
    rng = random.Random(3)
    words = {c: [f"{i}{'g' if c else 'p'}" for i in range(100)] for c in (0, 1)}
    rows, labels = [], []
    for i in range(n):
        c = i % 2
        text = " ".join(rng.sample([f"any{j}" for j in range(50)], 12) + rng.sample(words[c], 2))
        rows.append((i, text, "en", ("one" if rng.random() < 0.995 else "two") if c else ("two" if rng.random() < 0.995 else "one"), 100))
        if i < labelled:
            labels.append((i, c, None))
    return rows, labels


def test_both_views_hand_over(spark):
    rows, labels = views_that_tell(4000, 700)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    right = lambda judges: np.mean([(r.text_quality >= 0.5) == (r.doc_id % 2 == 1) for r in cotrain.score(docs.filter("doc_id >= 700"), judges).collect()])
    alone, taught = cotrain.learn(docs, marks, rounds=1), cotrain.learn(docs, marks, exchanged=1500)
    assert taught["quality"].exchanged["meta"] > 3000 and taught["quality"].exchanged["text"] >= 0 and alone["quality"].exchanged == {}
    assert right(taught) > max(0.8, right(alone) + 0.1)  # the metadata's labels teach words that no label had
    plain = [(i, " ".join(t.split()[:12]) + (" fine" if i % 2 else " bad"), lang, source, n) for i, t, lang, source, n in rows]
    judges = cotrain.learn(spark.createDataFrame(plain, docs.schema), marks)
    assert judges["quality"].exchanged["text"] > 3000 and judges["quality"].exchanged["meta"] > 3000


def test_a_rare_label_is_drawn_whole(spark):
    """One label in a thousand: every toxic document is among the fitted, and its words are learned."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.sample([f"w{j}" for j in range(200)], 30)) + (" vile" if i % 1000 == 0 else ""), "en", "s", 100) for i in range(40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 1000 == 0).cast("int").alias("toxic"))
    drawn = cotrain.draw_labels(labels, 2000).collect()
    assert sum(r.toxic for r in drawn) == 40 and 1800 < len(drawn) < 2200 and abs(sum(r.weight for r in drawn) - 40_000) < 3000
    out = cotrain.score(docs, cotrain.learn(docs, labels, 2000)).filter("toxic >= 0.5").select("doc_id").collect()
    assert {r.doc_id for r in out} == set(range(0, 40_000, 1000))


def test_scores_match_a_plain_computation(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = read_table(spark, sf_dir, "documents")
    judges = cotrain.learn(docs, read_table(spark, sf_dir, "labels"))
    got = {r.doc_id: r for r in cotrain.score(docs, judges).collect()}
    for r in docs.limit(120).collect():
        text = (r.text or "").encode()
        words, low, begin = cotrain.word_sets(text)
        dense = cotrain.surface(text, words, len(low))
        for t, j in judges.items():
            weight = [dict(zip(v.slots.tolist(), v.weights.tolist())) for v in (j.text, j.meta)]
            a = j.text.bias + sum(x * w for x, w in zip(dense, j.text.dense)) + sum(weight[0].get(s, 0) for s in cotrain.text_slots(low, begin))
            b = j.meta.bias + sum(weight[1].get(s, 0) for s in cotrain.meta_slots(r.lang, r.source, r.n_chars))
            a, b = j.text.scale * a + j.text.shift, j.meta.scale * b + j.meta.shift
            assert abs(got[r.doc_id][t] - 1 / (1 + np.exp(-(j.mixing[0] * a + j.mixing[1] * b + j.mixing[2])))) < 1e-9


def plain_fit(x, y, weight, penalty, steps=4000):
    """Penalised logistic regression on a dense matrix by plain gradient steps."""
    w = np.zeros(x.shape[1] + 1)
    weight = weight / weight.mean()
    for _ in range(steps):
        g = weight * (1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y)
        w -= 0.5 * np.r_[x.T @ g + penalty * w[:-1], g.sum()] / len(y)
    return w


def test_fit_matches_plain_gradient_steps():
    rng = np.random.default_rng(5)
    x, weight = (rng.random((300, 12)) < 0.3).astype(float), rng.random(300) + 0.5
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ rng.normal(size=12))))).astype(float)
    row, index = np.nonzero(x)
    view = cotrain.logistic(cotrain.Rows(index, row, np.zeros((300, 0))), y, np.ones(300, bool), np.arange(12), weight, steps=1500)
    want = plain_fit(x, y, weight, 1.0)
    assert np.abs(np.r_[view.weights, view.bias] - want).max() < 0.05


def test_fit_holds_few_copies_of_the_features():
    """Peak memory of a fit on the driver beyond its rows, in bytes a feature."""
    rng = np.random.default_rng(5)
    n, each = 4000, 400
    index = np.concatenate([np.sort(rng.choice(40_000, each, replace=False)) for _ in range(n)]).astype(np.int32)
    x = cotrain.Rows(index, np.repeat(np.arange(n, dtype=np.int32), each), np.zeros((n, 0)))
    y, use = (rng.random(n) < 0.5).astype(float), rng.random(n) < 0.7
    tracemalloc.start()
    slots = cotrain.choose(x, y, use)
    view = cotrain.logistic(x, y, use, np.arange(0, 40_000, 40), steps=3)
    margin = view.margin(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * len(index)
    taken = use[x.row]
    seen, place = np.unique(index[taken], return_inverse=True)
    pos, m = np.bincount(place, weights=y[x.row[taken]]), np.bincount(place)
    share = y[use].mean()
    z = np.abs(pos - m * share) / np.sqrt(m * share * (1 - share) + 1) * (m >= cotrain.LEAST_SEEN)
    assert slots.tolist() == seen[z > np.sqrt(2 * np.log((m >= cotrain.LEAST_SEEN).sum())) + 0.5].tolist()
    assert np.allclose(margin, view.bias + np.bincount(x.row, weights=np.where(index % 40 == 0, view.weights[index // 40], 0.0), minlength=n))
