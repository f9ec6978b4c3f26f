"""Stages against brute force on a small corpus, and the whole pipeline."""

import os
import random
import sys
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import near  # noqa: E402

import corpus_pipeline
from skeinlake.llm import mixing, simhash
from skeinlake.llm.common import keep, read_table


def word(rng):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(6))


def shingle_set(text, n=5):
    w = text.lower().split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else {""}


def near_corpus(rng):
    rows, n = [], 0
    for _ in range(25):
        base = [word(rng) for _ in range(rng.randrange(120, 400))]
        for edits in (0, 0, 1, 2, 4, 12, 60):
            w = list(base)
            for at in rng.sample(range(len(w)), edits):
                w[at] = word(rng)
            rows.append((n, " ".join(w)))
            n += 1
    return rows


def test_near_duplicates(spark, docs_of):
    rng = random.Random(11)
    rows = near_corpus(rng)
    edge = [(90_000, None), (90_001, ""), (90_002, "  "), (90_003, "one two"), (90_004, "ONE  two"), (90_005, "one two three"), (90_006, "dup dup"), (90_006, "dup dup"), (None, rows[0][1])]
    out = simhash.dedup(docs_of(rows + edge)).collect()
    ids = [r.doc_id for r in out]
    assert len(ids) == len(set(ids)) and out[0].n_tokens == "x"
    kept = set(ids)
    assert {90_000, 90_003, 90_005, 90_006} <= kept and not {90_001, 90_002, 90_004, None} & kept
    sets = {i: shingle_set(t) for i, t in rows}
    likeness = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i < j and i // 7 == j // 7}
    groups = {i: i for i in sets}
    for (i, j), s in sorted(likeness.items()):
        if s >= 0.8:
            a, b = groups[i], groups[j]
            groups = {k: min(a, b) if v in (a, b) else v for k, v in groups.items()}
    want = set(groups.values())
    missed = (kept & set(sets)) - want
    assert want <= kept  # nothing outside a group goes
    assert not missed  # and all of each group but one does
    assert simhash.dedup(docs_of([])).count() == 0


def dense_family(rng, members=200, partners=40, length=304, edits=4):
    """Texts 0.765 alike, some with a partner 0.818 alike, which is as far from the others."""
    base, places = [word(rng) for _ in range(length)], list(range(5, length - 5, 5))

    def edited(at):
        w = list(base)
        for i in at:
            w[i] = word(rng)
        return w

    texts = [(edits_, edited(edits_)) for edits_ in (rng.sample(places, edits) for _ in range(members))]
    for at, w in texts[:partners]:
        other = edited(rng.sample([i for i in places if i not in at], edits - 1))
        other[at[0]] = w[at[0]]
        texts.append((at, other))
    return [(i, " ".join(w)) for i, (_, w) in enumerate(texts)]


def test_dense_family_loses_no_candidate(spark, docs_of):
    rows = dense_family(random.Random(5))
    kept = {r.doc_id for r in simhash.dedup(docs_of(rows)).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    group = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            if group[i] != group[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group = {k: min(group[i], group[j]) if v in (group[i], group[j]) else v for k, v in group.items()}
    want = set(group.values())
    assert want <= kept and len(want) < len(rows) - 35
    assert kept == want


def test_same_groups_as_an_exact_join(spark):
    """Recall over pairs of documents: on sf0.1, of 48 linked pairs of texts, none was apart either."""
    rows = read_table(spark, "/root/testdata/sf0.01", "documents").orderBy("doc_id").collect()
    root, pairs = near.groups([r.text for r in rows])
    want = {}
    for r, g in zip(rows, root):
        want.setdefault(g, r.doc_id)
    kept = {r.doc_id for r in simhash.dedup(spark.createDataFrame(rows)).collect()}
    assert kept == set(want.values()) and len(kept) < len(rows)


def test_shard_keys_meet_by_likeness():
    rng, met = np.random.default_rng(4), 0
    for _ in range(400):
        x = rng.integers(0, 2**64, 90, dtype=np.uint64)
        y = np.r_[x[:80], rng.integers(0, 2**64, 10, dtype=np.uint64)]  # 0.8 alike
        met += bool(set(simhash.shard_keys(x).tolist()) & set(simhash.shard_keys(y).tolist()))
    assert met >= 398


def test_a_shard_of_many_near_copies(spark):
    """50,000 rows of one shard, all but 40 linked already: only the 40 ask the shard's trees, which are cut into blocks."""
    n, rng = 50_000, np.random.default_rng(1)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    fp, odd = simhash.long_fingerprint(base).tobytes(), simhash.parity(base).tobytes()
    members = spark.range(n).select(F.lit(7).cast("long").alias("shard"), (F.col("id") % 32).cast("int").alias("salt"), F.col("id").alias("row"), F.when(F.col("id") % 1250 == 3, F.col("id")).otherwise(0).alias("label"), F.lit(60).cast("long").alias("size"), F.lit(odd).alias("odd"), F.lit(fp).alias("long_fp"))
    pairs = simhash.tree_pairs(members, 100, 0.8)
    assert pairs.count() == 40 * (n - 40) + 40 * 39 // 2


def test_near_duplicates_with_clashing_names(spark):
    rows = [(5, None, "a", 1), (5, "", "b", 2), (5, None, "c", 3), (5, "some words of one text here", "d", 4), (4, "Some words of one text here", "e", 5), (None, "some words of one text here", "f", 6)]
    out = simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string, row string, number long").withColumn("label", F.lit(1)))
    got = out.collect()
    assert out.columns == ["doc_id", "text", "row", "number", "label"] and sorted(r.doc_id for r in got) == [4, 5] and {r.row for r in got} < {"a", "b", "c", "e"}


def test_repeated_lines_leave_the_likeness(spark, docs_of):
    rng = random.Random(7)
    rows = []
    for n in range(40):  # the same shingles; the line stands twice, and 1 or 20 times more
        words, line = [word(rng) for _ in range(100)], [word(rng) for _ in range(14)]
        rows += [(2 * n, " ".join(words + line * 2)), (2 * n + 1, " ".join(words + line * (3 if n % 2 else 22)))]
    assert {r.doc_id for r in simhash.dedup(docs_of(rows)).collect()} == {2 * n for n in range(40)}


def test_parities_exclude_no_pair():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n, common = int(rng.integers(1, 4000)), float(rng.random())
        x = rng.integers(0, 2**64, n, dtype=np.uint64)
        y = np.r_[x[: int(n * common)], rng.integers(0, 2**64, int(rng.integers(0, 300)), dtype=np.uint64)]
        x, y = np.unique(x), np.unique(y)
        assert np.bitwise_count(simhash.parity(x) ^ simhash.parity(y)).sum() <= len(np.setxor1d(x, y))


def test_mixture_rows(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    docs = docs.unionByName(docs.limit(3))
    mixed = keep(mixing.mix(docs), "test-mix")
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    want, got = Counter(), Counter(r.doc_id for r in out.collect())
    for r in mixed.collect():
        want[r.doc_id] += r.copies
    assert got == +want


def test_stages_and_run(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = read_table(spark, sf_dir, "documents")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"test-{name}")
        seen.append(docs.count())
        assert name == "encoded" or docs.columns == columns
    assert seen[1] < seen[0] and seen[2] < seen[1] and seen[3] == seen[2] and seen[5] == seen[4]
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, docs.collect()))


def test_stages_on_nothing(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"test-empty-{name}")
        assert docs.count() == 0
