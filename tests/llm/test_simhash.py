import random
import re

import numpy as np
import xxhash

from skeinlake.llm import simhash
from skeinlake.llm.common import read_table
from skeinlake.llm.components import components


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def brute_groups(rows, radius=4):
    prints = {}
    for i, fp in rows:
        prints.setdefault(fp, []).append(i)
    keys = list(prints)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for k in keys:
        least[find(k)] = min([least.get(find(k), 2**62), *(i for i in prints[k] if i is not None)])
    return sorted((i if i is not None else -1, f"{fp:016x}", least[find(fp)]) for i, fp in rows)


def test_same_as_brute_force(spark, docs_of):
    edge = [(3_000_001, None), (3_000_002, " \t"), (3_000_003, "one two"), (3_000_003, "one two"), (3_000_004, "ONE two three"), (None, "one two"), (3_000_005, "long word " * 30_000)]
    docs = read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").unionByName(docs_of(edge).select("doc_id", "text"))
    rows = [(r.doc_id, brute_print(r.text)) for r in docs.collect()]
    got = simhash.groups(simhash.fingerprints(docs)).select("doc_id", simhash.hexadecimal(simhash.F.col("fp")).alias("fp"), "component_id")
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fp, r.component_id) for r in got.collect()) == brute_groups(rows)
    assert simhash.groups(simhash.fingerprints(docs_of([]))).count() == 0


def test_every_link_is_found(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(300)]
    for _ in range(1500):
        fp = rng.choice(prints)
        for _ in range(rng.randrange(1, 6)):
            fp ^= 1 << rng.randrange(64)
        prints.append(fp)
    rows = [(i, fp) for i, fp in enumerate(prints)]
    df = spark.createDataFrame([(i, fp - (1 << 64) if fp >> 63 else fp) for i, fp in rows], "doc_id long, fp long")
    got = simhash.groups(df).select("doc_id", simhash.hexadecimal(simhash.F.col("fp")).alias("fp"), "component_id").collect()
    assert sorted(map(tuple, got)) == brute_groups(rows)
    more = simhash.groups(df, crowd=0).select("doc_id", simhash.hexadecimal(simhash.F.col("fp")).alias("fp"), "component_id").collect()
    assert sorted(map(tuple, more)) == sorted(map(tuple, got))  # longer and more keys, the same links
    assert [simhash.spare_blocks(n, 4) for n in (10**5, 10**8, 5 * 10**10)] == [2, 3, 4]


def test_forest_follows_bk_edges():
    rng = np.random.default_rng(3)
    fp = np.unique(rng.integers(0, 2**12, 400, dtype=np.uint64))
    rng.shuffle(fp)
    forest = simhash.Forest(np.zeros(len(fp), np.int64), fp)
    found = {(int(a), int(b)) for q, n in forest.search(np.arange(len(fp)), 2) for a, b in zip(q, n)}
    assert found == {(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 2}


def test_components_of_a_path(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5000, 5000)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}
