import math
import re
import zlib
from collections import Counter

import numpy as np

from skeinlake.llm import lm
from skeinlake.llm.common import read_table


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [0]


def counts_of(docs):
    words, pairs, starts = Counter(), Counter(), 0
    for t in docs:
        words.update(t)
        pairs.update(zip([1, *t], t))
        starts += 1
    words[1] = starts
    return words, pairs


def crc(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7


def test_same_as_brute_force(spark, docs_of):
    edge = [(9_000_000 + i, t) for i, t in enumerate([None, "", " \n", "The the THE", "brandnewword " * 5, "x " * 30_000])]
    df = read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").unionByName(docs_of([*edge, (None, "nobody"), (5, "dup row"), (5, "dup row")]).select("doc_id", "text"))
    rows = [(r.doc_id, tokens_of(r.text)) for r in df.collect()]
    model = lm.learn(df, batch=30_000)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.held_out, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm.score(model).collect())
    train = [t for d, t in rows if crc(d) != 2]
    words, pairs = counts_of(train)
    n, v = sum(map(len, train)), len(set(x for t in train for x in t))
    want = []
    for d, t in rows:
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in t)
        total = 0.0
        for h, w in zip([1, *t], t):
            c = words[h]
            k = 0 if not c else min(lm.CONTEXT_BUCKETS - 1, 1 + int(math.floor(math.log2(c))))
            l0, l1, l2 = model.weights[k]
            total += math.log10(l0 / (v + 1) + l1 * words[w] / n + (l2 * pairs[h, w] / c if c else 0))
        want.append((d if d is not None else -1, len(t), sum(words[w] > 0 for w in t), crc(d) == 2, n, round(base, 6), round(total, 6)))
    want.sort()
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in got], [x[5:] for x in want], rtol=1e-9, atol=2e-6)
    held = [x for x in got if x[3]]
    assert sum(x[6] for x in held) > sum(x[5] for x in held)  # better than the base on what it has not seen

    main, deleted = counts_of([t for d, t in rows if crc(d) not in (2, 3)]), [t for d, t in rows if crc(d) == 3]
    n_main = sum(len(t) for d, t in rows if crc(d) not in (2, 3))
    bucket, p2, p1 = [], [], []
    for t in deleted:
        for h, w in zip([1, *t], t):
            c = main[0][h]
            bucket.append(0 if not c else min(lm.CONTEXT_BUCKETS - 1, 1 + int(math.floor(math.log2(c)))))
            p2.append(main[1][h, w] / c if c else 0.0)
            p1.append(main[0][w] / n_main)
    exact = lm.fit(np.array(bucket), np.array(p2), np.array(p1), 1 / (v + 1), np.ones(len(bucket)))
    assert np.abs(exact - model.weights)[np.bincount(bucket, minlength=lm.CONTEXT_BUCKETS) > 100].max() < 0.02


def test_empty_and_untrained(spark, docs_of):
    assert lm.score(lm.learn(docs_of([]))).count() == 0
    doc = next(i for i in range(100) if crc(i) == 2)
    out = lm.score(lm.learn(docs_of([(doc, "a b")]))).collect()
    assert len(out) == 1 and out[0].held_out and out[0].train_tokens == 0 and out[0].n_known == 0 and math.isfinite(out[0].score)
