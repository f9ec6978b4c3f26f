import hashlib
import re

import numpy as np
import pytest

from skeinlake.llm import licenses, spotsigs
from skeinlake.llm.common import read_table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_scan(text):
    tokens = WORD.findall(lower(text))
    base, met, best = [], set(), 0.0
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        base += [(i, label) for i in range(len(tokens) - len(p) + 1) if tokens[i : i + len(p)] == p]
    here, found = list(zip(tokens, tokens[1:])), []
    for label, texts in licenses.TEMPLATES.items():
        for t in texts:
            words = WORD.findall(lower(t))
            want = list(zip(words, words[1:]))
            size = len(want) + -(-len(want) // 4)
            where = [i for i, p in enumerate(here) if p in want]
            for i in where:
                inside = [j for j in where if i <= j < i + size]
                n = len({here[j] for j in inside})
                if n / len(set(want)) >= licenses.THRESHOLD - 1e-9:
                    found.append((label, i, max(inside) + 1, n, n / len(set(want))))
    for label, i, j, n, share in found:
        if not any(x != label and c <= j and d >= i and m >= n and s > share for x, c, d, m, s in found):
            met.add(label)
            best = max(best, share)
    at = [i for i, _ in base]
    b = {x for _, x in base}
    return len(tokens), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(b)), ",".join(sorted(b | met)), 1.0 if base else best


EDGE = [(2_000_001, None), (2_000_002, ""), (2_000_003, "Under the MIT-License. apache license, VERSION 2 cc by nc cc by nc"), (2_000_004, "word " * 40_000 + "This work is licensed under the GNU General Public License, version 3." + " word" * 9), (2_000_005, "under the mit licenses"), (2_000_005, "under the mit licenses"), (2_000_006, "Übung cc by-nc ÀÉ")]


def test_scan_matches_brute_force(spark, sf_dir, docs_of):
    df = read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").unionByName(docs_of(EDGE).select("doc_id", "text"))
    got = sorted((tuple(r) for r in licenses.scan(df).collect()), key=str)
    want = sorted(((r.doc_id, *brute_scan(r.text)) for r in df.collect()), key=str)
    assert got == want and sum(x[6] != "" for x in got) > 10
    assert licenses.scan(docs_of([])).count() == 0
    assert {(r.doc_id, r.label) for r in licenses.blocks(docs_of(EDGE)).collect()} >= {(2_000_004, "gpl-3")}


@pytest.mark.parametrize(
    "text,labels",
    [
        ("Licensed under CC BY 4.0", "cc-by"),
        ("licensed under CC BY-NC 4.0", "cc-by-nc"),
        ("licensed under cc by sa 4 0 and more", "cc-by-sa"),
        ("see 4 cc by whom under 0 licensed", ""),
        ("it is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl-3"),
        (" ".join(licenses.TEMPLATES["mit"][2].split()).replace("dealing", "trade").replace("Software", "Library", 1), "mit"),
        (licenses.TEMPLATES["bsd"][0], "bsd"),
    ],
)
def test_labels(spark, docs_of, text, labels):
    for before in (0, 1, 7, 8, 9):  # wherever the notice starts
        row = licenses.scan(docs_of([(1, "word " * before + text)])).first()
        assert row.labels == labels and (row.score >= licenses.THRESHOLD) == bool(labels)
    found = licenses.blocks(docs_of([(1, f"{text} {'and so on ' * 200} {text}")])).collect()
    assert {r.label for r in found} == ({labels} if labels else set()) and len({r.first_word for r in found}) == (2 if labels else 0) or labels == "mit"


def brute_signatures(text):
    tokens = WORD.findall(lower(text))
    stop = {w.decode() for w in spotsigs.ANCHORS}
    out = set()
    for i, w in enumerate(tokens):
        if w in stop:
            chain = [x for x in tokens[i + 1 :] if x not in stop][:2]
            if len(chain) == 2:
                out.add((w, *chain))
    return out or {tuple(tokens)}


def test_fingerprints_match_brute_force(spark, sf_dir, docs_of):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(docs_of([(5_000, None), (5_001, ""), (None, "last one"), (5_002, "é" * 7), (5_003, "dup"), (5_003, "dup")]).select("doc_id", "text"))
    rows = sorted(((r.doc_id if r.doc_id is not None else 2**62, r.text or "") for r in docs.collect()))
    out = spotsigs.with_next(docs).collect()
    got = {(r.doc_id if r.doc_id is not None else 2**62, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in out}
    of = {r.doc_id: set(spotsigs.of_fingerprint(r.fingerprint).tolist()) for r in out}
    ids = [i if i != 2**62 else None for i, _ in rows]
    for r, following in zip(sorted(out, key=lambda r: (r.doc_id is None, r.doc_id)), ids[1:] + ids[:1]):  # from the fingerprints alone
        mine, new = of[r.doc_id], set(spotsigs.of_fingerprint(r.edited_fingerprint).tolist())
        assert r.near_edited == len(mine & new) / len(mine | new) and r.near_next == len(mine & of[following]) / len(mine | of[following])
        assert r.n_signatures == len(mine) and r.similar_edited == (r.near_edited >= 0.8) and r.similar_next == (r.near_next >= 0.8)
    want, prints = set(), {}
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        h = len(t) // 2
        e = t[: len(t) - h] + u[:h]
        a, b, c = brute_signatures(t), brute_signatures(e), brute_signatures(u)
        want.add((i, len(t), hashlib.sha256(e.encode()).hexdigest(), round(len(a & b) / len(a | b), 9), round(len(a & c) / len(a | c), 9)))
        prints.setdefault(frozenset(a), set()).add(spotsigs.fingerprint(spotsigs.hashes(spotsigs.signatures(t))))
    assert got == want and all(len(x) == 1 for x in prints.values())
    assert spotsigs.with_next(docs_of([])).count() == 0
    one = spotsigs.with_next(docs_of([(7, "the cat sat")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_similar_and_pairs(spark, docs_of):
    a, b, one = (np.array(x, np.uint64) for x in (range(10), [*range(9), 12], [1]))
    assert spotsigs.similar(a, b, 0.8) == 9 / 11 and spotsigs.similar(a, b, 0.85) is None and spotsigs.similar(a, one, 0.5) is None
    rng = np.random.default_rng(1)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, rng.integers(2, 400), rng.integers(1, 300))).astype(np.uint64) for _ in range(2))
        near = spotsigs.likeness(x, y)
        assert spotsigs.similar(x, y, 0.6) == (near if near >= 0.6 else None)
    docs = read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    pairs, membership = spotsigs.similar_pairs(docs, 0.6)
    sets = {}
    for r in docs.collect():
        sets.setdefault(frozenset(spotsigs.signatures(r.text)), []).append(r.doc_id)
    classes = [(s, min(ids)) for s, ids in sets.items()]
    want = {tuple(sorted((i, j))) for k, (s, i) in enumerate(classes) for t, j in classes[k + 1 :] if len(s & t) >= 0.6 * len(s | t)}
    assert {tuple(sorted((r.class_a, r.class_b))) for r in pairs.collect()} == want and want
    assert membership.count() == docs.count()
