import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from skeinlake.llm import suffixes
from skeinlake.llm.common import read_table


def brute(rows, width):
    """Bytes under windows that start more than once anywhere."""
    seen = {}
    texts = [(t or "").encode() for _, t in rows]
    for t in texts:
        for i in range(len(t) - width + 1):
            w = hash(t[i : i + width])
            seen[w] = seen.get(w, 0) + 1
    out = []
    for (doc, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[hash(t[i : i + width])] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((doc if doc is not None else -1, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df, **kw):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digests(df, **kw).collect())


@pytest.mark.parametrize("crowd", [2048, 2])
def test_small_windows(spark, docs_of, crowd):
    rng = random.Random(7)
    passage = "".join(rng.choice("abcd") for _ in range(60))
    rows = [(i, "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 120)))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + passage[i : i + 40] + rows[i + 1][1]) for i in range(40)]
    rows += [(200, None), (201, ""), (202, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (203, "äöüäöüäöüäöüäöüß"), (204, "same row twice, long enough"), (204, "same row twice, long enough"), (None, rows[3][1])]
    df = docs_of(rows)
    assert got(df, width=12, gram=4, crowd=crowd) == brute(rows, 12)
    assert got(docs_of([]), width=12) == []


def test_documents(spark, sf_dir, docs_of):
    df = read_table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(docs_of([(10_000, "xyz" * 5000), (10_001, None)]).select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = brute(rows, 400)
    assert got(df) == want and sum(x[2] for x in want) > 10_000


def test_members_beyond_a_buffer():
    """One minimiser with more tokens under its runs than a buffer holds: a shared window in all, another in two."""
    import numpy as np

    rng = np.random.default_rng(2)
    width, n = 400, 2100
    core = rng.integers(0, 256, width, dtype=np.uint8)
    stored = [np.r_[rng.integers(0, 256, 200, dtype=np.uint8), core, rng.integers(0, 256, 150, dtype=np.uint8)] for _ in range(n)]
    stored[7] = stored[3].copy()
    stored[7][-1] ^= 1
    pos = np.full(n, 350 << 24 | 0 << 12 | 350, np.int64)
    doc = np.arange(n)
    spans = suffixes.sort_members(np.zeros(n, np.int64), doc, pos, stored, suffixes.Tokens("bytes"), width)
    got_ = dict(zip(spans[0].tolist(), zip(spans[1].tolist(), spans[2].tolist())))
    assert len(got_) == n and 190 < got_[0][0] <= 200 and 600 <= got_[0][1] < 610 and got_[3] == (0, 749) == got_[7]


def test_pieces_cover_every_window():
    for n in (0, 5, 30, 31, 99, 100, 257):
        starts = [s for buffer in suffixes.pieces([n], 6, most=31) for _, a, b in buffer for s in range(a, b - 5)]
        assert sorted(starts) == list(range(max(0, n - 5)))


def test_words(spark, docs_of):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(80)) + "\n" + shared + ".\t " + " ".join(word() for _ in range(30))) for i in range(5)] + [(9, None), (10, "clean text")]
    out = {r.doc_id: r for r in suffixes.remove(docs_of(rows)).collect()}
    for i, t in rows[:5]:
        head, tail = t.split(shared)
        assert out[i].text.split() == (head + tail[1:]).split() or out[i].text.split() == (head + shared.split()[-1] + tail).split()
    assert out[9].text is None and out[10].text == "clean text" and out[9].label is None and out[9].n_tokens == "x"


def test_places_of_a_passage_leave_as_one_span(spark):
    """A passage under many anchors in many documents: a span a document, not a row an anchor."""
    passage = " ".join(f"p{i}" for i in range(400))
    docs = spark.createDataFrame([(i, bytearray(zlib.compress(f"a{i} {passage} z{i}".encode()))) for i in range(50)], "doc long, text binary")
    rows = suffixes.anchors(docs.coalesce(1), "words", 50, 8).filter("more is not null")
    out = suffixes.places(rows, 50).collect()
    assert rows.count() > 10 and sorted(r.doc for r in out) == list(range(50)) and all(r.first >= 0 and 300 < r.last - r.first <= 402 for r in out)
    rng = np.random.default_rng(2)
    doc, first = rng.integers(0, 4, 300), rng.integers(0, 2000, 300)
    last = first + rng.integers(1, 40, 300)
    expected = [(d, *x) for d in range(4) for x in suffixes.merge([{"first": a, "last": b} for k, a, b in zip(doc, first, last) if k == d])]
    assert list(zip(*(x.tolist() for x in suffixes.joined_spans(doc, first, last)))) == expected
    none = np.zeros(0, np.int64)
    assert all(len(x) == 0 for x in suffixes.joined_spans(none, none, none))
