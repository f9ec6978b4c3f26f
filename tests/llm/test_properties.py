"""Random texts against the libraries and exact round trips, without Spark."""

from functools import cache

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinlake.llm import lm, ogg, simhash, spotsigs, suffixes
from skeinlake.llm.common import table_path
from skeinlake.llm.pieces import PieceCodec
from skeinlake.llm.token_counts import PieceCounter

TEXT = st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("ab éß▁\n\t 's!<|endoftext|>0日", max_size=80)


@cache
def codec():
    return PieceCodec(table_path("piece_bpe_32k.model"))


@cache
def counter():
    return PieceCounter(table_path("byte_bpe_50k.json"))


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_pieces(texts):
    assert codec().encode(texts) == codec().library.encode(texts)
    ids, sizes = codec().encode_flat(texts)
    assert [x.decode() for x in codec().joined(ids, sizes)] == [",".join(map(str, x)) for x in codec().library.encode(texts)]


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_token_counts(texts):
    assert counter().counts(texts) == [len(x.ids) for x in counter().library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=2000), min_size=1, max_size=5), st.integers(1, 4), st.lists(st.binary(max_size=700), min_size=1, max_size=5))
def test_ogg_streams(first, per_page, second):
    a = ogg.paginate(1, [(p, i) for i, p in enumerate(first)], per_page)
    b = ogg.paginate(2, [(p, i) for i, p in enumerate(second)], 1)
    mixed = [x for i in range(max(len(a), len(b))) for x in (*a[i : i + 1], *b[i : i + 1])]
    found, damaged = ogg.demultiplex(b"".join(mixed))
    assert damaged == 0 and found[1].packets == first and found[2].packets == second and found[1].lost == found[2].lost == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=600))
def test_fingerprints(values):
    h = np.array(values, np.uint64)
    want = sum(1 << i for i in range(64) if 2 * sum(v >> i & 1 for v in values) > len(values))
    assert simhash.fingerprint_of(h) == want and int(simhash.long_fingerprint(h)[0]) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=50))
def test_packing(values):
    x = np.array(sorted(values), np.uint64)
    assert (lm.unpack_sorted(lm.pack_sorted(x)) == x).all() and (lm.unpack(lm.pack(x), np.uint64) == x).all()


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 400), min_size=1), st.sets(st.integers(0, 400), min_size=1), st.floats(0.05, 1))
def test_pruned_jaccard(x, y, threshold):
    a, b = (np.array(sorted(s), np.uint64) for s in (x, y))
    exact, got = len(x & y) / len(x | y), spotsigs.similar(a, b, threshold)
    assert spotsigs.likeness(a, b) == exact
    assert got == exact if exact > threshold + 1e-9 else got is None or abs(got - threshold) < 1e-9 or got == exact


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé", max_size=30), min_size=1, max_size=6), st.integers(2, 9))
def test_anchors_cover_every_window(texts, width):
    gram = max(1, width // 3)
    raw = [t.encode() for t in texts]
    tokens = suffixes.Tokens("bytes")
    sizes = np.array([len(t) for t in raw])
    if not sizes.sum():
        return
    stops = np.cumsum(sizes)
    place, first, last, minimiser, _ = suffixes.runs(tokens.values(tokens.stored(b"".join(raw))), stops - sizes, stops, width, gram)
    covered = sorted(s for a, b in zip(first.tolist(), last.tolist()) for s in range(a, b + 1))
    assert covered == [int(s) for b, e in zip(stops - sizes, stops) for s in range(b, e - width + 1)]
    whole = b"".join(raw)
    key = {}
    for p, a, b, m in zip(place.tolist(), first.tolist(), last.tolist(), minimiser.tolist()):
        for s in range(a, b + 1):
            assert key.setdefault(whole[s : s + width], (m, p - s)) == (m, p - s)  # equal windows, equal first digit and place
