import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
import oracle  # noqa: E402
import pytest  # noqa: E402

from skeinlake.llm import mixing  # noqa: E402


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_as_sql(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    assert oracle.differences(spark, oracle.connect(sf_dir), sf_dir, mixing.query, mixing.oracle()) == ""


def shared(sizes, weights=(3, 1, 2), total=1.5, most=2):
    """Shares by weight; what is above a cap goes to the others, again and again."""
    names = sorted(sizes)
    w = {k: weights[i % 3] for i, k in enumerate(names)}
    out, left, open_ = {}, sum(sizes.values()) * total, set(names)
    while open_:
        level = left / sum(w[k] for k in open_)
        over = {k for k in open_ if most * sizes[k] < w[k] * level}
        if not over:
            out |= {k: w[k] * level for k in open_}
            break
        for k in over:
            out[k] = most * sizes[k]
            left -= out[k]
        open_ -= over
    return out


def test_targets_and_words_taken(spark):
    rows = mixing.query(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    sizes, taken, target = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    want = shared(sizes)
    for k in sizes:
        assert abs(target[k] - want[k]) < 1e-3
        assert abs(taken[k] - want[k]) < 0.05 * want[k]


def test_edges(spark):
    schema = "doc_id long, text string, source string, size long, copies string, rank int"
    rows = [(1, "a b", "x", 0, "", 1), (1, "a b", "x", 0, "", 1), (2, None, None, 0, "", 1), (3, "", "y", 0, "", 1), (None, "q\tw\x0be", None, 0, "", 1), (4, "c " * 50_000, "x", 0, "", 1)]
    out = mixing.mix(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == len(rows) and sorted(r.size for r in out) == [0, 0, 2, 2, 3, 50_000]
    assert all(r.copies <= 2 for r in out) and {r.source for r in out} == {"x", "y", None}
    assert [r.target for r in out if r.source == "y"] == [0.0]
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    again = mixing.mix(spark.createDataFrame(rows, schema).repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
