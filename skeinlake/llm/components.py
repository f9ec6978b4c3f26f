"""Connected components of an edge table, by alternating large and small stars.

The stars halve the longest path each round, so rounds are about the logarithm of it; they go on until
nothing changes.  A node's neighbours meet their least by a joined aggregate; the rows of a hub are dealt by
salt, so that no task holds all of them.

Defined results: links of a node to itself and repeated links say nothing; a null end drops the link; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlake.llm.common import discard, each_salt, keep, salt_mask, salt_of

#: Shares that the rows of a node are dealt into where they meet its least neighbour.
SALTS = 16


def _meet(rows: DataFrame, least: DataFrame) -> DataFrame:
    """``rows`` (a, b, salt) with ``m`` of their node, salt by salt."""
    return rows.join(least.select("a", "m", each_salt(F.col("salts"), SALTS).alias("salt")), ["a", "salt"])


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, label) for every node of ``edges`` (columns a, b; any order, repeats allowed): label is the smallest node reachable.

    Each round is written to the shared folder and the one before removed, so lineage stays short and lost
    executors cost one round.
    """
    salt = salt_of(F.col("b"), SALTS).alias("salt")
    low = F.min("b").alias("m"), salt_mask(F.col("salt")).alias("salts")
    now = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    before = None
    while True:
        # large star: every neighbour above a node goes to the least of the node and its neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))).select("a", "b", salt)
        least = both.groupBy("a").agg(*low).select("a", F.least("a", "m").alias("m"), "salts")
        large = keep(_meet(both.filter("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), f"{tag}-large")
        # small star: a node and its neighbours below go to the least of them
        dealt = large.select("a", "b", salt)
        least = dealt.groupBy("a").agg(*low)
        small = _meet(dealt, least).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = keep(small.filter("a <> b").distinct(), tag)
        discard(now, large)
        now = after
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            roots = now.select(F.col("b").alias("node")).distinct()
            out = keep(now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots.select("node", F.col("node").alias("label"))), f"{tag}-labels")
            discard(now)
            return out
        before = state
