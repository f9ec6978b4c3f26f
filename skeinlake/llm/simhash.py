"""SimHash near-duplicates, linked through BK-trees.

A text's fingerprint has bit i where more than half of its shingles' XXH64 hashes have it.  Distinct
fingerprints are dealt into shards so that any two within the radius r share one: of r + s bit blocks at
least s are equal, so each of the C(r + s, s) sets of blocks gives a shard key (s = 2, or more for corpora
whose unrelated fingerprints would crowd the shards).  A task holds the
BK-trees of its shards as one forest: a node's children are keyed by their Hamming distance to it, and a
search follows only the edges within the radius of the query's own distance, all queries a level at a
time.  The shards' trees are dealt to the tasks by key rather than broadcast, because together they grow
with the corpus.  A task returns a star for each group that it links, not the pairs, and
the groups are joined over shards by connected components.

Defined results: a null or blank text has fingerprint 0 and is linked like any other; fewer words than a
shingle form one shingle; equal fingerprints are one class, whatever number of rows carry it; repeated
rows and null ids keep their rows, component ids ignore null ids; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlake.llm.common import discard, each_salt, free_name, keep, numbered, parted, raw, read_table, salt_mask, salt_of, shuffle_partitions, slices
from skeinlake.llm.components import components
from skeinlake.llm.suffixes import mix

SHINGLE, SEED, RADIUS, BITS = 4, 42, 4, 64
#: Unrelated fingerprints that a shard is to hold, about.
SHARD = 16
#: (query, node) pairs on the frontier of a search at once.
FRONTIER = 1 << 19


def shingles(text: bytes, n: int = SHINGLE) -> list[bytes]:
    words = text.lower().split()
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - n].tolist()]
    return [joined[a:b] for a, b in zip(starts, (ends[n - 1 :] - 1).tolist())]


def hashes(pieces: list[bytes], seed: int = SEED) -> np.ndarray:
    import xxhash

    one = xxhash.xxh64_intdigest
    return np.array([one(x, seed) for x in pieces], np.uint64)


def fingerprint_of(h: np.ndarray) -> int:
    """Bits set in over half of the hashes, as an unsigned number."""
    if not len(h):
        return 0
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(h)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            prints = np.array([fingerprint_of(hashes(shingles(t, shingle))) for t in raw(part.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints)], names=["doc_id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def masks(radius: int, spare: int = 2) -> list[int]:
    """Bit masks of ``spare`` blocks of radius + spare, as signed longs; two fingerprints within the radius agree on one at least."""
    cuts = [round(i * BITS / (radius + spare)) for i in range(radius + spare + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    whole = [sum(x) for x in combinations(blocks, spare)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in whole]


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits, of one word a fingerprint or several."""
    d = np.bitwise_count(a ^ b)
    return (d if d.ndim == 1 else d.sum(axis=1)).astype(np.int64)


def spare_blocks(n: int, radius: int, crowd: int = SHARD) -> int:
    """Fewest equal blocks a key, from two on, at which unrelated fingerprints fill a shard with ``crowd`` at most; more blocks make longer keys and more of them."""
    spare = 2
    while spare < 5 and n > crowd << int(BITS * spare / (radius + spare)):
        spare += 1
    return spare


class Forest:
    """BK-trees of many shards in arrays; ``shard`` is sorted.  Equal fingerprints hang below each other at distance 0."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        n = len(fp)
        self.fp, self.bits = fp, BITS * (1 if fp.ndim == 1 else fp.shape[1])
        step = self.bits + 1
        first = np.r_[True, shard[1:] != shard[:-1]] if n else np.zeros(0, bool)
        self.root = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, np.int64)
        parent, distance = np.full(n, -1), np.zeros(n, np.int64)
        active = np.nonzero(~first)[0]
        at = self.root[active]
        while len(active):  # a level of all trees at a time: the first with a distance becomes the child, the others go below it
            d = hamming(fp[active], fp[at])
            key = at * step + d
            order = np.argsort(key, kind="stable")
            new = np.r_[True, key[order][1:] != key[order][:-1]]
            child = active[order][new][np.cumsum(new) - 1]
            parent[active[order][new]], distance[active[order][new]] = at[order][new], d[order][new]
            active, at = active[order][~new], child[~new]
        nodes = np.nonzero(parent >= 0)[0]
        key = parent[nodes] * step + distance[nodes]
        order = np.argsort(key, kind="stable")
        self.edge, self.child = key[order], nodes[order]

    def near(self, fp: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) positions within the radius, for fingerprints that each ask the tree at a root."""
        step = self.bits + 1
        for some in np.array_split(np.arange(len(fp)), max(1, -(-len(fp) // 20_000))):
            stack = [(some, roots[some])]
            while stack:
                q, node = stack.pop()
                if len(q) > FRONTIER:
                    half = len(q) // 2
                    stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                    continue
                d = hamming(fp[q], self.fp[node])
                hit = d <= radius
                if hit.any():
                    yield q[hit], node[hit]
                low = np.searchsorted(self.edge, node * step + np.maximum(d - radius, 0))
                high = np.searchsorted(self.edge, node * step + np.minimum(d + radius, self.bits), side="right")
                n = high - low
                if n.sum():
                    ahead = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                    stack.append((np.repeat(q, n), self.child[ahead]))

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) positions within the radius in the query's own tree, the node before the query."""
        for q, node in self.near(self.fp[queries], self.root[queries], radius):
            q = queries[q]
            before = node < q
            if before.any():
                yield q[before], node[before]


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of n positions over the links a-b."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def shard_stars(shard: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of each linked group of a shard to its first member."""
    size = np.bincount(np.cumsum(np.r_[True, shard[1:] != shard[:-1]]) - 1)
    several = np.repeat(size > 1, size)
    shard, fp = shard[several], fp[several]
    if not len(fp):
        return fp, fp
    forest = Forest(shard, fp)
    label = np.arange(len(fp))
    found_a, found_b, held = [], [], 0
    for a, b in forest.search(np.arange(len(fp)), radius):
        found_a.append(a)
        found_b.append(b)
        held += len(a)
        if held > FRONTIER:  # fold the links found so far into stars
            label = least_labels(len(fp), np.r_[np.concatenate(found_a), np.arange(len(fp))], np.r_[np.concatenate(found_b), label])
            found_a, found_b, held = [], [], 0
    label = least_labels(len(fp), np.concatenate([*found_a, np.arange(len(fp))]), np.concatenate([*found_b, label]))
    linked = label != np.arange(len(fp))
    return fp[linked], fp[label[linked]]


def links(prints: DataFrame, radius: int = RADIUS, spare: int = 2) -> DataFrame:
    """Star links (a, b) that join exactly the distinct fingerprints (column fp) within ``radius``, directly or through others."""
    parts = [F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks(radius, spare))]
    dealt = prints.select("fp", F.explode(F.array(*parts)).alias("k")).select(F.xxhash64("k.c", "k.v").alias("shard"), "fp")
    n = shuffle_partitions(prints.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:  # whole shards only; the last one may go on
            shard = np.r_[shard, batch.column(0).to_numpy()]
            fp = np.r_[fp, batch.column(1).to_numpy().view(np.uint64)]
            whole = int(np.searchsorted(shard, shard[-1])) if len(shard) else 0
            if whole > 200_000:
                yield out(*shard_stars(shard[:whole], fp[:whole], radius))
                shard, fp = shard[whole:], fp[whole:]
        if len(shard):
            yield out(*shard_stars(shard, fp, radius))

    return dealt.repartition(n, "shard").sortWithinPartitions("shard", "fp").mapInArrow(run, "a long, b long")


def groups(prints: DataFrame, radius: int = RADIUS, crowd: int = SHARD) -> DataFrame:
    """Per row of (doc_id, fp): the same with ``component_id``, the smallest id reachable."""
    classes = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-classes")
    spare = spare_blocks(classes.count(), radius, crowd)
    labels = components(links(classes.select("fp"), radius, spare), "simhash")
    labelled = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), "least_id")
    least = labelled.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_fp = keep(labelled.select("fp", "label").join(least, "label").select("fp", "component_id"), "simhash-labels")
    return prints.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def query(spark, sf_dir: str) -> DataFrame:
    prints = keep(fingerprints(read_table(spark, sf_dir, "documents")), "simhash-prints")
    return groups(prints).select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


# Near-duplicate removal.  64 bits tell texts apart that share eight or nine tenths of their shingles only
# within a wide radius, which no set of shard keys can cover.  Here the fingerprint has 512 bits, whose share of
# equal ones measures the likeness to a few hundredths, and the shard keys are least hashes of the shingle set: their
# number is fixed by the recall, not by the corpus.
PARTS = 8
LONG = PARTS * BITS
NEAR_SHINGLE, SIMILARITY, SLACK = 5, 0.8, 0.25
#: Shard keys a text, and least hashes in each: two texts of likeness s share a key with probability 1 - (1 - s ** HASHES) ** KEYS, 0.9996 at 0.8.
KEYS, HASHES = 20, 5
#: Texts of one shard whose BK-tree is searched in one task; a larger shard is cut into so many trees.
BLOCK = 2048
SALTS = 32
PARITY, PAIRS = 2048, 1 << 14  # bits of a set's parities; pairs whose parities are compared at once
PART_SEEDS = mix(np.arange(1, PARTS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LEAST_SEEDS = mix(np.arange(1, 2 * KEYS * HASHES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)).reshape(2, -1)
LANES = np.array([sum((b >> i & 1) << 8 * i for i in range(8)) for b in range(256)], np.uint64)

SIGNATURES = "row long, doc_id long, words binary, shards array<long>"
SETS = "row long, held binary, size long, odd binary, long_fp binary"
DEALT = "tree long, query boolean, node boolean, row long, label long, size long, odd binary, long_fp binary"


def long_fingerprint(h: np.ndarray) -> np.ndarray:
    """Majority bits of the hashes under eight seeds."""
    if not len(h):
        return np.zeros(PARTS, np.uint64)
    every = np.c_[h, mix(h[:, None] ^ PART_SEEDS)].astype("<u8").view(np.uint8)
    counts = np.zeros(LONG, np.int64)
    for at in range(0, len(h), 255):  # eight counters of a byte each share a word
        counts += LANES[every[at : at + 255]].sum(axis=0).view(np.uint8)
    return np.packbits(2 * counts > len(h), bitorder="little").view("<u8")


def share_of(similarity: float) -> float:
    """Share of bits that differ between two sets of this Jaccard likeness, on average: their angle over a half turn."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def shard_keys(h: np.ndarray) -> np.ndarray:
    """Keys of a set of hashes: each mixes its number and the least of the hashes under several multipliers."""
    if not len(h):
        return np.zeros(0, np.int64)
    least = np.full(KEYS * HASHES, np.uint64(2**64 - 1))
    for at in range(0, len(h), 2048):
        least = np.minimum(least, (h[at : at + 2048, None] * (LEAST_SEEDS[0] | np.uint64(1)) + LEAST_SEEDS[1]).min(axis=0))
    key = np.arange(1, KEYS + 1, dtype=np.uint64)
    for part in least.reshape(HASHES, KEYS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + part)
    return key.view(np.int64)


def signatures(rows: DataFrame, shingle: int, number: str, id_col: str, text_col: str) -> DataFrame:
    """Per row: its number, id, digest of the lower-cased words and the shard keys of the distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in slices(batches, column=2):
            texts = raw(part.column(2))
            keys = [shard_keys(np.unique(hashes(shingles(t, shingle)))) for t in texts]
            words = [xxhash.xxh3_128_digest(b" ".join(t.lower().split())) for t in texts]
            ends = np.cumsum([0, *map(len, keys)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words, pa.binary()), lists], names=["row", "doc_id", "words", "shards"])

    return rows.select(F.col(number).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, SIGNATURES)


def parity(held: np.ndarray) -> np.ndarray:
    """Bit i is whether an odd number of the set's hashes fall on i: the bits in which two sets differ are no more than the members in which they do."""
    counts = np.bincount((held & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY)
    return np.packbits((counts & 1).astype(bool), bitorder="little").view("<u8")


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """Of rows (row, text): the whole set of shingle hashes, its size and parities, and the long fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [np.unique(hashes(shingles(t, shingle))) for t in raw(part.column(1))]
            columns = [pa.array([f(x).tobytes() for x in sets], pa.binary()) for f in (np.asarray, parity, long_fingerprint)]
            yield pa.RecordBatch.from_arrays([part.column(0), columns[0], pa.array(list(map(len, sets)), pa.int64()), *columns[1:]], names=[x.split()[0] for x in SETS.split(", ")])

    return texts.select("row", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, SETS)


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets have the likeness.

    A row with many partners has its set dealt once to each salt of theirs, so no task holds all its pairs.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            hit = []
            for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(common >= similarity * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

    def with_set(rows: DataFrame, side: str, other: str, name: str) -> DataFrame:
        rows = rows.withColumn("salt", salt_of(F.col(other), SALTS))
        needs = rows.groupBy(side).agg(salt_mask(F.col("salt")).alias("mask")).select(side, each_salt(F.col("mask"), SALTS).alias("salt"))
        return rows.join(sets.select(F.col("row").alias(side), F.col("held").alias(name)).join(needs, side), [side, "salt"]).drop("salt")

    return with_set(with_set(pairs, "a", "b", "x"), "b", "a", "y").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def tree_pairs(members: DataFrame, radius: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) with different labels that share a shard and lie within the radius in its BK-trees, except where set sizes and parities exclude the likeness.

    ``members``: (shard, row, label, size, odd, long_fp).  In a shard with one label nothing is left to
    find; in others the texts that do not have the label of the shard's first row ask its trees.  A shard
    above ``block`` texts is dealt as several trees, and those texts ask each; they pass a task in batches.
    """
    state = members.groupBy("shard").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.struct("row", "label")).alias("first"), salt_mask(F.col("salt")).alias("mask"))
    mixed = state.filter("low < high").select("shard", F.col("first.label").alias("main"), F.ceil(F.col("n") / block).cast("int").alias("trees"), each_salt(F.col("mask"), SALTS).alias("salt"))
    own = F.pmod(F.xxhash64("row"), F.col("trees")).cast("int")
    asks = F.col("label") != F.col("main")
    every = F.transform(F.sequence(F.lit(0), F.col("trees") - 1), lambda t: F.struct(t.alias("at"), F.lit(True).alias("query"), (t == own).alias("node")))
    places = F.when(asks, every).otherwise(F.array(F.struct(own.alias("at"), F.lit(False).alias("query"), F.lit(True).alias("node"))))
    dealt = members.join(mixed, ["shard", "salt"]).withColumn("place", F.explode(places))
    dealt = dealt.select(F.xxhash64("shard", "place.at").alias("tree"), "place.query", "place.node", "row", "label", "size", "odd", "long_fp")

    def numbers(column: pa.Array, width: int) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def found(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            tree, query, node, row, label, size, odd, fp = rows
            nodes, queries = np.nonzero(node)[0], np.nonzero(query)[0]
            if not len(nodes) or not len(queries):
                return
            forest = Forest(tree[nodes], fp[nodes])
            at = np.searchsorted(tree[nodes], tree[queries])
            known = np.nonzero((at < len(nodes)) & (tree[nodes][np.minimum(at, len(nodes) - 1)] == tree[queries]))[0]
            queries, at = queries[known], forest.root[at[known]]
            for q, n in forest.near(fp[queries], at, radius):
                a, b = queries[q], nodes[n]
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
                for i in range(0, len(a), PAIRS):
                    x, y = a[i : i + PAIRS], b[i : i + PAIRS]
                    least = np.maximum(hamming(odd[x], odd[y]), np.abs(size[x] - size[y]))
                    may = least <= (size[x] + size[y]) * (1 - similarity) / (1 + similarity) + 1e-6
                    if may.any():
                        x, y = row[x[may]], row[y[may]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:6]] + [numbers(batch.column(6), PARITY // BITS), numbers(batch.column(7), PARTS)]
            held = [np.concatenate(x) for x in zip(held, new)] if held else new
            if len(held[0]) < 8 * BLOCK:
                continue
            # trees before the last are whole; of the last, once its nodes are, only they wait for further queries
            last = int(np.searchsorted(held[0], held[0][-1]))
            going = np.arange(last, len(held[0]))
            if held[2][-1]:
                yield from found([x[:last] for x in held])
                held = [x[last:] for x in held]
            else:
                yield from found(held)
                held = [x[going[held[2][last:]]] for x in held]
                held[1] = np.zeros(len(held[0]), bool)
        if held:
            yield from found(held)

    n = shuffle_partitions(members.sparkSession)
    return dealt.repartition(n, "tree").sortWithinPartitions(F.col("tree"), F.col("node").desc()).mapInArrow(run, "a long, b long").distinct()


def dedup(df: DataFrame, similarity: float = SIMILARITY, shingle: int = NEAR_SHINGLE, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of ``df`` with one row of each group of near-duplicates, the one with the smallest id.

    Texts with the same lower-cased words are one class.  Classes that share a shard are candidates.  First
    each meets the shard's first row: compared exactly, that joins most of a group with one comparison a
    row, however large the shard.  Then, in shards that still hold several groups, the BK-trees of the long
    fingerprints give every pair of different groups within the radius of ``similarity - SLACK``, and each is
    compared exactly on whole shingle sets unless sizes and parities exclude the likeness.  Nothing below
    ``similarity`` is linked, and no candidate is given up before it was compared or joined.

    Defined results: blank and null texts are one class; of repeated rows one stays; null ids come last, ties
    on the id are broken by the row's place; an empty table gives an empty result; columns keep their names.
    """
    number = free_name(df, "number")
    rows = numbered(df, "simhash-rows", number)
    prints = keep(signatures(rows, shingle, number, id_col, text_col), "simhash-signatures")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = keep(prints.groupBy("words").agg(F.min(order).alias("least"), F.min("shards").alias("shards")).select(F.col("least.row").alias("row"), F.col("least.doc_id").alias("doc_id"), "shards"), "simhash-texts")

    dealt = classes.select("row", F.explode("shards").alias("shard"), salt_of(F.col("row"), SALTS).alias("salt"))
    first = dealt.groupBy("shard").agg(F.count("*").alias("n"), F.min("row").alias("first"), salt_mask(F.col("salt")).alias("mask")).filter("n > 1")
    members = keep(dealt.join(first.select("shard", "first", each_salt(F.col("mask"), SALTS).alias("salt")), ["shard", "salt"]), "simhash-members")
    wanted = keep(members.select(F.col("row").alias(number)).distinct(), "simhash-wanted")
    asked, _ = parted(rows.select(number, text_col), number, wanted, "simhash-marks")
    sets = keep(shingle_sets(asked.join(wanted, number).select(F.col(number).alias("row"), F.col(text_col).alias("text")), shingle), "simhash-sets")

    met = keep(members.filter("row <> first").select(F.col("first").alias("a"), F.col("row").alias("b")).distinct(), "simhash-first")
    links_ = keep(alike(met, sets, similarity), "simhash-links")
    labels = components(links_, "simhash-near")
    labelled = members.join(labels.withColumnRenamed("node", "row"), "row", "left").select("shard", "salt", "row", F.coalesce("label", "row").alias("label"))
    radius = int(np.ceil(LONG * share_of(max(0.05, similarity - SLACK))))
    rest = keep(tree_pairs(labelled.join(sets.drop("held"), "row"), radius, similarity, block).join(met, ["a", "b"], "left_anti"), "simhash-rest")
    more = keep(alike(rest, sets, similarity), "simhash-more")
    labels = components(links_.unionByName(more), "simhash-near")

    of_class = classes.select("row", "doc_id").join(labels.withColumnRenamed("node", "row"), "row", "left").select("row", "doc_id", F.coalesce("label", "row").alias("label"))
    stays = of_class.groupBy("label").agg(F.min(order).alias("least")).select("least.row")
    gone = keep(prints.select("row").join(stays, "row", "left_anti").select(F.col("row").alias(number)), "simhash-gone")
    asked, others = parted(rows, number, gone, "simhash-marks")
    discard(prints, classes, members, wanted, sets, met, links_, rest, more, labels)
    return asked.join(gone, number, "left_anti").select(*df.columns).unionByName(others.select(*df.columns))
