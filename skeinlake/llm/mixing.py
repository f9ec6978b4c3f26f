"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

A document's expected copies are its source's target over its source's size, the same for every document
of the source.  Documents of a source stand in a fixed order; with the running sum of expected copies and
one offset a source, a document is emitted once for each integer that its stretch of the sum crosses.
Ordering by size makes the words taken follow the target closely.

The running sum is a rank, found in steps so that no task holds a source: documents are dealt into
(source, size band, salt) cells, ranked within the cell, and the cells' counts are summed over the cells
that come before.  The salts of a source's band follow the number of its own documents, so a cell stays
small whatever share of the rows a source or one size has, and only bands above a cell's size have salts.

Targets: every source gets a share of ``total`` by its weight, at most ``most`` times its size; what
stands above is shared again by weight among the others until none is above.  Sources are ranked in two
steps too, within ranges and over the ranges' counts.  The level at which the shares settle is looked for in
a histogram of the sources' caps over weights, whose rows are octaves' parts and not sources.

Defined results: null text has size 0; the null source is a source of its own and comes last; documents
of size 0 take part with 0 words; a source whose words are all 0 has target 0; repeated rows are separate
documents, ranked by (size, id, text digest); an empty table gives an empty result; columns keep their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlake.llm.common import digest_pair, free_name, keep, read_table, shuffle_partitions

# The mixture of the query.
WEIGHTS, TOTAL, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
WORD = r"[^\x20\x09-\x0D]+"
#: Documents that a cell of (source, size band, salt) is to hold, about; smaller bands are one cell.
CELL = 2_000
PARTS = 16  # of an octave, in the histogram of caps over weights
SEED = "mix"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fraction(key: Column, digits: int = 8) -> Column:
    """A fixed number in [0, 1) from a string, equal in any engine that has md5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, digits), 16, 10).cast("double") / F.lit(float(16**digits))


def band(size: Column) -> Column:
    """Bits of the size and its next bit: two bands for each doubling."""
    bits = F.length(F.bin(size))
    return F.when(size < 2, size).otherwise(2 * bits + F.substring(F.bin(size), 2, 1).cast("long"))


def placed(per: DataFrame) -> DataFrame:
    """Rows of sources with their place in the order of code points, null last: places within ranges, then the ranges' counts."""
    dealt = keep(per.repartitionByRange(shuffle_partitions(per.sparkSession), F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "mix-ranges")
    ranges = dealt.groupBy("range").agg(F.count("*").alias("n"))  # one row a shuffle partition
    before = ranges.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    return dealt.withColumn("within", within).join(before, "range").withColumn("place", F.col("before") + F.col("within")).drop("range", "within", "before")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """Source, its size, documents and target, from rows (source, size)."""
    per = placed(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    weight = reduce(lambda out, i: out.when(F.col("place") % len(weights) == i, F.lit(float(weights[i]))), range(1, len(weights)), F.when(F.col("place") % len(weights) == 0, F.lit(float(weights[0]))))
    cap = F.col("source_size") * F.lit(float(most))
    per = keep(per.withColumn("weight", weight).withColumn("cap", cap).drop("place"), "mix-weights")
    # a source is full at a level of cap / weight; the histogram has a row for each PARTS-th of an octave of it
    part = F.when(F.col("cap") > 0, F.floor(F.log2(F.col("cap") / F.col("weight")) * PARTS)).otherwise(F.lit(-1 << 40))
    rows = per.groupBy(part.alias("part")).agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight"), F.sum("source_size").alias("size")).orderBy("part").collect()
    whole, open_, held, low = sum(r["size"] or 0 for r in rows) * float(total), sum(r["weight"] for r in rows), 0.0, None
    for r in rows:  # parts that are full for certain: their upper edge lies below the level that the others would have
        left = open_ - r["weight"]
        if left <= 1e-12 * open_ or (whole - held - r["cap"]) / left <= 2.0 ** ((r["part"] + 1) / PARTS):
            break
        held, open_, low = held + r["cap"], left, r["part"]
    level, full = 0.0, part <= F.lit(low if low is not None else -1 << 41)
    while rows:  # within the part where the level lies
        row = per.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        new = (whole - row["held"]) / row["open"]
        if new <= level:
            break
        level = new
        full = F.col("cap") <= F.col("weight") * F.lit(level)
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level))
    return per.select("source", "source_size", "n_docs", F.round(target, 6).alias("target"))


def mix(df: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: id, source, size, its source's size and target, and the number of copies that the mix takes."""
    sized = keep(
        df.select(row_key(df, id_col, text_col, source_col).alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col).cast("string")).alias("size"), F.md5(F.col(text_col).cast("string").cast("binary")).alias("tie")),
        "mix-sizes",
    )
    source_key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))
    per = targets(sized, weights, total, most).select(source_key.alias("source_key"), "source_size", "target")
    dealt = sized.withColumn("source_key", source_key).withColumn("band", band(F.col("size")))
    # a band's salts follow its documents; the documents of the bands before it stand before it
    bands = dealt.groupBy("source_key", "band").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source_key").orderBy("band")) - F.col("n")
    bands = keep(bands.select("source_key", "band", F.greatest(F.lit(1), F.floor(F.col("n") / CELL)).cast("long").alias("salts"), before.alias("before_band")).join(per, "source_key"), "mix-bands")
    salt = F.pmod(F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(SEED)).cast("binary")), 1, 8), 16, 10).cast("long"), F.col("salts"))
    cell = ["source_key", "band", "salt"]
    salted = dealt.join(bands, ["source_key", "band"]).withColumn("salt", salt)
    counts = salted.filter("salts > 1").groupBy(*cell).agg(F.count("*").alias("n"))
    in_band = counts.select(*cell, (F.sum("n").over(Window.partitionBy("source_key", "band").orderBy("salt")) - F.col("n")).alias("before_cell"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*cell).orderBy(F.col("size"), F.col("doc_id").asc_nulls_last(), "tie")))
    out = ranked.join(in_band, cell, "left")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = fraction(F.concat(F.col("source_key"), F.lit(SEED)))
    at = F.col("before_band") + F.coalesce("before_cell", F.lit(0)) + F.col("rank")
    copies = (F.floor(each * at + start) - F.floor(each * (at - 1) + start)).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), "row")


def row_key(df: DataFrame, id_col: str, text_col: str, source_col: str) -> Column:
    return digest_pair(df[id_col], df[source_col], df[text_col])


def take(df: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix, all columns, each as often as it was taken; of rows with the same key each has its own count."""
    h, k, copies, n = (free_name(df, x) for x in ("h", "k", "copies", "n"))
    # the key's two halves are columns of their own: a struct would be cast in the join, and the texts dealt out again for the window
    counts = mixed.groupBy(F.col("row.h").alias(h), F.col("row.k").alias(k)).agg(F.sort_array(F.collect_list("copies")).alias(copies))
    key = row_key(df, id_col, text_col, source_col)
    joined = df.select("*", key["h"].alias(h), key["k"].alias(k)).join(counts.filter(F.exists(copies, lambda x: x > 0)), [h, k])
    nth = F.row_number().over(Window.partitionBy(h, k).orderBy(F.lit(0)))
    own = joined.withColumn(n, F.element_at(copies, nth).cast("int")).filter(F.col(n) > 0)
    return own.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*df.columns)


def mixture(df: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``mix`` applied: the rows of ``df`` as often as the mix takes them."""
    return take(df, keep(mix(df, weights, total, most, id_col, text_col, source_col), "mix-taken"), id_col, text_col, source_col)


def query(spark, sf_dir: str) -> DataFrame:
    out = mix(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def oracle(weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST) -> str:
    """The same mix in DuckDB SQL: targets by sorting sources by cap over weight, one ranking a source."""
    case = " ".join(f"WHEN {i} THEN {w!r}" for i, w in enumerate(weights))
    return f"""
    WITH d AS (SELECT doc_id, source, md5(text) AS tie,
                      CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {case} END::DOUBLE AS weight, source_size * {most!r}::DOUBLE AS cap FROM s),
    o AS (SELECT *, coalesce(sum(cap) OVER before, 0) AS held, (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER before, 0) AS open,
                 (SELECT sum(source_size) FROM w) * {total!r}::DOUBLE AS whole FROM w
          WINDOW before AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT coalesce(arg_min((whole - held) / open, cap / weight) FILTER (WHERE cap > weight * ((whole - held) / open)), max(cap / weight)) AS level FROM o),
    t AS (SELECT source, source_size, round(least(cap, weight * level), 6) AS target FROM w, l),
    b AS (SELECT d.*, coalesce('s' || source, 'null') AS source_key,
                 CASE WHEN size < 2 THEN size ELSE 2 * length(bin(size)) + CAST(substr(bin(size), 2, 1) AS BIGINT) END AS band FROM d),
    c AS (SELECT b.*, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '{SEED}'), 1, 8) AS BIGINT)
                 % greatest(1, count(*) OVER (PARTITION BY source_key, band) // {CELL}) AS salt FROM b),
    r AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY band, salt, size, doc_id NULLS LAST, tie) AS place,
                 CAST('0x' || substr(md5(source_key || '{SEED}'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS phase FROM c),
    x AS (SELECT r.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
    y AS (SELECT *, CAST(floor(rate * place + phase) - floor(rate * (place - 1) + phase) AS BIGINT) AS copies FROM x)
    SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM y
    """
