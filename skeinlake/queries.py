"""Registered relational and approximate queries, with the SQL that states each."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlake.functions import scalar
from skeinlake.operators.approx import SampledRelation, mean_percent_error, trial_means
from skeinlake.operators.sampling import BUCKETS, SamplePlan, between, contiguous_by_order, file_counts, fixed_size, sample, sample_by_key, spread_sql
from skeinlake.operators.stats import TableStats, collect_stats, load_stats, save_stats, stats_table, within_sigma
from skeinlake.plans.session import Engine
from skeinlake.sources import output
from skeinlake.sources.catalog import SnapshotStore, column_tables, error_kind, format_line, import_delimited, parse, read_delimited, rows
from skeinlake.sources.shared import fresh

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
Query = Callable[[SparkSession, str], DataFrame]


def _sql(text: str) -> Query:
    named = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    return lambda spark, sf_dir: Engine.open(spark, sf_dir, named).sql(text)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Queries whose text both engines read alike.  The first six are the benchmark's questions, adapted; their column names are fixed values.
SHARED: dict[str, str] = {
    "tq1_avg_by_flag_status": """SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price,
        round(avg(l_discount), 6) AS avg_disc FROM lineitem GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    "tq2_discount_by_priority": """SELECT o_orderpriority, round(avg(l_discount), 6) AS avg_discount FROM orders JOIN lineitem ON o_orderkey = l_orderkey
        GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    "tq3_order_price_by_region": """SELECT r_name AS region_name, round(avg(o_totalprice), 4) AS avg_order_price FROM region JOIN nation ON r_regionkey = n_regionkey
        JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY r_name ORDER BY avg_order_price DESC, region_name""",
    "tq4_top_customers": """SELECT c_custkey, round(avg(o_totalprice), 4) AS avg_price FROM customer JOIN orders ON c_custkey = o_custkey
        GROUP BY c_custkey ORDER BY avg_price DESC, c_custkey LIMIT 10""",
    "tq5_top_suppliers": """SELECT s_name AS supplier_name, round(avg(l_quantity), 6) AS avg_quantity FROM supplier JOIN lineitem ON s_suppkey = l_suppkey
        GROUP BY s_name ORDER BY avg_quantity DESC, s_name LIMIT 10""",
    "tq6_qty_col_vs_col": """SELECT l_returnflag, round(avg(l_quantity), 6) AS avg_quantity_shipped FROM orders JOIN lineitem ON o_orderkey = l_orderkey
        WHERE o_orderdate <= l_shipdate GROUP BY l_returnflag ORDER BY avg_quantity_shipped DESC, l_returnflag""",
    "scan": "SELECT * FROM nation",
    "project_expr": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem",
    "project_const": "SELECT 1 AS one, n_name FROM nation",
    "distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "distinct_star": "SELECT DISTINCT * FROM region",
    "select_star_limit_ordered": "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "filter_eq": "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'",
    "filter_neq": "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'",
    "filter_range": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20.5 AND l_discount <= 0.05",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%A%'",
    "filter_and": "SELECT o_orderkey FROM orders WHERE o_totalprice > 50000 AND o_orderstatus = 'O' AND o_custkey < 1000",
    "filter_or_in_between": "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'F') AND (o_totalprice BETWEEN 1000 AND 90000 OR NOT o_custkey > 10)",
    "filter_col_col": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount < l_tax",
    "filter_const_left": "SELECT l_orderkey FROM lineitem WHERE 25 < l_quantity",
    "join_string_key": "SELECT a.n_name, b.n_nationkey FROM nation a JOIN nation b ON a.n_name = b.n_name",
    "join_int_key": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_mixed_numeric": """SELECT p.p_size, p.n_parts, l.n_lines FROM (SELECT p_size, count(*) AS n_parts FROM part GROUP BY p_size) p
        JOIN (SELECT l_quantity, count(*) AS n_lines FROM lineitem GROUP BY l_quantity) l ON p.p_size = l.l_quantity""",
    "join_expr_key": "SELECT a.n_nationkey AS left_key, b.n_nationkey AS right_key FROM nation a JOIN nation b ON a.n_nationkey + 7 = b.n_nationkey * 2",
    "join_where_implicit": "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND n_nationkey > 3",
    "join_self_alias": "SELECT a.r_name AS left_name, b.r_name AS right_name FROM region a JOIN region b ON a.r_regionkey = b.r_regionkey",
    "join_derived": """SELECT c.c_custkey, o.total FROM customer c JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) o
        ON c.c_custkey = o.o_custkey""",
    "join_composite": """SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem) a
        JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber""",
    "join_on_residual": "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey AND c_acctbal > 1000",
    "agg_count": "SELECT count(*) AS n, count(o_custkey) AS n_cust FROM orders",
    "agg_sum": "SELECT CAST(sum(o_orderkey) AS BIGINT) AS sum_keys, round(sum(o_totalprice), 2) AS sum_price FROM orders",
    "agg_avg": "SELECT o_orderstatus, round(avg(o_totalprice), 4) AS avg_price FROM orders GROUP BY o_orderstatus",
    "agg_minmax_num": "SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, min(l_partkey) AS lo_part, max(l_partkey) AS hi_part FROM lineitem",
    "agg_minmax_str": "SELECT min(c_name) AS lo, max(c_name) AS hi FROM customer",
    "agg_expr_of_aggs": "SELECT l_returnflag, min(l_quantity) + max(l_quantity) AS edge_sum FROM lineitem GROUP BY l_returnflag",
    "agg_sum_expr": "SELECT CAST(sum(l_linenumber + 10) AS BIGINT) AS plus_ten, CAST(sum(l_linenumber) AS BIGINT) AS plain FROM lineitem",
    "agg_group_multi": "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber",
    "agg_group_expr": "SELECT l_linenumber % 3 AS bin, count(*) AS n FROM lineitem GROUP BY l_linenumber % 3",
    "agg_nested": "SELECT max(n) AS most, min(n) AS least FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) x",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "agg_count_distinct": "SELECT count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem",
    "agg_group_only": "SELECT o_orderstatus FROM orders GROUP BY o_orderstatus",
    "agg_empty": "SELECT count(*) AS n, sum(o_totalprice) AS s, min(o_orderkey) AS lo, avg(o_totalprice) AS a FROM orders WHERE o_orderkey < 0",
    "order_multi_mixed": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_quantity DESC, l_orderkey ASC, l_linenumber DESC, l_partkey LIMIT 50",
    "order_by_expr": "SELECT p_partkey, p_size FROM part ORDER BY p_size * 2 + 1 DESC, p_partkey LIMIT 20",
    "limit_expr": "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 1 + 2",
    "limit_offset": "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 4 OFFSET 5",
    "topk": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15",
    "subquery_nested": "SELECT n FROM (SELECT x.n FROM (SELECT n_name AS n FROM nation) x) y ORDER BY n",
    "fn_arith": "SELECT l_linenumber + 2 AS a, l_linenumber - 2 AS b, l_linenumber * 2 AS c, round(l_quantity / 4.0, 6) AS d FROM lineitem",
    "fn_paren_alias": "SELECT (p_size + 1) * 2 AS doubled FROM part",
}

#: Queries with SQL of their own for the oracle: spark text, oracle text.
DIALECTS: dict[str, tuple[str, str]] = {
    "filter_func": ("SELECT p_partkey FROM part WHERE sq_int(CAST(p_size AS BIGINT)) > 100", "SELECT p_partkey FROM part WHERE p_size * p_size > 100"),
    "fn_sq": ("SELECT p_partkey, sq_int(sq_int(CAST(p_size AS BIGINT))) AS fourth, sq(p_retailprice) AS square FROM part", "SELECT p_partkey, CAST(p_size AS BIGINT) * p_size * (CAST(p_size AS BIGINT) * p_size) AS fourth, p_retailprice * p_retailprice AS square FROM part"),
    "fn_int_div": ("SELECT int_div(p_partkey - 50, 7) AS q, int_div(p_partkey, 0) AS z FROM part", "SELECT (p_partkey - 50) // 7 AS q, CAST(NULL AS BIGINT) AS z FROM part"),
    "fn_mod": ("SELECT mod(p_partkey - 50, 7) AS m FROM part", "SELECT (p_partkey - 50) % 7 AS m FROM part"),
    "fn_minmax": (
        "SELECT nmin(l_quantity, 10) AS a, nmax(l_quantity, 10) AS b, imin(l_partkey, l_suppkey) AS c, imax(l_partkey, l_suppkey) AS d, fmin(l_tax, l_discount) AS e, fmax(l_tax, l_discount) AS f FROM lineitem",
        "SELECT least(l_quantity, 10) AS a, greatest(l_quantity, 10) AS b, least(l_partkey, l_suppkey) AS c, greatest(l_partkey, l_suppkey) AS d, least(l_tax, l_discount) AS e, greatest(l_tax, l_discount) AS f FROM lineitem",
    ),
    "fn_substr": (
        "SELECT getsubstr(c_name, 0, 3) AS head, getsubstr(c_name, 5, 100) AS tail, getsubstr(c_name, -1, 2) AS neg, getsubstr(c_name, 500, 2) AS past FROM customer",
        "SELECT substring(c_name, 1, 3) AS head, substring(c_name, 6, 100) AS tail, '' AS neg, '' AS past FROM customer",
    ),
    "fn_date_epoch": (
        "SELECT o_orderkey, datestringtoepoch(date_format(o_orderdate, 'yyyy-MM-dd')) AS secs, datestringtoepoch('junk') AS bad FROM orders",
        "SELECT o_orderkey, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS secs, CAST(0 AS BIGINT) AS bad FROM orders",
    ),
    "fn_datetime_epoch": (
        "SELECT o_orderkey, datetimestringtoepoch(epochtodatetimestring(datestringtoepoch(date_format(o_orderdate, 'yyyy-MM-dd')) + 3661)) AS secs FROM orders",
        "SELECT o_orderkey, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) + 3661 AS secs FROM orders",
    ),
    "fn_epoch_string": (
        "SELECT o_orderkey, epochtodatetimestring(datestringtoepoch(date_format(o_orderdate, 'yyyy-MM-dd'))) AS day FROM orders",
        "SELECT o_orderkey, strftime(o_orderdate, '%a %b ') || lpad(CAST(day(o_orderdate) AS VARCHAR), 2, ' ') || ' 00:00:00 UTC ' || strftime(o_orderdate, '%Y') AS day FROM orders",
    ),
    "agg_avg_int": ("SELECT l_returnflag, sum(l_linenumber) div count(l_linenumber) AS avg_line FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(l_linenumber) // count(l_linenumber) AS BIGINT) AS avg_line FROM lineitem GROUP BY l_returnflag"),
}


def agg_sum_str(spark, sf_dir):
    return _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(scalar.sum_str(F.col("n_name")).alias("names"))


def values_rows(spark, sf_dir):
    return rows(spark, [("sam", 25), ("george jones", 999)], "name string, age long")


def _store(spark: SparkSession) -> SnapshotStore:
    """A store in the session's shared folder."""
    return SnapshotStore(spark, fresh(spark, "changes"))


def insert_values(spark, sf_dir):
    store = _store(spark)
    store.create("t", "name string, age long")
    return store.insert("t", values_rows(spark, sf_dir))


def insert_select(spark, sf_dir):
    store = _store(spark)
    store.create("t", "k long, price double")
    return store.insert("t", _t(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice"))


def delete_where(spark, sf_dir):
    store = _store(spark)
    store.create("o", "k long, status string", _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"))
    return store.delete("o", "status = 'F'").withColumn("left", F.lit(store.table("o").count()))


def stats_of_lineitem(spark, sf_dir):
    out = stats_table(_t(spark, sf_dir, "lineitem"), ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return out.select("column_name", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


def _outliers(sigma: float, columns: list[str]) -> Query:
    def run(spark, sf_dir):
        df = _t(spark, sf_dir, "lineitem")
        kept = within_sigma(df, collect_stats(df, columns), sigma)
        return kept.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))

    return run


def _outlier_sql(sigma: float, columns: list[str]) -> str:
    stats = ", ".join(f"avg({c}) m_{c}, stddev_pop({c}) s_{c}" for c in columns)
    keep = " AND ".join(f"abs({c} - m_{c}) <= {sigma} * s_{c}" for c in columns)
    return f"WITH s AS (SELECT {stats} FROM lineitem) SELECT count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem, s WHERE {keep}"


KEY_SQL = "(l_orderkey * 7919 + l_partkey * 31 + l_linenumber) % 100"
ALL_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _sampled(spark, sf_dir, rounds: int) -> DataFrame:
    key = F.col("l_orderkey") * 7919 + F.col("l_partkey") * 31 + F.col("l_linenumber")
    return sample_by_key(_t(spark, sf_dir, "lineitem"), key, SamplePlan("random", 0.01, rounds))


def _sample_query(rounds: int) -> Query:
    return lambda spark, sf_dir: _sampled(spark, sf_dir, rounds)


def sample_contiguous_key(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem")
    return contiguous_by_order(df, ALL_COLUMNS, 0, df.count() // 100).select("l_orderkey", "l_linenumber", "l_quantity")


def sample_random_start_key(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem")
    n = df.count()
    k, start = n // 100, n - n // 200
    return contiguous_by_order(df, ALL_COLUMNS, start, k, n).select("l_orderkey", "l_linenumber", "l_quantity")


def _relation(spark, sf_dir, rounds: int = 1) -> SampledRelation:
    df = _sampled(spark, sf_dir, rounds)
    stats: TableStats = collect_stats(df, ["l_quantity", "l_linenumber"])
    return SampledRelation.of(df, _t(spark, sf_dir, "lineitem").count(), stats)


def _approx(keys: tuple, **wanted) -> Query:
    def run(spark, sf_dir):
        out = _relation(spark, sf_dir).group_by(*keys).agg(**wanted)
        return out.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])

    return run


def approx_mape(spark, sf_dir):
    exact = _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("v"))
    out = mean_percent_error(_relation(spark, sf_dir, 5).group_by("l_returnflag").agg(v=("avg", "l_quantity")), exact, ["l_returnflag"], "v")
    return out.select(F.round("mape", 4).alias("mape"), "n_groups")


SAMPLED_SQL = f"WITH x AS (SELECT * FROM lineitem WHERE {KEY_SQL} < 1), f AS (SELECT (SELECT count(*) FROM lineitem) * 1.0::DOUBLE / (SELECT count(*) FROM x) AS k, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM x) "
APPROX: dict[str, tuple[dict, str]] = {
    "approx_count": ({"est": ("count", "*")}, "CAST(floor(count(*) * any_value(k)) AS BIGINT) AS est"),
    "approx_sum": ({"est": ("sum", "l_quantity"), "est_lines": ("sum", "l_linenumber")}, "round(sum(l_quantity) * any_value(k), 4) AS est, CAST(floor(sum(l_linenumber) * any_value(k)) AS BIGINT) AS est_lines"),
    "approx_avg": ({"est": ("avg", "l_quantity")}, "round(avg(l_quantity), 4) AS est"),
    "approx_max": ({"est": ("max", "l_quantity"), "est_str": ("max", "l_shipdate")}, "round(greatest(max(l_quantity), any_value(m) + 3 * any_value(s)), 4) AS est, max(l_shipdate) AS est_str"),
    "approx_min": ({"est": ("min", "l_quantity"), "est_str": ("min", "l_linestatus")}, "round(least(min(l_quantity), any_value(m) - 3 * any_value(s)), 4) AS est, min(l_linestatus) AS est_str"),
}

QUERIES: dict[str, Query] = {name: _sql(text) for name, text in SHARED.items()}
QUERIES |= {name: _sql(ours) for name, (ours, _) in DIALECTS.items()}
QUERIES |= {
    "agg_sum_str": agg_sum_str,
    "values_rows": values_rows,
    "insert_values": insert_values,
    "insert_select": insert_select,
    "delete_where": delete_where,
    "stats_table": stats_of_lineitem,
    "outlier_filter_2sigma": _outliers(2.0, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
    "outlier_filter_1sigma": _outliers(1.0, ["l_quantity", "l_extendedprice"]),
    "sample_random_r1": _sample_query(1),
    "sample_random_r5": _sample_query(5),
    "sample_contiguous_key": sample_contiguous_key,
    "sample_random_start_key": sample_random_start_key,
    "approx_mape": approx_mape,
}
ORACLE_SQL: dict[str, str] = dict(SHARED) | {name: theirs for name, (_, theirs) in DIALECTS.items()}
_ORDERED = "SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (ORDER BY " + ", ".join(ALL_COLUMNS) + ") AS r, count(*) OVER () AS n FROM lineitem"
ORACLE_SQL |= {
    "agg_sum_str": "SELECT n_regionkey, string_agg(n_name, '' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "values_rows": "SELECT * FROM (VALUES ('sam', 25::BIGINT), ('george jones', 999::BIGINT)) v(name, age)",
    "insert_values": "SELECT 2::BIGINT AS count",
    "insert_select": "SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'O'",
    "delete_where": "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS count, CAST(count(*) FILTER (WHERE o_orderstatus <> 'F') AS INTEGER) AS \"left\" FROM orders",
    "stats_table": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std FROM lineitem" for c in ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    ),
    "outlier_filter_2sigma": _outlier_sql(2.0, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
    "outlier_filter_1sigma": _outlier_sql(1.0, ["l_quantity", "l_extendedprice"]),
    "sample_random_r1": f"SELECT * FROM lineitem WHERE {KEY_SQL} < 1",
    "sample_random_r5": f"SELECT * FROM lineitem WHERE {KEY_SQL} < 5",
    "sample_contiguous_key": f"SELECT l_orderkey, l_linenumber, l_quantity FROM ({_ORDERED}) WHERE r <= n // 100",
    "sample_random_start_key": f"SELECT l_orderkey, l_linenumber, l_quantity FROM ({_ORDERED}) WHERE r > n - n // 200 OR r <= n // 100 - n // 200",
    "approx_mape": f"""WITH e AS (SELECT l_returnflag, avg(l_quantity) AS v FROM lineitem GROUP BY l_returnflag),
        a AS (SELECT l_returnflag, avg(l_quantity) AS v FROM lineitem WHERE {KEY_SQL} < 5 GROUP BY l_returnflag)
        SELECT round(avg(abs((a.v - e.v) / e.v) * 100), 4) AS mape, count(*) AS n_groups FROM e JOIN a USING (l_returnflag)""",
}
for _name, (_wanted, _text) in APPROX.items():
    QUERIES[_name] = _approx((), **_wanted)
    QUERIES[f"{_name}_grouped"] = _approx(("l_returnflag",), **_wanted)
    ORACLE_SQL[_name] = f"{SAMPLED_SQL} SELECT {_text} FROM x, f"
    ORACLE_SQL[f"{_name}_grouped"] = f"{SAMPLED_SQL} SELECT l_returnflag, {_text} FROM x, f GROUP BY l_returnflag"


# What has no SQL of its own in the session: sources, the real sampling modes, session estimates, changes, errors.

LINEITEM_COLUMNS = ["l_orderkey", "l_linenumber", "l_quantity"]
#: Rows of lineitem with their place in the file, for the oracle.
PLACED = "(SELECT *, row_number() OVER () - 1 AS place, count(*) OVER () AS total FROM lineitem)"
NATION = "nation (n_nationkey int, n_name string, n_regionkey int)"


def _nation_text(spark, sf_dir, tail: str = "") -> str:
    """The nations as delimited text in a folder of the shared one."""
    folder = fresh(spark, "text")
    lines = _t(spark, sf_dir, "nation").select(F.concat(F.concat_ws("|", "n_nationkey", "n_name", "n_regionkey"), F.lit(tail)))
    lines.write.text(f"{folder}/nation.tbl")
    return folder


def delimited_read(spark, sf_dir):
    return read_delimited(spark, f"{_nation_text(spark, sf_dir)}/nation.tbl", parse(NATION)["nation"])


def delimited_field_sum(spark, sf_dir):
    return delimited_read(spark, sf_dir).agg(F.sum("n_regionkey").alias("total"))


def catalog_import(spark, sf_dir):
    folder = _nation_text(spark, sf_dir, "|")
    return import_delimited(spark, NATION, folder, target=f"{folder}/db")["nation"]


def catalog_load_with_mode(spark, sf_dir):
    """Tables under a sample's least size stay whole in a sampling mode."""
    engine = Engine.open(spark, sf_dir, ["region"])
    engine.load_catalog(NATION, _nation_text(spark, sf_dir, "|"), mode="random")
    return engine.sql("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")


def append_load(spark, sf_dir):
    engine = Engine.open(spark, sf_dir, [])
    engine.sql("CREATE TABLE places (n_nationkey int, n_name varchar(25), n_regionkey int)")
    engine.sql("INSERT INTO places VALUES (100, 'first', 7)")
    engine.load("places", f"{_nation_text(spark, sf_dir)}/nation.tbl")
    return engine.sql("SELECT * FROM places")


def write_and_read(spark, sf_dir):
    out = fresh(spark, "written")
    output.write(_t(spark, sf_dir, "nation"), f"{out}/p")
    output.write(_t(spark, sf_dir, "nation"), f"{out}/c", "csv")
    text = spark.read.option("sep", "|").option("header", True).csv(f"{out}/c").agg(F.count("*").alias("n"), F.max("n_name").alias("last"))
    return text.withColumn("n_parquet", F.lit(spark.read.parquet(f"{out}/p").count()).cast("long"))


def rendered_lines(spark, sf_dir):
    lines = output.render(_t(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"), aligned=False).splitlines()
    return rows(spark, [(i, x) for i, x in enumerate(lines)], "place long, line string")


def _mode(mode: str, done: int, upto: int, rate: float = 0.01) -> Query:
    def run(spark, sf_dir):
        df = _t(spark, sf_dir, "lineitem")
        return between(df, SamplePlan(mode, rate), done, upto).select(*LINEITEM_COLUMNS)

    return run


def _bucket_sql(low: int, high: int) -> str:
    return f"{spread_sql('place', 42)} % {BUCKETS} >= {low} AND {spread_sql('place', 42)} % {BUCKETS} < {high}"


def outlier_sample(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem").select(*LINEITEM_COLUMNS, "l_extendedprice")
    stats = collect_stats(df, ["l_quantity", "l_extendedprice"])
    return sample(df, SamplePlan("outlier", 0.02, 1, sigma=1.0), stats).select(*LINEITEM_COLUMNS)


def sample_fixed_size(spark, sf_dir):
    return fixed_size(_t(spark, sf_dir, "lineitem"), 500).select(*LINEITEM_COLUMNS)


def _later(columns: list[str], stats: TableStats, spark) -> DataFrame:
    return rows(spark, [(c, stats.columns[c].n, round(stats.columns[c].mean, 4), round(stats.columns[c].std, 4)) for c in columns], "column_name string, n long, mean double, std double")


def statistics_over_rounds(spark, sf_dir):
    """Merged over three rounds of a session, kept beside the table and read again."""
    engine = Engine.open(spark, sf_dir, ["lineitem"], mode="random")
    for _ in range(3):
        engine.advance("lineitem")
        engine.statistics("lineitem")
    path = fresh(spark, "statistics")
    engine.save_statistics("lineitem", path)
    kept = engine.load_statistics(path)
    return _later(["l_quantity", "l_extendedprice", "l_linenumber"], kept, spark)


def statistics_sidecar(spark, sf_dir):
    path = fresh(spark, "statistics")
    save_stats(spark, collect_stats(_t(spark, sf_dir, "orders"), ["o_totalprice"]), path)
    return _later(["o_totalprice"], load_stats(spark, path), spark)


def row_count_estimate(spark, sf_dir):
    return rows(spark, [(sum(n for _, n in file_counts(_t(spark, sf_dir, "lineitem"))),)], "n long")


def _estimates(mode: str, rounds: int, text: str) -> Query:
    def run(spark, sf_dir):
        engine = Engine.open(spark, sf_dir, ["lineitem"], mode=mode)
        for _ in range(rounds - 1):
            engine.advance("lineitem")
        return engine.sql(text)

    return run


ESTIMATED = """SELECT l_returnflag, count(*) AS n, count(*) + 1 AS m, round(sum(l_quantity * 2), 4) AS qty, sum(l_linenumber) AS lines, round(avg(l_quantity), 6) AS mean,
    round(max(l_quantity), 4) AS hi, round(min(l_quantity), 4) AS lo, max(l_linestatus) AS status FROM lineitem GROUP BY l_returnflag"""


def _estimates_sql(keep: str) -> str:
    return f"""WITH x AS (SELECT * FROM {PLACED} WHERE {keep}), f AS (SELECT (SELECT count(*) FROM lineitem) * 1.0::DOUBLE / count(*) AS k, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM x)
        SELECT l_returnflag, CAST(floor(count(*) * any_value(k)) AS BIGINT) AS n, CAST(floor(count(*) * any_value(k)) AS BIGINT) + 1 AS m, round(sum(l_quantity * 2) * any_value(k), 4) AS qty,
        CAST(floor(sum(l_linenumber) * any_value(k)) AS BIGINT) AS lines, round(avg(l_quantity), 6) AS mean, round(greatest(max(l_quantity), any_value(f.m) + 3 * any_value(f.s)), 4) AS hi,
        round(least(min(l_quantity), any_value(f.m) - 3 * any_value(f.s)), 4) AS lo, max(l_linestatus) AS status FROM x, f GROUP BY l_returnflag"""


def estimates_mean_of_trials(spark, sf_dir):
    runs = []
    for seed in (1, 2, 3):
        engine = Engine.open(spark, sf_dir, ["lineitem"], mode="random", seed=seed)
        runs.append(engine.sql("SELECT l_returnflag, avg(l_quantity) AS v FROM lineitem GROUP BY l_returnflag"))
    return trial_means(runs, ["l_returnflag"], "v").select("l_returnflag", F.round("v", 6).alias("v"), "n_trials")


def estimates_star_join(spark, sf_dir):
    """A sampled table with tables that are small and therefore whole."""
    engine = Engine.open(spark, sf_dir, ["nation", "region"], mode="random")
    return engine.sql("SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")


def random_functions(spark, sf_dir):
    return Engine.open(spark, sf_dir, ["nation"]).sql("SELECT n_nationkey, randint() >= 0 AS whole, randfloat(2, 3) >= 2 AND randfloat(2, 3) < 3 AS part, abs(epoch() - unix_timestamp()) < 60 AS now FROM nation")


def function_list(spark, sf_dir):
    return rows(spark, [(x.split("(")[0],) for x in scalar.signatures()], "name string")


def numbers_beyond_doubles(spark, sf_dir):
    return Engine.open(spark, sf_dir, ["nation"]).sql("SELECT n_nationkey, nmin(n_nationkey + 9007199254740993, 9007199254740997) AS lo, nmax(n_nationkey + 9007199254740993, 9007199254740997) AS hi, sq(n_nationkey) AS square, mod(n_nationkey, 0) AS nothing FROM nation")


def changes_in_a_transaction(spark, sf_dir):
    """Created, filled and changed in SQL; what was rolled back is undone, the schema too."""
    engine = Engine.open(spark, sf_dir, ["nation"])
    for text in (
        "CREATE TABLE places (name varchar(25), region int)", "INSERT INTO places SELECT n_name, n_regionkey FROM nation", "BEGIN", "DELETE FROM places WHERE region = 1", "COMMIT",
        "BEGIN", "DROP TABLE places", "CREATE TABLE places (other float)", "ROLLBACK", "INSERT INTO places VALUES ('new', 9), ('more', NULL)", "DELETE FROM places WHERE region > 3 AND region < 9",
    ):
        engine.sql(text)
    return engine.sql("SELECT name, region FROM places")


def transaction_numbers(spark, sf_dir):
    engine = Engine.open(spark, sf_dir, [])
    said = [engine.sql(x).first() for x in ("BEGIN", "COMMIT", "BEGIN", "ROLLBACK", "START TRANSACTION", "COMMIT")]
    return rows(spark, [(i, r.done, r.transaction) for i, r in enumerate(said)], "place long, done string, transaction long")


def catalog_text(spark, sf_dir):
    """The folder's tables as catalog text, read back, with the tables that have a column named like a key."""
    engine = Engine.open(spark, sf_dir, ["region", "nation"])
    schemas = parse(engine.describe())
    return rows(spark, [(format_line(name, schema), ",".join(column_tables(schemas, schema.names[0]))) for name, schema in schemas.items()], "line string, first_column_in string")


def error_kinds(spark, sf_dir):
    engine = Engine.open(spark, sf_dir, ["nation"])
    out = []
    for text in ("SELECT * FROM nowhere", "SELECT * FRM nation", "SELECT n_name FROM nation a JOIN nation b ON a.n_name = b.n_name", "COMMIT", "DROP TABLE nowhere", "CREATE TABLE nation (a int)", "INSERT INTO nation VALUES (1)"):
        try:
            engine.sql(text).count()
        except Exception as e:  # the kinds are the result
            out.append((text, error_kind(e)))
    return rows(spark, out, "statement string, kind string")


def explained(spark, sf_dir):
    text = Engine.open(spark, sf_dir, ["orders"]).explain("SELECT o_orderkey FROM orders WHERE o_custkey > 10")
    return rows(spark, [("Scan parquet" in text, "GreaterThan(o_custkey,10)" in text, "o_comment" not in text.split("ReadSchema")[1].split("\n")[0])], "scan boolean, pushed boolean, pruned boolean")


_START = f"({zlib.crc32(b'42')} % total)"
_REACH = lambda share: f"CAST(-((-CAST(floor(total * {share!r}::DOUBLE * 1000000) AS BIGINT)) // 1000000) AS BIGINT)"
_PICK = f"SELECT {', '.join(LINEITEM_COLUMNS)} FROM {PLACED}"
_NATION_SQL = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"
MORE: dict[str, tuple[Query, str]] = {
    "delimited_read": (delimited_read, _NATION_SQL),
    "delimited_field_sum": (delimited_field_sum, "SELECT CAST(sum(n_regionkey) AS BIGINT) AS total FROM nation"),
    "catalog_import": (catalog_import, _NATION_SQL),
    "catalog_load_with_mode": (catalog_load_with_mode, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "append_load": (append_load, f"{_NATION_SQL} UNION ALL SELECT 100, 'first', 7"),
    "write_and_read": (write_and_read, "SELECT count(*) AS n, max(n_name) AS last, count(*) AS n_parquet FROM nation"),
    "rendered_lines": (rendered_lines, "SELECT 0 AS place, 'r_regionkey,r_name' AS line UNION ALL SELECT row_number() OVER (ORDER BY r_regionkey), r_regionkey || ',' || r_name FROM region"),
    "sample_mode_all": (_mode("all", 0, 1), f"SELECT {', '.join(LINEITEM_COLUMNS)} FROM lineitem"),
    "sample_mode_random": (_mode("random", 0, 1), f"{_PICK} WHERE {_bucket_sql(0, 100)}"),
    "sample_mode_random_later_round": (_mode("random", 4, 5), f"{_PICK} WHERE {_bucket_sql(400, 500)}"),
    "sample_mode_contiguous": (_mode("contiguous", 0, 3), f"{_PICK} WHERE place < {_REACH(0.03)}"),
    "sample_mode_contiguous_later_round": (_mode("contiguous", 3, 4), f"{_PICK} WHERE place >= {_REACH(0.03)} AND place < {_REACH(0.04)}"),
    "sample_mode_random_start": (_mode("random_start", 0, 90), f"{_PICK} WHERE (place - {_START} + total) % total < {_REACH(0.9)}"),
    "sample_mode_random_start_later_round": (_mode("random_start", 89, 90), f"{_PICK} WHERE (place - {_START} + total) % total >= {_REACH(0.89)} AND (place - {_START} + total) % total < {_REACH(0.9)}"),
    "sample_mode_outlier": (outlier_sample, f"WITH s AS (SELECT avg(l_quantity) mq, stddev_pop(l_quantity) sq, avg(l_extendedprice) mp, stddev_pop(l_extendedprice) sp FROM lineitem) {_PICK}, s WHERE abs(l_quantity - mq) <= sq AND abs(l_extendedprice - mp) <= sp AND {_bucket_sql(0, 200)}"),
    "sample_fixed_size": (sample_fixed_size, f"SELECT {', '.join(LINEITEM_COLUMNS)} FROM (SELECT *, row_number() OVER (ORDER BY {spread_sql('place', 42)}, place) AS nth FROM {PLACED}) WHERE nth <= 500"),
    "statistics_over_rounds": (
        statistics_over_rounds,
        " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std FROM {PLACED} WHERE {_bucket_sql(0, 300)}" for c in ["l_quantity", "l_extendedprice", "l_linenumber"]),
    ),
    "statistics_sidecar": (statistics_sidecar, "SELECT 'o_totalprice' AS column_name, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std FROM orders"),
    "row_count_estimate": (row_count_estimate, "SELECT count(*) AS n FROM lineitem"),
    "estimates_random": (_estimates("random", 1, ESTIMATED), _estimates_sql(_bucket_sql(0, 100))),
    "estimates_random_round_5": (_estimates("random", 5, ESTIMATED), _estimates_sql(_bucket_sql(0, 500))),
    "estimates_contiguous": (_estimates("contiguous", 2, ESTIMATED), _estimates_sql(f"place < {_REACH(0.02)}")),
    "estimates_mean_of_trials": (
        estimates_mean_of_trials,
        "WITH r AS (" + " UNION ALL ".join(f"SELECT l_returnflag, avg(l_quantity) AS v FROM {PLACED} WHERE {spread_sql('place', seed)} % {BUCKETS} < 100 GROUP BY l_returnflag" for seed in (1, 2, 3)) + ") SELECT l_returnflag, round(avg(v), 6) AS v, count(*) AS n_trials FROM r GROUP BY l_returnflag",
    ),
    "estimates_star_join": (estimates_star_join, "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "random_functions": (random_functions, "SELECT n_nationkey, true AS whole, true AS part, true AS now FROM nation"),
    "function_list": (function_list, "SELECT unnest(['" + "', '".join(sorted(scalar.SQL_FUNCTIONS)) + "']) AS name"),
    "numbers_beyond_doubles": (
        numbers_beyond_doubles,
        "SELECT n_nationkey, least(n_nationkey + 9007199254740993, 9007199254740997) AS lo, greatest(n_nationkey + 9007199254740993, 9007199254740997) AS hi, n_nationkey * n_nationkey AS square, NULL::INTEGER AS nothing FROM nation",
    ),
    "paren_table_list": (_sql("SELECT n_name, r_name FROM (nation, region) WHERE n_regionkey = r_regionkey"), "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey"),
    "changes_in_a_transaction": (changes_in_a_transaction, "SELECT n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation WHERE n_regionkey <> 1 AND NOT (n_regionkey > 3 AND n_regionkey < 9) UNION ALL VALUES ('new', 9), ('more', NULL)"),
    "transaction_numbers": (transaction_numbers, "SELECT * FROM (VALUES (0, 'begin', 1), (1, 'commit', 1), (2, 'begin', 2), (3, 'rollback', 2), (4, 'begin', 3), (5, 'commit', 3)) v(place, done, transaction)"),
    "catalog_text": (catalog_text, "SELECT * FROM (VALUES ('nation (n_nationkey int, n_name string, n_regionkey int)', 'nation'), ('region (r_regionkey int, r_name string)', 'region')) v(line, first_column_in)"),
    "error_kinds": (
        error_kinds,
        "SELECT * FROM (VALUES ('SELECT * FROM nowhere', 'NoSuchTableError'), ('SELECT * FRM nation', 'ParseError'), ('SELECT n_name FROM nation a JOIN nation b ON a.n_name = b.n_name', 'AmbiguousNameError'), ('COMMIT', 'IllegalTransactionError'), ('DROP TABLE nowhere', 'NoSuchTableError'), ('CREATE TABLE nation (a int)', 'DuplicateTableError'), ('INSERT INTO nation VALUES (1)', 'TypeMismatchError')) v(statement, kind)",
    ),
    "explained": (explained, "SELECT true AS scan, true AS pushed, true AS pruned"),
}
QUERIES |= {name: query for name, (query, _) in MORE.items()}
ORACLE_SQL |= {name: text for name, (_, text) in MORE.items()}
