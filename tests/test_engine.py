"""Golden results on the twelve-row fixture, sampling properties, estimates, catalog text, changes and streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from skeinlake.functions import scalar
from skeinlake.operators import approx, sampling, stats
from skeinlake.plans import rewrite
from skeinlake.plans.session import Engine, trials
from skeinlake.sources import catalog, output
from skeinlake.streaming import progressive

# Twelve rows, and queries on them with the rows that they must give.
PEOPLE = [("sam", 25), ("kathy", 45), ("bill", 30), ("ang", 22), ("joe", 40), ("mark", 50), ("sarah", 60), ("riza", 43), ("bo", 99), ("pat", 38), ("sam", 99), ("riza", 22)]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("people"))
    for t in ("t", "t2"):
        catalog.rows(spark, PEOPLE, "name string, age long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
    return Engine.open(spark, folder)


GOLDEN = [
    ("select sum(age) as s from t group by t.name having s > 30", [(x,) for x in (124, 45, 40, 50, 60, 65, 99, 38)]),
    ("select sum(age + 10), sum(age) from t", [(693, 573)]),
    ("select min(age) + max(age) from t", [(121,)]),
    ("select sq(sq(5)) from t", [(625.0,)] * 12),
    ("select 1, name from t", [(1, n) for n, _ in PEOPLE]),
    ("select age, name from t", [(a, n) for n, a in PEOPLE]),
    ("select t.name, sum(age) totage from t group by t.name", [("sam", 124), ("kathy", 45), ("bill", 30), ("ang", 22), ("joe", 40), ("mark", 50), ("sarah", 60), ("riza", 65), ("bo", 99), ("pat", 38)]),
    ("select t.name, t.age from t join t2 on t.name = t2.name where t.age < 50", [("sam", 25)] * 2 + [("kathy", 45), ("bill", 30), ("ang", 22), ("joe", 40)] + [("riza", 43)] * 2 + [("riza", 22)] * 2 + [("pat", 38)]),
    ("select age, count(*) from t group by age", [(25, 1), (45, 1), (30, 1), (22, 2), (40, 1), (50, 1), (60, 1), (43, 1), (99, 2), (38, 1)]),
    ("select count(*) from t join t2 on t.name = t2.name where t.age > 30", [(10,)]),
]
ORDERED = [
    ("select * from t order by t.age, t.name limit 1+2", [("ang", 22), ("riza", 22), ("sam", 25)]),
    (
        "select t.name, t.age from t join t2 on t.name = t2.name, t2 as t3 where t.age < 50 and t3.age = t.age order by t.age asc, t.name asc",
        [("ang", 22)] * 2 + [("riza", 22)] * 4 + [("sam", 25)] * 2 + [("bill", 30), ("pat", 38), ("joe", 40)] + [("riza", 43)] * 2 + [("kathy", 45)],
    ),
    ("select name from (select x.name from (select t.name from t) x) y order by name asc", [(n,) for n in sorted(n for n, _ in PEOPLE)]),
]


@pytest.mark.parametrize("sql,want", GOLDEN)
def test_golden(engine, sql, want):
    assert sorted(map(tuple, engine.sql(sql).collect())) == sorted(want)


@pytest.mark.parametrize("sql,want", ORDERED)
def test_golden_ordered(engine, sql, want):
    assert list(map(tuple, engine.sql(sql).collect())) == want


def test_mixed_order(spark):
    df = catalog.rows(spark, [("sam", 25), ("tim", 44), ("mike", 88), ("sam", 26)], "name string, age long")
    assert [r.age for r in df.orderBy(F.desc("name"), F.desc("age")).collect()] == [44, 26, 25, 88]
    assert [r.age for r in df.orderBy(F.asc("name"), F.desc("age")).collect()] == [88, 26, 25, 44]


def test_big_join(spark):
    a, b = spark.range(314_159).toDF("name"), spark.range(314_159).toDF("name")
    assert a.join(b, "name").count() == 314_159


def test_functions(spark):
    scalar.register(spark)
    one = lambda sql: spark.sql(f"select {sql}").first()[0]
    assert one("getsubstr('hello', 1, 3)") == "ell" and one("getsubstr('hello', 5, 3)") == "" and one("getsubstr('hello', 3, 99)") == "lo" and one("getsubstr('hello', -1, 3)") == ""
    assert one("int_div(-7, 2)") == -3 and one("int_div(1, 0)") is None and one("mod(-7, 2)") == -1
    assert one("fmax(1, 2)") == 2 and one("fmin(1, 2)") == 1 and one("imin(3, 2)") == 2 and one("nmax(1.5, 2)") == 2
    assert one("datestringtoepoch('1995-03-15')") == 795225600 and one("datestringtoepoch('junk')") == 0
    assert one("epochtodatetimestring(0)") == "Thu Jan  1 00:00:00 UTC 1970"
    assert one("datetimestringtoepoch('Thu Jan  1 00:00:07 UTC 1970')") == 7 and one("datetimestringtoepoch('?')") == 0
    assert 0 <= one("randint()") and 2 <= one("randfloat(2, 3)") < 3 and abs(one("epoch()") - datetime.datetime.now().timestamp()) < 60
    df = spark.createDataFrame([("hello", 7, 2)], "s string, a long, b long")
    row = df.select(scalar.getsubstr(F.col("s"), 1, 3), scalar.int_div(F.col("a"), F.col("b")), scalar.mod(F.col("a"), F.col("b")), scalar.sq(F.col("a")), scalar.nmin(F.col("a"), F.col("b")), scalar.nmax(F.col("a"), F.col("b"))).first()
    assert tuple(row) == ("ell", 3, 1, 49, 2, 7)
    days = spark.createDataFrame([("1970-01-02",), ("x",)], "s string").select(scalar.day_to_epoch(F.col("s"))).collect()
    assert [r[0] for r in days] == [86400, 0]
    text = spark.range(1).select(scalar.epoch_to_unix_date(F.lit(86400)).alias("t"))
    assert text.select(scalar.unix_date_to_epoch(F.col("t"))).first()[0] == 86400
    plan = spark.sql("select sum(sq(id)) from range(3)")._jdf.queryExecution().toString()
    assert "Python" not in plan


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("numbers"))
    spark.range(20_000).select("id", (F.col("id") % 7).alias("g"), F.rand(1).alias("v")).repartition(3).write.mode("overwrite").parquet(f"{folder}/numbers.parquet")
    return folder


@pytest.mark.parametrize("mode", ["random", "contiguous", "random_start"])
def test_rounds_never_overlap_and_cover(spark, files, mode):
    df = spark.read.parquet(f"{files}/numbers.parquet")
    before = set()
    for r in (1, 5, 60, 100):
        now = {x.id for x in sampling.sample(df, sampling.SamplePlan(mode, 0.01, r)).select("id").collect()}
        assert before <= now and abs(len(now) - 200 * r) <= (0 if mode != "random" else 30 + 20 * r**0.5)
        before = now
    assert len(before) == 20_000


def test_contiguous_reaches_the_scan(spark, files):
    df = sampling.sample(spark.read.parquet(f"{files}/numbers.parquet"), sampling.SamplePlan("contiguous", 0.01, 1))
    assert "row_index" in df._jdf.queryExecution().toString().split("PushedFilters")[1].split("]")[0]


def test_rows_by_order_meet_in_no_single_task(spark, files):
    df = spark.read.parquet(f"{files}/numbers.parquet").withColumn("v", F.concat(F.lit("v"), "id"))
    order = sorted(range(20_000), key=lambda i: (i % 7, f"v{i}"))
    for start, k, n, expected in ((19_900, 300, 20_000, order[19_900:] + order[:200]), (19_900, 300, None, order[19_900:]), (7_000, 9_000, None, order[7_000:16_000]), (0, 0, 20_000, []), (30_000, 5, None, [])):
        out = sampling.contiguous_by_order(df, ["g", "v"], start, k, n)
        assert sorted(r.id for r in out.collect()) == sorted(expected)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Limit", "TakeOrdered", "SinglePartition", "Sort"))
    assert set(out.columns) == {"id", "g", "v"}


def test_small_tables_are_read_whole(engine, spark):
    df = spark.read.parquet(f"{engine.path}/t.parquet")
    assert sampling.sample(df, sampling.SamplePlan("contiguous")).count() == 12
    with pytest.raises(ValueError):
        sampling.SamplePlan("other")
    assert sampling.fixed_size(df, 5).count() == 5
    assert sampling.stratified(df, "name", {"sam": 1.0}).count() == 2


def test_statistics_merge(spark, files):
    df = spark.read.parquet(f"{files}/numbers.parquet")
    a, b = stats.collect_stats(df.filter("id < 7000")), stats.collect_stats(df.filter("id >= 7000"))
    whole, merged = stats.collect_stats(df), a.merge(b)
    for c in ("id", "g", "v"):
        assert merged.columns[c].mean == pytest.approx(whole.columns[c].mean) and merged.columns[c].std == pytest.approx(whole.columns[c].std)
    assert stats.TableStats.from_json(whole.to_json()) == whole
    assert stats.collect_stats(df.limit(0)).columns["v"].std == 0.0
    kept = stats.within_sigma(df, stats.collect_stats(df, ["id"]), 1.0)
    assert 0.55 < kept.count() / 20_000 < 0.6


def test_estimates_are_exact_on_everything(spark, files):
    df = spark.read.parquet(f"{files}/numbers.parquet")
    rel = approx.SampledRelation.of(df, 20_000)
    got = rel.group_by("g").agg(spread=False, n=("count", None), s=("sum", "id"), m=("avg", "v"), lo=("min", "v"), hi=("max", "id")).orderBy("g").collect()
    want = df.groupBy("g").agg(F.count("*"), F.sum("id"), F.avg("v"), F.min("v"), F.max("id")).orderBy("g").collect()
    assert [tuple(x) for x in got] == [pytest.approx(tuple(x)) for x in want]
    assert rel.filter("id < 10").agg(n=("count", "*")).first().n == 10
    half = approx.SampledRelation.of(df.filter("id % 2 = 0"), 20_000)
    assert half.agg(n=("count", "*")).first().n == 20_000 and half.filter("id < 10").agg(n=("count", "*")).first().n == 5
    scaled = approx.SampledRelation.of(df.filter("id % 2 = 0"), 20_000, scale_filters=True)
    assert scaled.filter("id < 10").agg(n=("count", "*")).first().n == 10
    error = approx.mean_percent_error(spark.createDataFrame([("a", 110.0), ("b", 50.0)], "k string, v double"), spark.createDataFrame([("a", 100.0), ("b", 100.0)], "k string, v double"), ["k"], "v").first()
    assert error.mape == pytest.approx(30.0) and error.n_groups == 2
    means = approx.trial_means([spark.createDataFrame([("a", 1.0)], "k string, v double"), spark.createDataFrame([("a", 3.0)], "k string, v double")], ["k"], "v").first()
    assert means.v == 2.0 and means.n_trials == 2
    assert rel.standard_error("v").first()[0] == 0.0


@pytest.mark.parametrize("mode,most", [("random", 6), ("contiguous", 6), ("random_start", 6), ("outlier", 6)])
def test_progressive_session(spark, files, mode, most):
    engine = Engine.open(spark, files, ["numbers"], mode=mode, rate=0.05)
    errors = []
    for _ in range(4):
        rows = engine.sql("select g, count(*) as n, sum(id) as s, avg(v) as m from numbers group by g order by g").collect()
        assert sum(r.n for r in rows) == pytest.approx(20_000, abs=20)
        errors.append(sum(abs(r.m - 0.5) for r in rows) / 7)
    assert engine.rounds["numbers"] == 4 and errors[-1] < 0.05
    top = engine.sql("select max(v) as hi, min(v) as lo from numbers").first()
    assert top.hi > 1.0 and top.lo < 0.0  # mean and three deviations reach beyond a uniform column
    filtered = engine.sql("select count(*) as n from numbers where g = 1").first()
    assert filtered.n < 2_000  # behind a filter nothing is scaled
    engine.reset()
    assert spark.table("numbers").count() == 20_000 and "numbers (id int" in engine.describe()


def test_rewriting():
    asked = []

    def estimate(block):
        asked.append((block.table, block.calls))
        return {c: f"E({c})" for c in block.calls}

    run = lambda text, **kw: rewrite.Rewriter({"t", "t2"}, estimate, **kw).run(text)
    assert run("select max(age) as a, count( * )+0 from t x group by b having sum(age) > 3") == "select E(max(age)) as a, E(count( * ))+0 from t x group by b having E(sum(age)) > 3"
    for same in ("select count(*) from t where age > 3", "select count(*) from t join t2 on t.age = t2.age", "select count(*) from t, t2", "select count(distinct age), sum(age) over () from t", "select 'count(*) from t' from other", "select age from t -- count(*)\n"):
        assert run(same) == same.split("--")[0].rstrip(" ") + (" \n" if "--" in same else "")
    assert run("select count(*) from t where age > 3", scale_filters=True) == "select E(count(*)) from t where age > 3"
    assert run("select max(n) from (select a, count(*) n from t group by a) x union all select sum(b) from t2") == "select max(n) from (select a, E(count(*)) n from t group by a) x union all select E(sum(b)) from t2"
    assert rewrite.dialect("select nmin(a, nmax(b, 2)), sq(a + 1), mod(a, 0), ')' from (t, t2) where x in (select y from (select 1 y))") == "select least(a, greatest(b, 2)), ((a + 1) * (a + 1)), try_mod(a, 0), ')' from  t, t2  where x in (select y from (select 1 y))"


def test_small_tables_join_in_every_mode(spark, sf_dir):
    for mode in ("random", "contiguous", "random_start", "outlier"):
        engine = Engine.open(spark, sf_dir, ["nation", "region"], mode=mode)
        assert engine.answer("select count(*) as n from nation")[0].n == 25
        assert engine.answer("select count(*) as n from nation join region on n_regionkey = r_regionkey")[0].n == 25


def test_estimates_inside_expressions_agree(spark, files):
    for mode in ("random", "contiguous", "random_start", "outlier"):
        engine = Engine.open(spark, files, ["numbers"], mode=mode, rate=0.05)
        row = engine.answer("select sum(id) as s, sum(id * 2) as d, round(sum(v), 9) as r, sum(v) as v, count(*) as n, count(*) + 0 as m, avg(v) as a, max(id) - min(id) as w from numbers")[0]
        assert abs(row.d - 2 * row.s) <= 2 and row.r == pytest.approx(row.v) and row.n == row.m == 20_000 and (row.w > 20_000 or mode in ("contiguous", "random_start"))
        assert engine.estimated == {"s": True, "d": True, "r": True, "v": True, "n": True, "m": True, "a": False, "w": True}
        inner = engine.answer("select max(n) as most, count(*) as g from (select g, count(*) as n from numbers group by g) x")[0]
        assert 2_000 < inner.most < 4_500 and inner.g == 7
        engine.answer("select max(v) from numbers")
        assert engine.statistics("numbers").n == engine.samples["numbers"].rows and engine.statistics("numbers").n_hat == 20_000
        whole = stats.collect_stats(spark.table("numbers"))
        assert engine.statistics("numbers").columns["id"].std == pytest.approx(whole.columns["id"].std)


def test_trials(spark, files):
    out = trials(spark, files, "numbers", "select g, avg(id) as v from numbers group by g", ["g"], "v", ["random", "contiguous"], [1, 2], rounds=2).collect()
    assert len(out) == 8 and all(r.n_groups == 7 and r.seconds > 0 for r in out) and {r["round"] for r in out} == {1, 2}
    assert max(r.mape for r in out if r.mode == "random") < 25 < min(r.mape for r in out if r.mode == "contiguous")


def test_changes_in_sql(spark, files, tmp_path):
    e = Engine.open(spark, files, ["numbers"])
    e.sql("CREATE TABLE people (name varchar(20), age int)")
    assert e.sql("INSERT INTO people VALUES ('sam', 25), ('george jones', 999);").first()["count"] == 2
    assert e.sql("begin").first().transaction == 1
    e.sql("insert into people select 'number', id from numbers where id < 3")
    assert e.sql("delete from people where age > 500").first()["count"] == 1 and e.answer("select count(*) as n from people")[0].n == 4
    e.sql("drop table people")
    e.sql("create table people (other float)")
    e.sql("rollback")
    assert sorted(map(tuple, e.answer("select * from people"))) == [("george jones", 999), ("sam", 25)]
    assert e.sql("start transaction").first().transaction == 2
    e.sql("delete from numbers where id >= 5")
    e.sql("commit")
    assert e.answer("select count(*) as n from numbers")[0].n == 5 and spark.read.parquet(f"{files}/numbers.parquet").count() == 20_000
    (tmp_path / "more.csv").write_text("name, age\ntim, 10\n")
    assert e.command(f"\\l people {tmp_path / 'more.csv'} , true") == "1 rows\n" and "tim" in e.command("\\a select * from people") and "people (name string, age int)" in e.command("\\d")
    assert "sq(" in e.command("\\f") and e.command("\\t select 1 as one").splitlines()[1] == "1"
    kinds = []
    for bad in ("commit", "create table people (a int)", "drop table nothing", "delete from people when", "insert into people values (1)", "create table x (a blob)", "select * from nothing", "select * frm people", "select age from people a join people b on a.age = b.age"):
        with pytest.raises(Exception) as caught:
            e.sql(bad).collect()
        kinds.append(catalog.error_kind(caught.value))
    assert kinds == ["IllegalTransactionError", "DuplicateTableError", "NoSuchTableError", "ParseError", "TypeMismatchError", "ParseError", "NoSuchTableError", "ParseError", "AmbiguousNameError"] and set(kinds) <= set(catalog.ERRORS)
    e.sql("delete from people")
    assert e.answer("select count(*) as n from people")[0].n == 0
    e.load_catalog("pets (name string, legs int)", _pets(tmp_path), mode="random")
    assert e.answer("select sum(legs) as n from pets")[0].n == 6 and e.plan.mode == "random"
    assert e.answer("select nmin(9007199254740993, 9007199254740995) as a, mod(1, 0) as b, sq(3) as c from (pets, people)") == []


def _pets(tmp_path):
    (tmp_path / "pets.tbl").write_text("cat|4|\nbird|2|\n")
    return str(tmp_path)


def test_catalog_text(spark, tmp_path):
    text = "people (name string, age int)\nprices (p float, q integer, r varchar, s text)"
    schemas = catalog.parse(text)
    assert catalog.format_line("people", schemas["people"]) == "people (name string, age int)"
    assert catalog.column_tables(schemas, "AGE") == ["people"]
    for bad in ("people", "t (a)", "t (a blob)"):
        with pytest.raises(catalog.CatalogError):
            catalog.parse_line(bad)
    (tmp_path / "people.tbl").write_text("sam|25.9|\ngeorge jones, a name of more than thirty-two letters|999|\n")
    read = catalog.import_delimited(spark, "people (name string, age int)", str(tmp_path), target=str(tmp_path / "db"))["people"]
    assert sorted(r.age for r in read.collect()) == [25, 999]
    (tmp_path / "head.csv").write_text("name, age\nsam, 1\ntim, 10\nferdi, 100\nziniu, 1000\n")
    df = catalog.read_delimited(spark, str(tmp_path / "head.csv"), schemas["people"], sep=",", header=True)
    assert df.agg(F.sum("age")).first()[0] == 1111
    cut = catalog.read_delimited(spark, str(tmp_path / "people.tbl"), schemas["people"], skip_last=True, fixed_width=True)
    assert max(len(r.name) for r in cut.collect()) == 32
    (tmp_path / "bad.tbl").write_text("sam|x|\n")
    with pytest.raises(Exception):
        catalog.read_delimited(spark, str(tmp_path / "bad.tbl"), schemas["people"], skip_last=True).collect()


def test_output_and_sidecar(spark, tmp_path, engine):
    df = spark.createDataFrame([("sam", 25), ("a,b", None)], "name string, age long")
    assert output.render(df) == "name | age\nsam  | 25\na,b  | NULL\n"
    assert output.render(df, aligned=False) == 'name,age\nsam,25\n"a,b",NULL\n'
    output.write(df, str(tmp_path / "c"), "csv")
    assert spark.read.option("sep", "|").option("header", True).csv(str(tmp_path / "c")).count() == 2
    output.write(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    with pytest.raises(ValueError):
        output.write(df, str(tmp_path / "x"), "other")
    kept = stats.collect_stats(df)
    stats.save_stats(spark, kept, str(tmp_path / "s"))
    assert stats.load_stats(spark, str(tmp_path / "s")) == kept
    engine.cancel()
    engine.optimizer(False)
    assert any(x.startswith("sq(") for x in engine.functions())


def test_changes_and_transactions(spark, tmp_path):
    store = catalog.SnapshotStore(spark, str(tmp_path))
    store.create("t", "name string, age long")
    assert store.table("t").count() == 0
    values = catalog.rows(spark, [("sam", 25), ("george jones", 999)], "n string, a long")
    assert store.insert("t", values).first()["count"] == 2
    store.begin()
    assert store.delete("t", "age > 25").first()["count"] == 1 and store.table("t").count() == 1
    store.rollback()
    assert store.table("t").count() == 2
    store.begin()
    store.delete("t", F.col("age") > 25)
    store.commit()
    assert [r.name for r in store.table("t").collect()] == ["sam"]
    assert store.delete("t", "age > NULL").first()["count"] == 0
    assert store.save() == "t (name string, age int)"
    with pytest.raises(catalog.CatalogError):
        store.create("t", "a long")
    with pytest.raises(catalog.CatalogError):
        store.insert("t", values.select("n"))
    with pytest.raises(catalog.CatalogError):
        store.commit()
    store.drop("t")
    with pytest.raises(catalog.CatalogError):
        store.table("t")


def test_stream_refines(spark, files, tmp_path):
    schema = spark.read.parquet(f"{files}/numbers.parquet").schema
    stream = progressive.running_estimates(progressive.file_stream(spark, f"{files}/numbers.parquet", schema), ["g"], "v", 20_000)
    query = stream.writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path)).start()
    try:
        query.processAllAvailable()
        out = progressive.scaled(spark.table("running")).collect()
        assert sum(r.n for r in out) == pytest.approx(20_000, abs=7) and len(query.recentProgress) >= 3
    finally:
        query.stop()


def test_stream_windows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = progressive.windowed_counts(progressive.file_stream(spark, str(tmp_path / "in"), events.schema, 10), "ts", "event_type")
    query = stream.writeStream.outputMode("update").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        assert spark.table("windows").count() > 0
    finally:
        query.stop()
