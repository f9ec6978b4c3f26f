"""A session over a database folder: exact SQL, changes, or progressive estimates that advance a round a query."""

from __future__ import annotations

import math
import re
import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinlake.functions import scalar
from skeinlake.operators.approx import EXTREME_SIGMAS, INTEGRAL, percent_error
from skeinlake.operators.sampling import BUCKETS, SMALL, SamplePlan, between, bucket
from skeinlake.operators.stats import TableStats, collect_stats, load_stats, numeric_columns, save_stats
from skeinlake.plans.rewrite import Block, Rewriter, dialect, tokens
from skeinlake.sources import catalog, output
from skeinlake.sources.catalog import CatalogError, SnapshotStore
from skeinlake.sources.shared import fresh

CHANGE = re.compile(r"\s*(begin|start\s+transaction|commit|end|rollback|abort|create\s+table|drop\s+table|insert\s+into|delete\s+from)\b(.*?);?\s*$", re.I | re.S)


#: Rounds that one scan of a table sets aside, each in a folder of its own.
AHEAD, ROUND = 10, "sample_round"


@dataclass
class Sample:
    """What a session has read of a table: a folder a round, folders of rounds to come, and the statistics of those already looked at."""

    rounds: int = 0
    paths: list[str] = field(default_factory=list)
    ahead: list[str] = field(default_factory=list)
    rows: int = 0
    seen: int = 0
    stats: TableStats = field(default_factory=TableStats)


@dataclass
class Engine:
    """Tables of a folder as views.

    In a sampling mode each query reads a further round of the tables that it names.  One scan of a table writes
    the next ``AHEAD`` rounds to the shared folder, so the queries of those rounds, and statistics, read samples
    and not the table; the statistics of a round are merged into those before it.  Tables under ``SMALL`` rows
    are whole at once.
    """

    spark: SparkSession
    path: str
    plan: SamplePlan = field(default_factory=SamplePlan)
    scale_filters: bool = False
    tables: dict[str, DataFrame] = field(default_factory=dict)
    samples: dict[str, Sample] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)
    whole: dict[str, TableStats] = field(default_factory=dict)
    store: SnapshotStore | None = None
    seconds: float = 0.0
    estimated: dict[str, bool] = field(default_factory=dict)

    @classmethod
    def open(cls, spark: SparkSession, path: str, tables: list[str] | None = None, mode: str = "all", rate: float = 0.01, seed: int = 42, sigma: float = 2.0, **kw) -> Engine:
        """Register each ``<path>/<table>.parquet`` as a view."""
        engine = cls(spark, path, SamplePlan(mode, rate, 1, seed, sigma), **kw)
        scalar.register(spark)
        for name in engine.discover() if tables is None else tables:
            engine._register(name, spark.read.parquet(f"{path}/{name}.parquet"))
        return engine

    def _register(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df
        for known in (self.sizes, self.whole, self.samples):
            known.pop(name, None)
        df.createOrReplaceTempView(name)

    def discover(self) -> list[str]:
        """Names of the Parquet tables in the folder, through Spark's file system."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        listed = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
        names = [str(x.getPath().getName()) for x in listed]
        return sorted(x.removesuffix(".parquet") for x in names if x.endswith(".parquet"))

    @property
    def rounds(self) -> dict[str, int]:
        return {name: s.rounds for name, s in self.samples.items()}

    def size(self, name: str) -> int:
        if name not in self.sizes:
            self.sizes[name] = self.tables[name].count()  # from Parquet footers
        return self.sizes[name]

    def advance(self, name: str) -> DataFrame:
        """Read a further round of a table and register what has been read so far."""
        table, total = self.tables[name], self.size(name)
        at = self.samples.setdefault(name, Sample())
        at.rounds += 1
        if total < SMALL or (self.plan.rate * at.rounds >= 1 and self.plan.mode != "outlier"):
            at.rows = total
            table.createOrReplaceTempView(name)
            return table
        stats = None
        if self.plan.mode == "outlier":
            if name not in self.whole:
                self.whole[name] = collect_stats(table)
            stats = self.whole[name]
        if self.plan.rate * (at.rounds - 1) < 1:
            if not at.ahead:
                at.ahead = self._set_aside(name, at.rounds - 1, stats)
            path = at.ahead.pop(0)
            at.rows += self.spark.read.schema(table.schema).parquet(path).count()
            at.paths.append(path)
        df = self.spark.read.schema(table.schema).parquet(*at.paths)
        df.createOrReplaceTempView(name)
        return df

    def _set_aside(self, name: str, done: int, stats: TableStats | None) -> list[str]:
        """Folders of the rounds after ``done``, as many as one scan sets aside."""
        table, total, path = self.tables[name], self.size(name), fresh(self.spark, f"rounds-{name}")
        if self.plan.mode in ("random", "outlier"):
            upto = min(done + AHEAD, math.ceil(1 / self.plan.rate))
            at = bucket(table, self.plan.seed)
            which = reduce(lambda out, r: out.when(at < int(min(1.0, self.plan.rate * r) * BUCKETS), F.lit(r)), range(done + 2, upto + 1), F.when(at < int(min(1.0, self.plan.rate * (done + 1)) * BUCKETS), F.lit(done + 1)))
            rows = between(table, self.plan, done, upto, stats, total).select("*", which.alias(ROUND))
            rows.write.partitionBy(ROUND).parquet(path)
        else:  # a run of rows: only its row groups are read, a round at a time
            upto = done + 1
            between(table, self.plan, done, upto, stats, total).write.parquet(f"{path}/{ROUND}={upto}")
        return [self._there(f"{path}/{ROUND}={r}", table.schema) for r in range(done + 1, upto + 1)]

    def _there(self, path: str, schema: T.StructType) -> str:
        """The folder, made if the round had no row."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            self.spark.createDataFrame([], schema).write.parquet(path)
        return path

    def statistics(self, name: str) -> TableStats:
        """Of the sample, or of a whole table: rounds not looked at yet are read once and merged."""
        at = self.samples.setdefault(name, Sample())
        if not at.paths or at.rows == self.size(name):
            if name not in self.whole:
                self.whole[name] = collect_stats(self.tables[name])
            return self.whole[name]
        if at.seen < len(at.paths):
            new = collect_stats(self.spark.read.schema(self.tables[name].schema).parquet(*at.paths[at.seen :]))
            at.stats, at.seen = at.stats.merge(new), len(at.paths)
            at.stats.round, at.stats.n_hat = at.rounds, self.size(name)
        return at.stats

    def save_statistics(self, name: str, path: str) -> None:
        save_stats(self.spark, self.statistics(name), path)

    def load_statistics(self, path: str) -> TableStats:
        return load_stats(self.spark, path)

    def sql(self, text: str) -> DataFrame:
        """A change, or a query: exact in mode ``all``; otherwise a further round of each named table, then estimates where they hold.

        ``estimated`` says of each column of the last answer whether it was scaled.
        """
        began = time.perf_counter()
        change = CHANGE.match(text)
        df = self._change(re.sub(r"\s+", " ", change[1].lower()), change[2].strip()) if change else self._query(dialect(text))
        self.seconds = time.perf_counter() - began
        return df

    def answer(self, text: str) -> list[Row]:
        """The rows of ``sql``; ``seconds`` covers reading, planning and execution.  For results that fit the driver."""
        began = time.perf_counter()
        rows = self.sql(text).collect()
        self.seconds = time.perf_counter() - began
        return rows

    def _query(self, text: str) -> DataFrame:
        df = self.spark.sql(text)
        self.estimated = dict.fromkeys(df.columns, False)
        if self.plan.mode == "all":
            return df
        for name in self.named(text):
            self.advance(name)
        rewriter = Rewriter(set(self.tables), self._estimates, self.scale_filters)
        new = rewriter.run(text)
        if new == text:
            return self.spark.sql(text)
        names = df.columns
        self.estimated = dict(zip(names, rewriter.changed)) if len(rewriter.changed) == len(names) else dict.fromkeys(names, True)
        return self.spark.sql(new).toDF(*names)

    def named(self, text: str) -> list[str]:
        """Tables of the session that a text names, subqueries included."""
        words = {t.strip("`").lower() for t in tokens(text)}
        return sorted(words & set(self.tables))

    def _estimates(self, block: Block) -> dict[str, str]:
        """Text of the estimate of each call, of the call's own type; calls that stay as they are left out."""
        table, at = block.table, self.samples.get(block.table, Sample())
        if not at.rows or at.rows == self.size(table):
            # all was read, or nothing could be: an empty sample knows no count
            return {} if at.rows or not self.size(table) else {c: f"CAST(NULL AS {k})" for c, k in self._types(block).items() if c.lower().startswith(("count", "sum"))}
        factor, out = self.size(table) / at.rows, {}
        numeric = set(numeric_columns(self.tables[table]))
        for call, kind in self._types(block).items():
            name, inside = call.split("(", 1)[0].strip().lower(), call.split("(", 1)[1][:-1].strip()
            column = inside.rsplit(".", 1)[-1].strip("`")
            if name in ("count", "sum"):
                scaled = f"{call} * {factor!r}D"
                out[call] = f"CAST({f'floor({scaled})' if isinstance(kind, INTEGRAL) else scaled} AS {kind.simpleString()})"
            elif column in numeric:
                known = self.statistics(table).columns[column]
                bound = known.mean + (1 if name == "max" else -1) * EXTREME_SIGMAS * known.std
                out[call] = f"CAST({'greatest' if name == 'max' else 'least'}(CAST({call} AS DOUBLE), {bound!r}D) AS {kind.simpleString()})"
        return out

    def _types(self, block: Block) -> dict[str, T.DataType]:
        if not block.calls:
            return {}
        schema = self.spark.sql(f"SELECT {', '.join(f'{c} AS c{i}' for i, c in enumerate(block.calls))} FROM {block.source}").schema
        return {c: f.dataType for c, f in zip(block.calls, schema)}

    def _changed(self, name: str) -> None:
        """Make a view show a table as the store has it now."""
        if name in self.store.names():
            self._register(name, self.store.table(name))
        elif name in self.tables:
            del self.tables[name]
            self.spark.catalog.dropTempView(name)

    def _stored(self, name: str) -> str:
        """A table under the store's care; one of the folder keeps its files as the first snapshot."""
        name = name.strip("`").lower()
        if name not in self.store.names():
            if name not in self.tables:
                raise CatalogError(f"no table {name}", "NoSuchTableError")
            self.store.adopt(name, self.tables[name].schema, [f"{self.path}/{name}.parquet"])
        return name

    def _change(self, what: str, rest: str) -> DataFrame:
        if self.store is None:
            self.store = SnapshotStore(self.spark, fresh(self.spark, "changes"))
        store = self.store
        if what in ("begin", "start transaction"):
            return self._said("begin", store.begin())
        if what in ("commit", "end", "rollback", "abort"):
            number, touched = store.transaction, set(store.names())
            (store.commit if what in ("commit", "end") else store.rollback)()
            for name in touched | set(store.names()):
                self._changed(name)
            return self._said("commit" if what in ("commit", "end") else "rollback", number)
        if what == "create table":
            name, schema = catalog.parse_line(rest)
            if name in self.tables:
                raise CatalogError(f"table {name} exists", "DuplicateTableError")
            store.create(name, schema)
            self._changed(name)
            return self._said("create", store.transaction)
        name, _, rest = rest.partition(" ") if what != "drop table" else (rest, "", "")
        name, rest = self._stored(name), rest.strip()
        if what == "drop table":
            store.drop(name)
            out = self._said("drop", store.transaction)
        elif what == "insert into":
            out = store.insert(name, self.spark.sql(dialect(rest)))
        else:
            found = re.fullmatch(r"(?:where\b(.*))?", rest, re.I | re.S)
            if not found:
                raise CatalogError(f"not a condition: {rest!r}", "ParseError")
            out = store.delete(name, dialect(found[1]) if found[1] else F.lit(True))
        self._changed(name)
        return out

    def _said(self, what: str, number: int | None) -> DataFrame:
        return self.spark.createDataFrame([(what, number)], "done string, transaction long")

    def load(self, name: str, path: str, sep: str = "|", header: bool = False, skip_last: bool = False) -> DataFrame:
        """Append delimited text to a table of the session.  Returns one row ``count``."""
        if self.store is None:
            self.store = SnapshotStore(self.spark, fresh(self.spark, "changes"))
        name = self._stored(name)
        out = self.store.insert(name, catalog.read_delimited(self.spark, path, self.tables[name].schema, sep, header, skip_last))
        self._changed(name)
        return out

    def load_catalog(self, catalog_text: str, root: str, suffix: str = "tbl", sep: str = "|", header: bool = False, mode: str | None = None) -> None:
        """Create and fill a table from ``root/<table>.<suffix>`` for each line of the catalog text; ``mode`` sets how they are sampled."""
        for name, schema in catalog.parse(catalog_text).items():
            self.sql(f"create table {catalog.format_line(name, schema)}")
            self.load(name, f"{root}/{name}.{suffix}", sep, header, skip_last=not header)
        if mode:
            self.plan = SamplePlan(mode, self.plan.rate, 1, self.plan.seed, self.plan.sigma)

    def explain(self, text: str, mode: str = "formatted") -> str:
        return self.spark.sql(f"EXPLAIN {mode.upper()} {dialect(text)}").first()[0]

    def analyze(self, table: str) -> None:
        """Column statistics for cost-based planning of a saved table."""
        self.spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")

    def optimizer(self, on: bool) -> None:
        self.spark.conf.set("spark.sql.cbo.enabled", on)

    def describe(self) -> str:
        return "\n".join(catalog.format_line(name, df.schema) for name, df in sorted(self.tables.items()))

    def functions(self) -> list[str]:
        return scalar.signatures()

    def command(self, line: str) -> str:
        """One line of a shell: ``\\d`` tables, ``\\f`` functions, ``\\a sql`` lines with commas, ``\\l table path [sep] [header]`` load, ``\\t sql`` with time, else SQL."""
        word, _, rest = line.strip().partition(" ")
        if word == "\\d":
            return self.describe() + "\n"
        if word == "\\f":
            return "\n".join(self.functions()) + "\n"
        if word == "\\l":
            name, path, *more = rest.split()
            return f"{self.load(name, path, more[0] if more else '|', len(more) > 1 and more[1].lower() == 'true').first()[0]} rows\n"
        text = output.render(self.sql(rest if word in ("\\a", "\\t") else line), aligned=word != "\\a")
        return text + (f"{self.seconds:.3f} s\n" if word == "\\t" else "")

    def cancel(self) -> None:
        """Stop the running jobs, as on an interrupt."""
        self.spark.sparkContext.cancelAllJobs()

    def reset(self) -> None:
        """Forget the rounds, as between trials."""
        self.samples.clear()
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)


def trials(spark: SparkSession, path: str, table: str, text: str, keys: list[str], value: str, modes: list[str], seeds: list[int], rounds: int = 1, rate: float = 0.01) -> DataFrame:
    """Time and error of a query by mode, seed and round: the table behind a plot of the two.

    ``mape`` is the mean over groups of the error in percent against the exact answer.
    """
    exact = Engine.open(spark, path, [table]).sql(text).select(*keys, F.col(value).alias("__exact")).collect()
    known = spark.createDataFrame(exact)
    rows: list[tuple] = []
    for mode in modes:
        for seed in seeds:
            engine = Engine.open(spark, path, [table], mode=mode, seed=seed, rate=rate)
            for at in range(1, rounds + 1):
                got = engine.answer(text)
                error = spark.createDataFrame(got).join(known, keys).agg(F.avg(percent_error(F.col(value), F.col("__exact"))), F.count("*")).first()
                rows.append((mode, seed, at, engine.seconds, error[0], error[1]))
    return spark.createDataFrame(rows, "mode string, seed int, round int, seconds double, mape double, n_groups long")
