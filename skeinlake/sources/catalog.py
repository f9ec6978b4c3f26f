"""Tables of a database folder: one-line catalog text, registration, delimited text, snapshots for changes."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings of the column types in catalog text.
TYPES: dict[str, T.DataType] = {
    "int": T.LongType(),
    "integer": T.LongType(),
    "float": T.DoubleType(),
    "string": T.StringType(),
    "varchar": T.StringType(),
    "text": T.StringType(),
    "bigint": T.LongType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "real": T.DoubleType(),
    "char": T.StringType(),
}
STRING_WIDTH = 32


# The kinds of error that a session tells apart.
ERRORS = (
    "TypeMismatchError", "IncompatibleTypesError", "MalformedDataError", "ParseError", "DuplicateTableError", "NoSuchTableError", "AmbiguousNameError",
    "IllegalOperationError", "IllegalTransactionError", "TupleNotFoundError", "DeadlockError", "PageFullError", "BufferPoolFullError",
)
#: Beginnings of Spark's error conditions, with the kind of each.
CONDITIONS = {
    "PARSE_": "ParseError", "TABLE_OR_VIEW_NOT_FOUND": "NoSuchTableError", "AMBIGUOUS_": "AmbiguousNameError", "DATATYPE_MISMATCH": "TypeMismatchError",
    "CAST_": "MalformedDataError", "MALFORMED_": "MalformedDataError", "FAILED_READ_FILE": "MalformedDataError", "UNRESOLVED_COLUMN": "IncompatibleTypesError", "TABLE_OR_VIEW_ALREADY_EXISTS": "DuplicateTableError",
}


class CatalogError(ValueError):
    """What a table change or catalog text gets wrong, with the kind of error."""

    def __init__(self, message: str, kind: str = "IllegalOperationError"):
        super().__init__(message)
        self.kind = kind


def error_kind(error: Exception) -> str:
    """The kind of an error of this package or of Spark."""
    if isinstance(error, CatalogError):
        return error.kind
    condition = str(getattr(error, "getCondition", lambda: "")() or "")
    return next((kind for start, kind in CONDITIONS.items() if condition.startswith(start)), "IllegalOperationError")


def parse_line(line: str) -> tuple[str, T.StructType]:
    """``name (col type, …)`` to name and schema; case and widths of strings do not matter."""
    found = re.fullmatch(r"\s*(\w+)\s*\((.*)\)\s*", re.sub(r"\b(varchar|char|text|string)\s*\(\s*\d+\s*\)", r"\1", line.lower()), re.S)
    if not found:
        raise CatalogError(f"not a table line: {line!r}", "ParseError")
    fields = []
    for part in found[2].split(","):
        words = part.split()
        if len(words) != 2 or words[1] not in TYPES:
            raise CatalogError(f"not a column: {part.strip()!r}", "ParseError")
        fields.append(T.StructField(words[0], TYPES[words[1]]))
    return found[1], T.StructType(fields)


def format_line(name: str, schema: T.StructType) -> str:
    spelled = {T.LongType: "int", T.IntegerType: "int", T.DoubleType: "float", T.FloatType: "float"}
    return f"{name} ({', '.join(f'{f.name} {spelled.get(type(f.dataType), "string")}' for f in schema)})"


def parse(text: str) -> dict[str, T.StructType]:
    return dict(parse_line(line) for line in text.splitlines() if line.strip())


def column_tables(schemas: dict[str, T.StructType], column: str) -> list[str]:
    """Tables that have a column."""
    return sorted(name for name, schema in schemas.items() if column.lower() in (f.name.lower() for f in schema))


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    sep: str = "|",
    header: bool = False,
    skip_last: bool = False,
    fixed_width: bool = False,
) -> DataFrame:
    """Delimited text without quoting; a bad line fails the job.

    Integers are read through double and truncated, so ``3.9`` reads as 3.  ``skip_last`` drops the empty
    field behind a trailing separator; ``fixed_width`` cuts strings to 32 characters.
    """
    read = [T.StructField(f.name, T.DoubleType() if isinstance(f.dataType, (T.LongType, T.IntegerType)) else f.dataType) for f in schema]
    if skip_last:
        read.append(T.StructField("__tail", T.StringType()))
    df = (
        spark.read.schema(T.StructType(read)).option("sep", sep).option("header", header).option("quote", "").option("mode", "FAILFAST")
        .option("ignoreLeadingWhiteSpace", True).option("enforceSchema", True).csv(path)
    )
    out = []
    for f in schema:
        c = F.col(f.name).cast(f.dataType)
        if fixed_width and isinstance(f.dataType, T.StringType):
            c = F.substring(c, 1, STRING_WIDTH)
        out.append(c.alias(f.name))
    return df.select(*out)


def import_delimited(spark: SparkSession, catalog_text: str, root: str, suffix: str = "tbl", sep: str = "|", target: str | None = None, mode: str = "append") -> dict[str, DataFrame]:
    """Read every table of the catalog from ``root/<table>.<suffix>`` (trailing separator dropped); with ``target``, append as Parquet."""
    out = {}
    for name, schema in parse(catalog_text).items():
        df = read_delimited(spark, f"{root}/{name}.{suffix}", schema, sep, skip_last=True)
        if target:
            df.write.mode(mode).parquet(f"{target}/{name}.parquet")
            df = spark.read.parquet(f"{target}/{name}.parquet")
        out[name] = df
    return out


def rows(spark: SparkSession, values: list[tuple], schema: str | T.StructType) -> DataFrame:
    """Literal rows / in-memory table."""
    return spark.createDataFrame(values, schema)


@dataclass(frozen=True)
class Snapshot:
    """A table at one moment: its schema and the folders that hold its rows."""

    schema: T.StructType
    paths: tuple[str, ...] = ()


@dataclass
class SnapshotStore:
    """Tables as immutable Parquet snapshots; a change writes a new one and moves the pointer.

    ``begin`` … ``commit``/``rollback`` group changes: readers outside keep the committed pointers.  Schema and
    folders of a table are one record, so a rollback brings both back.
    """

    spark: SparkSession
    root: str
    committed: dict[str, Snapshot] = field(default_factory=dict)
    pending: dict[str, Snapshot] | None = None
    transaction: int | None = None
    _ids: Iterator[int] = field(default_factory=lambda: count(1))

    def _now(self) -> dict[str, Snapshot]:
        return self.committed if self.pending is None else self.pending

    def _known(self, name: str) -> Snapshot:
        if name not in self._now():
            raise CatalogError(f"no table {name}", "NoSuchTableError")
        return self._now()[name]

    def names(self) -> list[str]:
        return sorted(self._now())

    def begin(self) -> int:
        """Open a transaction; its number is returned and kept in ``transaction``."""
        if self.pending is not None:
            raise CatalogError("a transaction is open", "IllegalTransactionError")
        self.pending, self.transaction = dict(self.committed), next(self._ids)
        return self.transaction

    def _close(self) -> dict[str, Snapshot]:
        if self.pending is None:
            raise CatalogError("no transaction is open", "IllegalTransactionError")
        pending, self.pending, self.transaction = self.pending, None, None
        return pending

    def commit(self) -> None:
        self.committed = self._close()

    def rollback(self) -> None:
        self._close()

    def create(self, name: str, schema: T.StructType | str, df: DataFrame | None = None) -> None:
        if name in self._now():
            raise CatalogError(f"table {name} exists", "DuplicateTableError")
        self._now()[name] = Snapshot(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)
        if df is not None:
            self.insert(name, df)

    def adopt(self, name: str, schema: T.StructType, paths: list[str]) -> None:
        """A table whose first snapshot are files written elsewhere, which stay as they are."""
        if name in self._now():
            raise CatalogError(f"table {name} exists", "DuplicateTableError")
        self._now()[name] = Snapshot(schema, tuple(paths))
        if self.pending is not None:
            self.committed.setdefault(name, self.pending[name])

    def drop(self, name: str) -> None:
        """The data files stay, as older readers may hold them."""
        self._known(name)
        del self._now()[name]

    def table(self, name: str) -> DataFrame:
        at = self._known(name)
        return self.spark.read.schema(at.schema).parquet(*at.paths) if at.paths else self.spark.createDataFrame([], at.schema)

    def _write(self, name: str, df: DataFrame) -> str:
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def insert(self, name: str, df: DataFrame) -> DataFrame:
        """Append rows by position; arity and types must fit.  Returns one row ``count``."""
        at = self._known(name)
        if len(df.columns) != len(at.schema):
            raise CatalogError(f"{name} has {len(at.schema)} columns, not {len(df.columns)}", "TypeMismatchError")
        renamed = df.toDF(*at.schema.names)
        path = self._write(name, renamed.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in at.schema]))
        self._now()[name] = replace(at, paths=(*at.paths, path))
        n = self.spark.read.schema(at.schema).parquet(path).count()
        return self.spark.createDataFrame([(n,)], "count long")

    def delete(self, name: str, condition: Column | str) -> DataFrame:
        """Rewrite the rows that stay; a NULL condition keeps a row.  Returns one row ``count``."""
        df = self.table(name)
        gone = F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False))
        n = df.filter(gone).count()
        if n:
            self._now()[name] = replace(self._known(name), paths=(self._write(name, df.filter(~gone)),))
        return self.spark.createDataFrame([(n,)], "count long")

    def save(self) -> str:
        return "\n".join(format_line(name, self.committed[name].schema) for name in sorted(self.committed))

    def pointers(self) -> str:
        return json.dumps({name: at.paths for name, at in self.committed.items()}, sort_keys=True)
