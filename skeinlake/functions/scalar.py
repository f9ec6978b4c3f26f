"""Scalar functions, as Column helpers and as SQL functions that Catalyst inlines.

Defaults follow standard SQL: integer division truncates and gives NULL on zero, NULL in gives NULL out.
A SQL function has one type; ``sq``, ``nmin``, ``nmax`` and ``mod`` take whole numbers and others, so a session writes them
out as expressions (``skeinlake.plans.rewrite``) and the functions here serve plain ``spark.sql``.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The date patterns of the string conversions.
DAY_PATTERN, UNIX_DATE_TAIL = "yyyy-MM-dd", "MMM d HH:mm:ss zzz yyyy"

#: name -> (parameters, return type, body); registered as temporary SQL functions.
SQL_FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "sq": ("x DOUBLE", "DOUBLE", "x * x"),
    "sq_int": ("x BIGINT", "BIGINT", "x * x"),
    "nmin": ("a DOUBLE, b DOUBLE", "DOUBLE", "least(a, b)"),
    "nmax": ("a DOUBLE, b DOUBLE", "DOUBLE", "greatest(a, b)"),
    "imin": ("a BIGINT, b BIGINT", "BIGINT", "least(a, b)"),
    "imax": ("a BIGINT, b BIGINT", "BIGINT", "greatest(a, b)"),
    "fmin": ("a DOUBLE, b DOUBLE", "DOUBLE", "least(a, b)"),
    "fmax": ("a DOUBLE, b DOUBLE", "DOUBLE", "greatest(a, b)"),
    "int_div": ("a BIGINT, b BIGINT", "BIGINT", "CASE WHEN b = 0 THEN NULL ELSE a div b END"),
    "getsubstr": ("s STRING, start INT, n INT", "STRING", "CASE WHEN start < 0 OR start > length(s) OR n < 0 THEN '' ELSE substring(s, start + 1, n) END"),
    "epoch": ("", "BIGINT", "unix_timestamp()"),
    "datestringtoepoch": ("s STRING", "BIGINT", f"coalesce(unix_timestamp(try_to_timestamp(s, '{DAY_PATTERN}')), 0)"),
    "datetimestringtoepoch": ("s STRING", "BIGINT", f"coalesce(unix_timestamp(try_to_timestamp(regexp_replace(substring(s, 5), ' +', ' '), '{UNIX_DATE_TAIL}')), 0)"),
    "epochtodatetimestring": (
        "i BIGINT",
        "STRING",
        "concat(date_format(timestamp_seconds(i), 'EEE MMM '), lpad(date_format(timestamp_seconds(i), 'd'), 2, ' '), date_format(timestamp_seconds(i), ' HH:mm:ss zzz yyyy'))",
    ),
    "randint": ("", "BIGINT", "CAST(rand() * 9223372036854774784 AS BIGINT)"),
    "randfloat": ("lo DOUBLE, hi DOUBLE", "DOUBLE", "lo + rand() * (hi - lo)"),
}


def register(spark: SparkSession) -> list[str]:
    """Make every function callable from SQL, once a session; returns the list of signatures."""
    if spark.catalog.functionExists("randfloat"):  # the last of them
        return signatures()
    for name, (parameters, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return signatures()


def signatures() -> list[str]:
    return [f"{name}({parameters}) -> {kind}" for name, (parameters, kind, _) in sorted(SQL_FUNCTIONS.items())]


def sq(x: Column) -> Column:
    return x * x


def nmin(a: Column, b: Column) -> Column:
    return F.least(a, b)


def nmax(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend; NULL on zero."""
    return F.when(b != 0, a % b)


def int_div(a: Column, b: Column) -> Column:
    """Quotient truncated towards zero; NULL on zero."""
    return F.when(b != 0, F.call_function("div", a, b))


def getsubstr(s: Column, start: int, n: int) -> Column:
    """``n`` characters from the 0-based ``start``; empty if ``start`` lies outside the string."""
    return F.when((F.lit(start) < 0) | (F.lit(start) > F.length(s)) | (F.lit(n) < 0), F.lit("")).otherwise(F.substring(s, start + 1, n))


def day_to_epoch(s: Column) -> Column:
    """Seconds at UTC midnight of ``YYYY-MM-DD``; 0 for anything else."""
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(s, F.lit(DAY_PATTERN))), F.lit(0).cast("long"))


def unix_date_to_epoch(s: Column) -> Column:
    """Seconds of ``Mon Jan  2 15:04:05 UTC 2006``; 0 for anything else."""
    tail = F.regexp_replace(F.substring(s, 5, 100), " +", " ")
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(tail, F.lit(UNIX_DATE_TAIL))), F.lit(0).cast("long"))


def epoch_to_unix_date(i: Column) -> Column:
    at = F.timestamp_seconds(i)
    return F.concat(F.date_format(at, "EEE MMM "), F.lpad(F.date_format(at, "d"), 2, " "), F.date_format(at, " HH:mm:ss zzz yyyy"))


def avg_int(x: Column) -> Column:
    """Average of integers, truncated; NULL over no rows."""
    return F.call_function("div", F.sum(x), F.count(x))


def sum_str(x: Column, *order: Column) -> Column:
    """Concatenation of a group's strings, sorted so that the result does not depend on the plan."""
    return F.array_join(F.array_sort(F.collect_list(x)), "") if not order else F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, x.alias("__x")))), lambda r: r["__x"]), "")
