"""Results as text: aligned columns or comma-separated lines."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame


def render(df: DataFrame, aligned: bool = True, most: int = 1000) -> str:
    """The first ``most`` rows for reading; larger results are for ``write``."""
    rows = [df.columns, *([("NULL" if v is None else str(v)) for v in r] for r in df.limit(most).collect())]
    if aligned:
        widths = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
        return "\n".join(" | ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in rows) + "\n"
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    return out.getvalue()


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", sep: str = "|") -> None:
    """Whole results, in parallel, as Parquet or delimited text with a header."""
    if kind == "parquet":
        df.write.mode(mode).parquet(path)
    elif kind == "csv":
        df.write.mode(mode).option("sep", sep).option("header", True).csv(path)
    else:
        raise ValueError(f"kind {kind!r} is neither parquet nor csv")
