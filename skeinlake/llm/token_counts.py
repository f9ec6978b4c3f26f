"""Token counts by distinct pre-token.

Each Arrow slice is cut into pre-tokens by the tokenizer's own split pattern.  The pieces of a
pre-token are counted once per worker (a bounded table of pre-token -> pieces), joined to the
per-document pre-token frequencies and summed; the ids of a document are never built.

The join is kept inside the slice: shuffling (document, pre-token) rows would move several times the
corpus, while the table is rebuilt in each worker for a few microseconds a distinct pre-token.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows are counted row by
row; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlake.llm.common import slices, table_path

# The published split pattern of the byte-level vocabulary.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens remembered by a worker; the table restarts beyond it.
MEMO = 300_000

OUT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class PieceCounter:
    """Pieces of whole texts through a table of distinct pre-tokens."""

    def __init__(self, path: str):
        import os

        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        spec = json.loads(open(path, encoding="utf-8").read())
        pre = spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"]:
            raise ValueError(f"{path}: only byte-level vocabularies without a normalizer are counted by pre-token")
        added = [x for x in spec["added_tokens"]]
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in added):
            raise ValueError(f"{path}: added tokens that take neighbouring characters are not supported")
        names = sorted((x["content"] for x in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.words = regex.compile(BYTE_LEVEL_PATTERN)
        self.library = Tokenizer.from_file(path)
        self.pieces: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        out, freqs = [], []
        for text in texts:
            parts, n = [text], 0
            if self.special:
                parts = self.special.split(text)
                n = len(parts) - 1
            freq: Counter = Counter()
            for part in parts:
                freq.update(self.words.findall(part))
            freqs.append(freq)
            out.append(n)
        table = self.pieces
        new = list({t for freq in freqs for t in freq if t not in table})
        if len(table) + len(new) > MEMO:
            table.clear()
            new = list({t for freq in freqs for t in freq})
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            table.update(zip(part, [len(e) for e in self.library.encode_batch(part, add_special_tokens=False)]))
        return [n + sum([table[t] * c for t, c in freq.items()]) for n, freq in zip(out, freqs)]


_COUNTERS: dict[str, PieceCounter] = {}


def _counter(path: str) -> PieceCounter:
    """One per worker process; workers are used again for later tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def token_counts(df: DataFrame, vocabulary: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, UTF-8 bytes, tokens, and whether the tokens exceed ``limit``."""
    path = vocabulary or table_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for part in slices(batches, most=4 << 20):
            texts = [x or "" for x in part.column(1).to_pylist()]
            n = counter.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, OUT)


