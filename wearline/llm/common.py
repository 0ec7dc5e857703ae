"""Helpers shared by the corpus operators: whole texts, word hashes, sorted runs of Arrow rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.session import cut, scratch, shared_folder

__all__ = ["cut", "scratch", "shared_folder", "documents", "whole_text", "arrow_map", "runs", "word_hashes", "crc_bucket", "Memo", "held"]

#: Bytes of one Arrow batch; very long texts then travel a few rows at a time.
BATCH_BYTES = 16 * 1024 * 1024


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(column: str | Column = "text") -> Column:
    """The text as it is; NULL counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def crc_bucket(column: str, modulus: int) -> Column:
    """The fold a document belongs to: crc32 of its id as text; NULL counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`mapInArrow` with batches bounded by bytes."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[dict[str, list]]:
    """Consecutive rows with equal `keys` as lists per column; the input is sorted by the keys.

    Only one run is held at a time, so callers bound the size of a run before they sort.
    """
    held: dict[str, list] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        marks = list(zip(*[columns[k] for k in keys], strict=True))
        start = 0
        for stop in range(1, len(marks) + 1):
            if stop < len(marks) and marks[stop] == marks[start]:
                continue
            piece = {n: v[start:stop] for n, v in columns.items()}
            if held is not None and all(held[k][0] == v for k, v in zip(keys, marks[start], strict=True)):
                for n, v in piece.items():
                    held[n].extend(v)
            else:
                if held is not None:
                    yield held
                held = piece
            start = stop
    if held is not None:
        yield held


class Memo(dict):
    """A bounded map from words to what a function makes of them.

    A full map starts anew, but what was met since the last start is still taken from the older map. Texts of more than `longest` letters
    are not remembered, so the map is bounded in bytes too.
    """

    def __init__(self, function: Callable, size: int = 150_000, longest: int | None = None):
        super().__init__()
        self.function, self.size, self.longest, self.older = function, size, longest, {}

    def __missing__(self, key):
        if self.longest is not None and len(key) > self.longest:
            return self.function(key)
        if len(self) >= self.size:
            self.older = {}  # frees the former one before the copy
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
        self[key] = value
        return value


_held: dict = {}


def held(key: tuple, make: Callable):
    """What one operator keeps in a worker between its tasks, such as maps of known words; another operator's is let go first.

    So a worker that serves many stages holds the maps of one operator at a time.
    """
    found = _held.get(key)
    if found is None:
        _held.clear()
        found = _held[key] = make()
    return found


def _hashes() -> Memo:
    return held(("word hashes",), lambda: Memo(lambda word: xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))))


def word_hashes(words: Sequence[str]) -> np.ndarray:
    """64-bit hash of every word, the same on every machine."""
    memo = _hashes()
    return np.fromiter((memo[w] for w in words), dtype=np.uint64, count=len(words))
