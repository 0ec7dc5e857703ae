"""Words of whole texts as numbers: one dictionary per batch, vectors per document."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lower-cases A-Z and turns every other byte below 0x80 but digits and letters into a space; longer characters keep their bytes.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def folded_words(text: str | None) -> list[bytes]:
    """Matches of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` once A-Z are lower-cased; NULL has none."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def spaced_words(text: str | None) -> list[bytes]:
    """Matches of ``[^\\x20\\x09-\\x0D]+``; NULL has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class Numbers(dict):
    """Words to numbers from 0, in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))


#: Words a task looks at together.
CHUNK = 1_000_000


def chunks(batches: Iterator[pa.RecordBatch], split: Callable[[str | None], list[bytes]], limit: int = CHUNK) -> Iterator[tuple[list, list[np.ndarray], list[bytes]]]:
    """(ids, word numbers per text, the words) of rows (id, text): some texts of about `limit` words together, or one longer text."""
    for batch in batches:
        ids, docs, numbers, held = [], [], Numbers(), 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(doc_id)
            docs.append(numbers.of(split(text.as_py())))
            held += len(docs[-1])
            if held >= limit:
                yield ids, docs, list(numbers)
                ids, docs, numbers, held = [], [], Numbers(), 0
        if ids:
            yield ids, docs, list(numbers)


def mixed(values: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values, one for one."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def list_column(parts: Sequence[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One list per array."""
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


class Sieve:
    """Which 64-bit hashes may be in a set: one bit for the leading bits of each; false alarms only, so an exact join follows."""

    #: Bits per hash, and the least and greatest logarithm of the sieve's bits (8 KB to 16 MB).
    SPARSE, LEAST, MOST = 64, 16, 27

    def __init__(self, bits: int, marks: bytes):
        self.bits, self.marks = bits, np.frombuffer(marks, dtype=np.uint8)

    @classmethod
    def of(cls, hashes: DataFrame) -> Sieve:
        """From a column of longs; what reaches the driver has at most 2**MOST bits, whatever the number of hashes."""
        value = F.col(hashes.columns[0])
        bits = min(cls.MOST, max(cls.LEAST, int(hashes.count() * cls.SPARSE).bit_length()))
        place = F.shiftrightunsigned(value, 64 - bits) + 1
        rows = hashes.where(value.isNotNull()).groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("marks")).collect()
        marks = bytearray((1 << bits) // 8)
        for row in rows:
            at = (row["part"] - 1) * len(row["marks"])
            marks[at : at + len(row["marks"])] = row["marks"]
        return cls(bits, bytes(marks))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - self.bits)
        return (self.marks[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0
