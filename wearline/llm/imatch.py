"""I-Match fingerprints: terms in a band of document frequency, hashed over several randomised lexicon subsets.

The lexicon holds the terms that at least `LEAST` and at most `MOST` of all distinct texts contain; at least two texts must. Document frequencies count
every document. A term's share bounds the lexicon: it cannot have more entries than the mean number of distinct terms of a document
divided by `LEAST`, whatever the size of the corpus. A band of more than `LEXICON_TERMS` terms is an error that asks for a higher `least`; it is never cut.
A document without such terms uses all its terms; one without any term gets the empty fingerprint of level 0.

Each of `SUBSETS` random lexicon subsets exists at nested densities 1, 1/2, 1/4, ... A document hashes its sorted distinct terms over all subsets at
the two densities that leave it about one to three terms a subset, so that short and long texts alike survive edits.
A fingerprint is ``level:hash,...;hash,...`` (two rows of 32-bit hashes in hexadecimal; `-` where no term is in a subset). The
likeness of two fingerprints is the share of equal hashes among the subsets that hold a term of either, at the sparsest level both
have; it estimates the Jaccard similarity of the term sets and is 0 without a common level, 1 for equal fingerprints.

Defined results: NULL text counts as empty; NULL ids come first; rows that repeat an id are ordered by a hash of the text; one document is its own next one;
an empty table gives an empty result. Rows under one id spread over tasks by that hash; rows equal in id and text stay together, two texts held at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Collection, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import arrow_map, held, whole_text

LEAST, MOST = 0.0002, 0.2
SUBSETS = 48
LEXICON_TERMS = 1_000_000
#: Ranges of ids whose first documents the driver looks up.
MOST_RANGES = 8192
_TERM = re.compile(r"\w+")
_SALTS = np.array([int.from_bytes(hashlib.blake2b(f"subset {i}".encode(), digest_size=8).digest(), "little") | 1 for i in range(SUBSETS)], dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def terms(text: str) -> set[str]:
    return set(_TERM.findall(text.lower()))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(hash of a term, documents that hold it), counted inside the map tasks first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held_by: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                held_by.update(terms(text))
            yield pa.RecordBatch.from_arrays([pa.array(word_hashes(held_by).view(np.int64)), pa.array(held_by.values(), pa.int64())], names=["term", "documents"])

    counts = arrow_map(docs.select(whole_text(text_col)), counted, "term long, documents long")
    return counts.groupBy("term").agg(F.sum("documents").alias("documents"))


def lexicon(docs: DataFrame, text_col: str = "text", least: float = LEAST, most: float = MOST, limit: int = LEXICON_TERMS) -> np.ndarray:
    """Sorted hashes of the terms in the band; more than `limit` of them raise an error."""
    total = docs.count()
    low = max(2, int(np.ceil(least * total)))
    band = document_frequencies(docs, text_col).where((F.col("documents") >= low) & (F.col("documents") <= max(2, most * total)))
    rows = band.select("term").limit(limit + 1).toPandas()
    if len(rows) > limit:
        raise ValueError(f"the band holds more than {limit} terms: raise `least` above {least} or `limit`")
    return np.sort(rows["term"].to_numpy(dtype=np.int64).view(np.uint64))


def word_hashes(words: Collection[str]) -> np.ndarray:
    """64-bit hash of every word, without a map of known ones: callers hash each distinct word once."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), dtype=np.uint64, count=len(words))


def depths(hashes: np.ndarray) -> np.ndarray:
    """The depth down to which a term is in each subset: the low zero bits of its salted hash, one row per term."""
    found = np.empty((len(hashes), SUBSETS), dtype=np.uint8)
    for i in range(0, len(hashes), 16_384):
        some = hashes[i : i + 16_384, None]
        mixed = (some ^ (some >> np.uint64(29))) * _SALTS[None, :]
        mixed ^= mixed >> np.uint64(32)
        mixed *= _MIX
        mixed ^= mixed >> np.uint64(29)
        lowest = mixed & (~mixed + np.uint64(1))
        found[i : i + 16_384] = np.where(mixed == 0, 64, np.log2(np.maximum(lowest, 1).astype(np.float64)))
    return found


class Fingerprinter:
    """Fingerprints of texts under one lexicon, whose terms' depths are worked out once."""

    def __init__(self, band: np.ndarray, size: int = 150_000):
        self.band, self.depths = band, depths(band)
        self.place: dict[str, int] = {}
        self.size = size

    def _look_up(self, words: set[str]) -> None:
        """Remembers where the lexicon holds some words; -1 if it does not."""
        if len(self.place) > self.size:
            self.place.clear()
        if unknown := list(words.difference(self.place)):
            values = word_hashes(unknown)
            spots = np.minimum(np.searchsorted(self.band, values), max(0, len(self.band) - 1))
            if len(self.band):
                spots[self.band[spots] != values] = -1
            else:
                spots[:] = -1
            self.place.update(zip(unknown, spots.tolist()))

    def __call__(self, text: str) -> str:
        words = terms(text)
        if not words:
            return "0:;"
        self._look_up(words)
        place = self.place
        if chosen := sorted([w for w in words if place[w] >= 0]):
            spots = np.fromiter(map(place.__getitem__, chosen), dtype=np.int64, count=len(chosen))
            hashes, deep = self.band[spots], self.depths[spots]
        else:
            hashes = word_hashes(chosen := sorted(words))
            deep = depths(hashes)
        level = max(0, int(np.log2(len(chosen) / 1.5)))
        deep = np.ascontiguousarray(deep.T).ravel()  # all terms of a subset side by side
        inside = np.flatnonzero(deep >= level)
        deeper = inside[deep[inside] > level]
        rows = (_subset_hashes(hashes, *np.divmod(spots, len(chosen))) for spots in (inside, deeper))
        return f"{level}:{';'.join(','.join(row) for row in rows)}"


def _subset_hashes(hashes: np.ndarray, subset: np.ndarray, term: np.ndarray) -> list[str]:
    """One hash per subset over its terms in sorted order."""
    sizes = np.bincount(subset, minlength=SUBSETS)
    starts = np.cumsum(sizes) - sizes
    nth = np.arange(len(subset)) - np.repeat(starts, sizes)
    parts = (hashes[term] + nth.astype(np.uint64) * _MIX) * np.uint64(0xD6E8FEB86659FD93)
    parts ^= parts >> np.uint64(32)
    parts *= _MIX
    full = np.flatnonzero(sizes)
    found = ["-"] * SUBSETS
    if len(full):
        for i, value in zip(full.tolist(), (np.add.reduceat(parts, starts[full]) >> np.uint64(32)).tolist()):
            found[i] = f"{value:x}"
    return found


def _worker_fingerprinter(band: np.ndarray, mark: str) -> Fingerprinter:
    return held(("imatch", mark), lambda: Fingerprinter(band))


def _mark(band: np.ndarray) -> str:
    return hashlib.blake2b(band.tobytes(), digest_size=16).hexdigest()


def likeness(one: str, other: str) -> float:
    """Share of equal hashes at the sparsest level both fingerprints have."""
    if one == other:
        return 1.0
    (a, rows_a), (b, rows_b) = (f.split(":") for f in (one, other))
    a, b = int(a), int(b)
    level = min(a, b) + 1
    if level < max(a, b):
        return 0.0
    left, right = rows_a.split(";")[level - a].split(","), rows_b.split(";")[level - b].split(",")
    held = same = 0
    for x, y in zip(left, right):
        held += x != "-" or y != "-"
        same += x == y and x != "-"
    return same / held if held else 0.0


def with_next(docs: DataFrame, id_col: str, text_col: str, make: Callable[[Iterator[tuple], Callable], Iterator[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """Rows made from every document and its successor by id (the first follows the last), which a task reads in order.

    Documents are dealt by ranges of ids that a sample of the ids proposes; the first document of a range also goes to the range before it, so
    the text is shuffled once and a task holds two documents at a time.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    rows = rows.withColumn("key", F.struct(F.col("doc_id").isNotNull().alias("there"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash")))
    cuts = _cuts(rows, min(MOST_RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ranged = rows.withColumn("bucket", _range_of(F.col("key"), cuts))
    # the first document of every range: one key per range
    firsts = sorted((r["bucket"], tuple(r["first"])) for r in ranged.groupBy("bucket").agg(F.min("key").alias("first")).collect())
    if not firsts:
        return spark.createDataFrame([], ddl)
    first_of, earlier = [(False, 0, 0)] * (len(cuts) + 1), [0] * (len(cuts) + 1)
    for i, (b, key) in enumerate(firsts):
        first_of[b], earlier[b] = key, firsts[i - 1][0]

    def of(table: Column) -> Column:
        return F.get(table, F.col("bucket"))

    is_first = F.col("key") == of(_keys(first_of))
    before = of(F.array(*[F.lit(n).cast("long") for n in earlier]))
    stay = F.struct(F.col("bucket").cast("long").alias("to"), F.lit(False).alias("extra"))
    dealt = ranged.withColumn("go", F.explode(F.when(is_first, F.array(stay, F.struct(before.alias("to"), F.lit(True).alias("extra")))).otherwise(F.array(stay))))
    ordered = dealt.select("go.to", "go.extra", "doc_id", "text_hash", "text").repartition("to").sortWithinPartitions("to", "extra", "doc_id", "text_hash")

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple]:
            held = None
            for batch in batches:
                for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if held is not None and held[0] == row[0] and not held[1]:
                        yield held[2], held[4], row[4]
                    held = row

        made: list[tuple] = []
        for row in make(pairs()):
            made.append(row)
            if len(made) == 512:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema, strict=True)], schema=schema)
                made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema, strict=True)], schema=schema)

    return arrow_map(ordered, streamed, ddl)


def _cuts(rows: DataFrame, parts: int) -> list[tuple]:
    """Keys that deal rows to about `parts` ranges; an id (or NULL) that fills several ranges is divided by the hash of the text."""
    ids = rows.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("double").alias("x"))
    total, there = rows.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    found = Counter(int(c) for c in ids.approxQuantile("x", [i / parts for i in range(1, parts)], 1 / (4 * parts)))
    without = -(-parts * (total - there) // max(1, total))
    cuts = [(False, 0, h) for h in _even(without)[1:]]
    for c, n in sorted(found.items()):
        cuts += [(True, c, h) for h in _even(n)]
    return cuts


def _even(n: int) -> list[int]:
    """The lower ends of n even ranges of 64-bit hashes."""
    return [-(1 << 63) + (i << 64) // n for i in range(n)]


def _keys(keys: list[tuple]) -> Column:
    return F.array(*[F.struct(F.lit(there).alias("there"), F.lit(i).cast("long").alias("id"), F.lit(h).cast("long").alias("text_hash")) for there, i, h in keys])


def _range_of(value: Column, cuts: list[tuple]) -> Column:
    """Number of cuts at or below a key, by halving."""
    if not cuts:
        return F.lit(0)
    table = _keys(cuts)

    def step(state: Column, _: Column) -> Column:
        middle = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        below = value < F.get(table, middle)
        return F.when(state["lo"] >= state["hi"], state).when(below, F.struct(state["lo"].alias("lo"), middle.alias("hi"))).otherwise(F.struct((middle + 1).alias("lo"), state["hi"].alias("hi")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), step, lambda s: s["lo"])


def fingerprints(docs: DataFrame, band: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every whole text."""
    mark = _mark(band)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = _worker_fingerprinter(band, mark)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([make(t) for t in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col)), rows, "doc_id long, fingerprint string")


_EDITED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edited_fingerprints(docs: DataFrame, band: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint next to those of its edited text and of the next document."""
    mark = _mark(band)

    def made(pairs: Iterator[tuple]) -> Iterator[tuple]:
        make = _worker_fingerprinter(band, mark)
        text, following_mark = None, ""
        for doc, own, following in pairs:
            own_mark = following_mark if own is text else make(own)
            text, following_mark = following, make(following)
            half = len(own) // 2
            edited = own[: len(own) - half] + following[:half]
            other = make(edited)
            yield doc, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own_mark, other, likeness(own_mark, other), likeness(own_mark, following_mark)

    return with_next(docs, id_col, text_col, made, _EDITED, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
