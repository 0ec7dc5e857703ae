"""Benchmark decontamination by winnowing.

Every span of `span` words has `span - k + 1` grams of `k` words; the least hash among them is its fingerprint. Equal
spans choose equal grams, so every shared span of `span` words or more is met through a shared fingerprint. An item of
fewer words is one span whose only gram is the span itself.

1. `spans` of the items: (fingerprint, 128-bit digest of the whole span) with the items that hold it.
2. The fingerprints become a `Sieve` of bounded size; document tasks keep only fingerprints that pass it, so a clean document ships nothing.
3. Fingerprints of documents and items are joined and each hit is extended to the whole span around it: digests must agree.
4. Hits of a document are united to stretches; documents that hold the same spans look their items up once.

Both joins spread a key over `SALT` copies of the item side, so a passage that a third of all documents share does not meet in one task.

Defined results: NULL and empty texts have no words and no hits; NULL items never occur. Rows that repeat an id stay rows of their own. Items
that repeat an id count as one; a NULL id reads as the empty text. Very long texts are whole rows of their own Arrow batches. Equal grams have
equal hashes, so ties make no difference. An empty table of items leaves every document clean; an empty table of documents gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import arrow_map, cut
from wearline.llm.words import Sieve, chunks, folded_words, list_column, mixed

#: Words of a shared span and of a gram.
SPAN, GRAM = 10, 5
#: Copies of the item side of a join.
SALT = 8
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def hashed(words: Sequence[bytes]) -> np.ndarray:
    """Two 64-bit hashes of every word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype=">u8").astype(np.uint64).reshape(-1, 2).T


def grams(words: np.ndarray, length: int, step: int) -> np.ndarray:
    """Hash of every `length` words in a row; other lengths and other steps give other hashes."""
    n = words.shape[-1] - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, length, dtype=np.uint64)
    for j in range(length):
        total = total * _STEPS[step] + words[j : j + n]
    return mixed(total)


def winnowed(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` values in a row."""
    n = max(0, len(values) - width + 1)
    least = values[:n].copy()
    for j in range(1, width):
        np.minimum(least, values[j : j + n], out=least)
    return least


def fingerprinted(words: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The fingerprint of every span of `length` words."""
    gram = min(gram, length)
    return winnowed(grams(words[0], gram, 0), length - gram + 1)


def _digests(words: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the spans at some starts."""
    made = []
    for half, step in ((0, 1), (1, 2)):
        total = np.full(len(starts), length, dtype=np.uint64)
        for j in range(length):
            total = total * _STEPS[step] + words[half][starts + j]
        made.append(mixed(total).view(np.int64))
    return made[0], made[1]


def spans(items: DataFrame, id_col: str, text_col: str, span: int, gram: int) -> DataFrame:
    """(item, length, mark, one, two): the spans of every item; `mark` is the fingerprint, `one` and `two` the digest."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, known in chunks(batches, folded_words):
            hashes, out = hashed(known), []
            for item, text in zip(ids, texts, strict=True):
                length = min(span, len(text))
                if not length:
                    continue
                words = hashes[:, text]
                marks = fingerprinted(words, length, gram)
                one, two = _digests(words, np.arange(len(marks)), length)
                out.append((np.full(len(marks), item, dtype=object), np.full(len(marks), length), marks.view(np.int64), one, two))
            if out:
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["item", "length", "mark", "one", "two"])

    return arrow_map(items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)), rows, "item string, length int, mark long, one long, two long").distinct()


def candidates(docs: DataFrame, id_col: str, text_col: str, lengths: Iterable[int], gram: int, sieve: Sieve) -> DataFrame:
    """Every document (row, doc_id, n_words) with the different spans whose fingerprint passes the sieve and where they start."""
    lengths = sorted(lengths)
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, known in chunks(batches, folded_words):
            sizes = np.array([len(t) for t in texts])
            heads = np.cumsum(sizes) - sizes
            words = hashed(known)[:, np.concatenate([np.zeros(0, np.int32), *texts])]
            text = np.repeat(np.arange(len(texts)), sizes)
            parts = []
            for length in lengths:
                marks = fingerprinted(words, length, gram)
                spots = np.flatnonzero(sieve(marks))
                spots = spots[text[spots] == text[spots + length - 1]]
                one, two = _digests(words, spots, length)
                parts.append((text[spots], np.full(len(spots), length, dtype=np.int64), marks[spots].view(np.int64), one, two, spots - heads[text[spots]]))
            doc, length, mark, one, two, start = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*parts, strict=True) if parts else [()] * 6))
            order = np.lexsort((start, two, one, length, doc))
            doc, length, mark, one, two, start = (c[order] for c in (doc, length, mark, one, two, start))
            same = (doc[1:] == doc[:-1]) & (length[1:] == length[:-1]) & (one[1:] == one[:-1]) & (two[1:] == two[:-1])
            first = np.flatnonzero(np.append(True, ~same)) if len(doc) else np.zeros(0, np.int64)
            fields = [pa.array(c[first], k) for c, k in zip((length, mark, one, two), kinds, strict=True)]
            fields.append(list_column(np.split(start, first[1:]) if len(first) else [], pa.int32()))
            offsets = np.searchsorted(doc[first], np.arange(len(texts) + 1)).astype(np.int32)
            met = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, names=["length", "mark", "one", "two", "starts"]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), met], names=["doc_id", "n_words", "spans"])

    schema = "doc_id long, n_words long, spans array<struct<length: int, mark: long, one: long, two: long, starts: array<int>>>"
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)), rows, schema).withColumn("row", F.monotonically_increasing_id())


def _salted(key: str):
    return F.pmod(F.xxhash64(key), F.lit(SALT)).cast("int").alias("salt")


def _copies():
    return F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Every document with what it shares with the items.

    Returns doc_id, n_words, hits (disjoint stretches ``start``, ``stop`` of shared words, in order) and items (sorted ids as text).
    """
    held = cut(spans(items, item_id_col, item_text_col, span, gram))
    lengths = [r["length"] for r in held.select("length").distinct().collect()]  # at most `span` numbers
    sieve = Sieve.of(held.select("mark").distinct())
    documents = cut(candidates(docs, id_col, text_col, lengths, gram, sieve))

    # spans with the same items form one class, so a passage of an item is one entry of a document however long it is
    keys = ["mark", "one", "two", "length"]
    classes = held.groupBy(*keys).agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("class", F.sha2(F.to_json("items"), 256))
    classes = cut(classes)
    shared = (
        documents.select("row", F.explode("spans").alias("s")).select("row", "s.*", _salted("row"))
        .join(classes.select(*keys, "class", _copies()), [*keys, "salt"])
        .groupBy("row")
        .agg(F.collect_list(F.struct("length", "starts")).alias("spans"), F.sort_array(F.collect_set("class")).alias("classes"))
    )
    found = arrow_map(shared.select("row", "classes", "spans"), united, "row long, classes array<string>, hits array<struct<start: int, stop: int>>")
    found = cut(found)
    sets = (
        found.select("classes").distinct().withColumn("class", F.explode("classes"))
        .join(classes.select("class", "items").distinct(), "class")
        .groupBy("classes")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    )
    named = found.withColumn("salt", _salted("row")).join(sets.select("classes", "items", _copies()), ["classes", "salt"]).select("row", "hits", "items")
    none = F.array().cast("array<struct<start: int, stop: int>>")
    return documents.select("row", "doc_id", "n_words").join(named, "row", "left").select("doc_id", "n_words", F.coalesce("hits", none).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, classes, spans) to (row, classes, hits): overlapping and touching spans become one stretch."""
    for batch in batches:
        firsts, stops = [], []
        for spans_ in batch.column(2).to_pylist():
            start = np.concatenate([np.asarray(s["starts"], dtype=np.int64) for s in spans_])
            stop = np.concatenate([np.asarray(s["starts"], dtype=np.int64) + s["length"] for s in spans_])
            order = np.argsort(start, kind="stable")
            start, reach = start[order], np.maximum.accumulate(stop[order])
            first = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
            firsts.append(start[first])
            stops.append(reach[np.append(first[1:], len(start)) - 1])
        starts = list_column(firsts, pa.int32())
        hits = pa.ListArray.from_arrays(starts.offsets, pa.StructArray.from_arrays([starts.values, list_column(stops, pa.int32()).values], names=["start", "stop"]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), hits], names=["row", "classes", "hits"])


def summary(found: DataFrame) -> DataFrame:
    """The counts and digests of `overlaps`."""
    return found.select(
        "doc_id", "n_words", F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


#: Plain SQL over all spans of ten words.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
spans AS (SELECT DISTINCT item, least(10, len(w)) AS n, unnest([array_to_string(w[p : p + least(10, len(w)) - 1], ' ') for p in range(1, len(w) - least(10, len(w)) + 2)]) AS span FROM b WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM spans),
places AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS p, unnest([array_to_string(w[p : p + n - 1], ' ') for p in range(1, len(w) - n + 2)]) AS span FROM d, lengths WHERE len(w) >= n),
met AS (SELECT r, p, n, item FROM places JOIN spans USING (n, span)),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM met)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM met) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
