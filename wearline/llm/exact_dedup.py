"""Exact duplicates through an extendible-hash index on shared files; DataFrame operations only.

1. Every row is written once to the shared folder with a row number, its 64-bit hash and the SHA-256 of its normalised text.
2. Grouping by (hash, normalised text) compares the bytes of texts whose hashes meet. Copies are combined inside the map
   tasks first, so a text that a third of all rows repeat reaches its owner as one row per map task.
3. The directory starts with one bucket and doubles while a bucket holds more than `bucket_keys` keys; only overfull
   buckets split. It is computed from key counts of at most 2**MAX_DEPTH hash prefixes, whatever the size of the corpus.
4. An owner task takes whole buckets (ranges of hash prefixes), chains different texts under one hash, and writes its part of the index.
5. Rows look their text up by (bucket, hash) and take the chain entry with their own SHA-256.

Defined results: NULL text counts as empty, and empty texts equal each other. NULL ids sort behind all others. Of rows that agree in
id and text exactly one is kept. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import cut, whole_text
from wearline.session import parameter_table

#: Keys an index bucket holds before it splits.
BUCKET_KEYS = 16_384
#: Longest hash prefix the directory may use, which bounds its size.
MAX_DEPTH = 18
#: White space that counts as one space.
SPACES = r"[\x20\x09-\x0D]+"


def normalised(column: str = "text"):
    return F.regexp_replace(whole_text(column), SPACES, " ")


def directory(counts: dict[int, int], bucket_keys: int, depth: int) -> list[tuple[int, int, int]]:
    """(prefix of `depth` bits, bucket, its own depth) from the number of keys below every prefix.

    Doubles the directory while a bucket is overfull; a bucket's number is its first prefix, so buckets are key ranges.
    """
    below = [counts.get(p, 0) for p in range(1 << depth)]
    buckets = [(0, 0)]  # first prefix, own depth
    for d in range(depth):  # one doubling each
        split = []
        for first, own in buckets:
            width = 1 << (depth - own)
            if own == d and sum(below[first : first + width]) > bucket_keys:
                split += [(first, own + 1), (first + width // 2, own + 1)]
            else:
                split.append((first, own))
        if len(split) == len(buckets):
            break
        buckets = split
    return [(p, first, own) for first, own in buckets for p in range(first, first + (1 << (depth - own)))]


def written_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs` below `d`, with row number, hash and SHA-256, in the shared folder."""
    text = normalised(text_col)
    return cut(
        docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col(id_col).alias("doc_id"), text.alias("norm"))
        .select("d", "doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64("norm").alias("hash"), F.sha2("norm", 256).alias("sha"))
    )


def prefix_bits(keys: int, bucket_keys: int) -> int:
    """Bits of hash prefix that leave two doublings for uneven buckets."""
    return min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, keys) / bucket_keys))) + 2)


def index(rows: DataFrame, text: str, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, DataFrame, int]:
    """The directory (prefix, bucket, depth), the written index (bucket, hash, chain of texts) and the prefix's bits."""
    texts = rows.select("doc_id", "row", "hash", normalised(text).alias("norm"))
    keys = cut(
        texts.groupBy("hash", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("keep_row"), F.count(F.lit(1)).alias("group_size"))
        .select("hash", F.sha2("norm", 256).alias("sha"), "keep_id", "keep_row", "group_size")
    )
    bits = prefix_bits(keys.count(), bucket_keys)
    counts = {r["prefix"]: r["n"] for r in keys.groupBy(_prefix(bits)).agg(F.count(F.lit(1)).alias("n")).collect()}
    table = parameter_table(rows.sparkSession, directory(counts, bucket_keys, bits), "prefix bigint, bucket bigint, depth bigint")
    chains = cut(
        keys.withColumn("prefix", _prefix(bits)).join(F.broadcast(table), "prefix")  # at most 2**MAX_DEPTH rows
        .repartition("bucket")
        .groupBy("bucket", "hash")
        .agg(F.sort_array(F.collect_list(F.struct("sha", "keep_id", "keep_row", "group_size"))).alias("chain"))
    )
    return table, chains, bits


def _prefix(bits: int):
    return F.shiftrightunsigned("hash", 64 - bits).alias("prefix")


def looked_up(rows: DataFrame, table: DataFrame, chains: DataFrame, bits: int) -> DataFrame:
    """Every row (row, doc_id, sha) with the chain entry of its text."""
    found = (
        rows.select("row", "doc_id", "sha", "hash", _prefix(bits))
        .join(F.broadcast(table), "prefix")
        .join(chains, ["bucket", "hash"])
        .select("row", "doc_id", "sha", F.filter("chain", lambda e: e["sha"] == F.col("sha"))[0].alias("e"))
    )
    return found.select(
        "row", "doc_id", F.col("e.keep_id").alias("keep_id"), F.col("e.group_size").alias("group_size"),
        (F.col("row") == F.col("e.keep_row")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = written_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return looked_up(rows, *index(rows, "d.text", bucket_keys)).drop("row")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    rows = written_rows(docs, id_col, text_col)
    keep = looked_up(rows, *index(rows, f"d.`{text_col}`", bucket_keys)).where("kept").select("row")
    return rows.join(keep, "row", "left_semi").select("d.*")


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
