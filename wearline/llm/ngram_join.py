"""Near duplicates: an n-gram Jaccard join through a MinHash LSH forest with exact verification.

1. Every whole text becomes its set of five-word shingles (lower-cased words; shorter texts are one shingle) and a MinHash
   signature of `TREES` rows of `DEPTH` values. Texts with equal words are one content; a content's copies are joined through it.
2. Each row of a signature is a path in one tree of the forest. Contents meet on a fixed prefix of it: the longest at which two
   contents at the threshold meet in some tree with probability `RECALL` by formula. There is no descent that adapts to the data.
3. Contents below one prefix form a group; large groups are cut into blocks, and pairs of blocks are tasks of bounded size, so that no
   task and no row holds a group and no partner is left out. A pair is taken in the first tree in which it meets, and only if
   its signatures agree within `MARGIN` standard errors of the threshold.
4. Only contents with such a pair fetch their texts, by id and digest of the text, so NULL or repeated ids cost nothing more. A task computes the exact Jaccard similarity of its pairs and emits, per content, the
   number of links and, per group, the links that connect it: never all pairs.
5. Linked contents form classes (connected components). Documents get the class of their content.

Defined results: NULL text counts as empty; texts without words are one content without shingles, which links to nothing else. Ids may be NULL or repeat;
a class is named by its smallest id. n_links counts other contents (not copies) with a similarity at or above the threshold. Links are found
with probability `RECALL` or more each; what is emitted is always verified. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import arrow_map, cut, runs, whole_text, word_hashes
from wearline.llm.components import components

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 16, 8, 0.995
#: Standard errors of the signature's estimate below the threshold at which a pair is still verified.
MARGIN = 4.0
#: Contents in a block of a large group.
BLOCK = 512
_TERM = re.compile(r"\w+")
_U = np.uint64
_PLACES = np.array([int.from_bytes(hashlib.blake2b(f"place {i}".encode(), digest_size=8).digest(), "little") | 1 for i in range(64)], dtype=_U)
_FACTORS = np.array([int.from_bytes(hashlib.blake2b(f"factor {i}".encode(), digest_size=8).digest(), "little") | 1 for i in range(TREES * DEPTH)], dtype=_U)
_SHIFTS = np.array([int.from_bytes(hashlib.blake2b(f"shift {i}".encode(), digest_size=8).digest(), "little") for i in range(TREES * DEPTH)], dtype=_U)


def words(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def shingles(found: list[str], size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of `size` words."""
    if not found:
        return np.zeros(0, _U)
    hashes = word_hashes(found)
    size = min(size, len(found))
    n = len(found) - size + 1
    mixed = np.zeros(n, _U)
    for i in range(size):
        mixed += (hashes[i : i + n] ^ (hashes[i : i + n] >> _U(31))) * _PLACES[i]
    mixed ^= mixed >> _U(32)
    mixed *= _U(0x9E3779B97F4A7C15)
    mixed ^= mixed >> _U(29)
    return np.unique(mixed)


def signature(marks: np.ndarray) -> np.ndarray:
    """The low 16 bits of the smallest value under each of TREES * DEPTH random functions."""
    least = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, dtype=_U)
    for i in range(0, len(marks), 2048):
        np.minimum(least, ((marks[i : i + 2048, None] * _FACTORS[None, :] + _SHIFTS[None, :]) >> _U(16)).min(axis=0), out=least)
    return (least & _U(0xFFFF)).astype("<u2")


def prefix_length(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold still meets in some tree often enough."""
    length = DEPTH
    while length > 1 and 1 - (1 - threshold**length) ** TREES < recall:
        length -= 1
    return length


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written table (doc_id, text_hash, content, sig) of all rows; `content` is a digest of the words, `sig` NULL without words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, sigs = [], []
            for text in batch.column(1).to_pylist():
                found = words(text)
                contents.append(content_of(found))
                sigs.append(signature(shingles(found)).tobytes() if found else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(contents, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "text_hash", "content", "sig"])

    return cut(arrow_map(_texts(docs, id_col, text_col), rows, "doc_id long, text_hash binary, content binary, sig binary"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and text_hash of every row; id and hash name a text, however many rows share an id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.select("doc_id", "text", F.unhex(F.md5("text")).alias("text_hash"))


def content_of(found: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(found).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def groups(contents: DataFrame, prefix: int, block: int = BLOCK) -> DataFrame:
    """(tree, path, lo, hi, block, content) of every content that shares a path; a large group becomes pairs of blocks."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    paths = contents.select("content", "doc_id", "text_hash", "sig", tree).select("content", "doc_id", "text_hash", "tree", F.expr(f"substring(sig, tree * {2 * DEPTH} + 1, {2 * prefix})").alias("path"))
    sizes = paths.groupBy("tree", "path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / block).cast("int")
    shared = paths.join(sizes, ["tree", "path"]).select("*", parts.alias("parts")).withColumn("block", F.pmod(F.xxhash64("content"), "parts").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    return shared.select("tree", "path", "block", "content", "doc_id", "text_hash", other).select("tree", "path", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "content", "doc_id", "text_hash")


_KEYS = ("tree", "path", "lo", "hi")


def _pending(sigs: np.ndarray, tree: int, blocks: np.ndarray, prefix: int, threshold: float) -> np.ndarray:
    """Upper-triangular matrix of the pairs of a group that are verified here."""
    n = len(sigs)
    trees = sigs.reshape(n, TREES, DEPTH)[:, :, :prefix]
    paths = np.zeros((n, TREES), _U)
    for i in range(prefix):  # compared as hashes: only which tree verifies a pair depends on them
        paths = (paths ^ trees[:, :, i].astype(_U)) * _U(0x9E3779B97F4A7C15)
        paths ^= paths >> _U(29)
    least = threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / sigs.shape[1])
    found = np.zeros((n, n), dtype=bool)
    across = bool((blocks != blocks[0]).any())
    for i in range(n - 1):
        near = (sigs[i + 1 :] == sigs[i]).mean(axis=1) >= least
        if tree:
            near &= ~(paths[i + 1 :, :tree] == paths[i, :tree]).any(axis=1)
        if across:
            near &= blocks[i + 1 :] != blocks[i]
        found[i, i + 1 :] = near
    return found


def _linked(marks: list[np.ndarray], pending: np.ndarray, threshold: float) -> np.ndarray:
    """The pending pairs whose exact Jaccard similarity reaches the threshold."""
    n = len(marks)
    sizes = np.array([len(m) for m in marks])
    values, inverse, counts = np.unique(np.concatenate(marks), return_inverse=True, return_counts=True)
    common = counts > 1
    column = np.cumsum(common) - 1
    owner = np.repeat(np.arange(n), sizes)
    keep = common[inverse]
    owner, place = owner[keep], column[inverse[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    shared = np.zeros((n, n), dtype=np.float32)
    width = max(64, 1_000_000 // n)
    for start in range(0, int(common.sum()), width):
        lo, hi = np.searchsorted(place, [start, start + width])
        inside = np.zeros((n, width), dtype=np.float32)
        inside[owner[lo:hi], place[lo:hi] - start] = 1
        shared += inside @ inside.T
    union = sizes[:, None] + sizes[None, :] - shared
    return pending & (shared >= threshold * union - 1e-6)


def requests(grouped: DataFrame, contents: DataFrame, prefix: int, threshold: float) -> DataFrame:
    """The rows of `groups` with a pair to verify, with their signatures."""

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, _KEYS):
            if len(run["tree"]) < 2:
                continue
            sigs = np.frombuffer(b"".join(run["sig"]), "<u2").reshape(-1, TREES * DEPTH)
            pending = _pending(sigs, run["tree"][0], np.array(run["block"]), prefix, threshold)
            rows = np.flatnonzero(pending.any(axis=0) | pending.any(axis=1))
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array([run[f.name][i] for i in rows], f.type) for f in _REQUEST], schema=_REQUEST)

    rows = grouped.join(contents.select("content", "sig"), "content").select(*_KEYS, "block", "content", "doc_id", "text_hash", "sig")
    return arrow_map(rows.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "content"), wanted, _REQUEST_DDL)


_REQUEST = pa.schema([("tree", pa.int32()), ("path", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32()), ("block", pa.int32()), ("content", pa.binary()), ("doc_id", pa.int64()), ("text_hash", pa.binary()), ("sig", pa.binary())])
_REQUEST_DDL = "tree int, path binary, lo int, hi int, block int, content binary, doc_id long, text_hash binary, sig binary"
_LINK = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64())])


def _spot(doc_id: str) -> list[Column]:
    """An id as columns that are never NULL, so that rows without id spread by their text and one shuffle serves grouping and join."""
    return [F.col(doc_id).isNotNull().alias("there"), F.coalesce(doc_id, F.lit(0)).alias("id")]


_SPOT = ["there", "id", "text_hash"]


def with_texts(wanted: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The wanted rows with their texts: one row each, whatever number of rows repeats a text or shares its id."""
    texts = _texts(docs, id_col, text_col).select(*_spot("doc_id"), "text_hash", "text").groupBy(*_SPOT).agg(F.first("text").alias("text"))
    return wanted.select("*", *_spot("doc_id")).join(texts, _SPOT).select(*_KEYS, "block", "content", "sig", "text")


def links(wanted: DataFrame, docs: DataFrame, prefix: int, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written table (a, b, n): rows without b give a content's number of links in one group, the others connect a group."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, _KEYS):
            seen: dict[bytes, tuple[np.ndarray, bytes, int]] = {}
            for content, text, sig, block in zip(run["content"], run["text"], run["sig"], run["block"], strict=True):
                if content not in seen:
                    found = words(text)
                    seen[content] = (shingles(found), sig, block)
            if len(seen) < 2:
                continue
            names = list(seen)
            marks, sigs, blocks = zip(*seen.values())
            sigs = np.frombuffer(b"".join(sigs), "<u2").reshape(-1, TREES * DEPTH)
            linked = _linked(list(marks), _pending(sigs, run["tree"][0], np.array(blocks), prefix, threshold), threshold)
            counts = linked.sum(axis=0) + linked.sum(axis=1)
            rows = [(names[i], None, int(counts[i])) for i in np.flatnonzero(counts)]
            parent = list(range(len(names)))

            def root(i: int, parent: list[int] = parent) -> int:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            for i, j in zip(*[x.tolist() for x in np.nonzero(linked)], strict=True):
                if (r := root(i)) != (s := root(j)):
                    parent[max(r, s)] = min(r, s)
                    rows.append((names[i], names[j], 0))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _LINK, strict=True)], schema=_LINK)

    rows = with_texts(wanted, docs, id_col, text_col)
    return cut(arrow_map(rows.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "content"), verified, "a binary, b binary, n long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per row of `docs`: doc_id, class_id, n_links, n_copies (rows with the same words) and first (whether it is the class's smallest id)."""
    prefix = prefix_length(threshold, recall)
    rows = signatures(docs, id_col, text_col)
    contents = cut(rows.groupBy("content").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("text"), F.count(F.lit(1)).alias("n_copies"), F.max("sig").alias("sig")).select("content", F.col("least").alias("class_id"), "text.*", "n_copies", "sig"))
    with_words = contents.where("sig IS NOT NULL")
    wanted = cut(requests(groups(with_words, prefix, block), with_words, prefix, threshold))
    found = links(wanted, docs, prefix, threshold, id_col, text_col)
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("content")).agg(F.sum("n").alias("n_links"))
    joined = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "content")
    classes = contents.select("content", F.col("class_id").alias("least"), "n_copies").join(joined, "content", "left").withColumn("component", F.coalesce("component", "content"))
    names = classes.groupBy("component").agg(F.min("least").alias("class_id"))
    known = classes.join(names, "component").join(counts, "content", "left").select("content", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.select("doc_id", "content").join(known, "content").select("doc_id", "class_id", "n_links", "n_copies", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("first"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every class of `docs`, with all its columns: the one with the smallest id (NULL last) and of its rows the first written."""
    rows = cut(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.monotonically_increasing_id().alias("row")))
    ids = rows.select("row", F.col(f"d.`{id_col}`").alias("id"))
    found = near_duplicates(rows.select("row", F.col(f"d.`{text_col}`").alias("text")), "row", "text").select(F.col("doc_id").alias("row"), "class_id")
    keep = found.join(ids, "row").groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("first")).select(F.col("first.row").alias("row"))
    return rows.join(keep, "row", "left_semi").select("d.*")
