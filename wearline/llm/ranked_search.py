"""Ranked lexical search over a term-partitioned index, as a pipeline of cogroups.

1. `index`: map tasks gather documents into blocks of about `BLOCK_TERMS` terms and write an inverted list per term and block. Only terms
   that pass a `Sieve` of the items' terms are listed; lengths count all terms.
2. Counts of the lists give document frequencies, and those the integer weights. The items' terms are dealt to `OWNERS` owners in order of weight,
   rarest first, so that each owner has about the same number of postings.
3. Items travel in bundles. For every block and bundle a sparse set of accumulators (item, document, sum) passes the owners one after the
   other: each stage cogroups the accumulators with the owner's postings of the block and adds integer contributions.
4. An accumulator goes as soon as its sum plus all that later owners can add lies below the tenth best sum of its item in the block: it can
   never be among the ten, so the answer stays whole. New documents enter only while later owners could still lift them there.
5. The last owner hands out the best documents of each block, and a window over these few rows selects the final ones.

Every item is matched with every block, which is the search itself: a stated set of queries against all rows, in blocks. No task holds more
than one block and one bundle; both are bounded whatever the corpus.

Score of a document: the sum over the item's terms, repeats included, of ``w * ((10**9 * tf) div (1000 * tf + 8 * m))`` with
``w = floor(1000 * ln((2N + 2) / (2df + 1)))`` and ``m = 25 + (75 * n * N) div L`` (N documents with a term, L all terms, n the document's terms).

Defined results: NULL and empty texts have no terms; they are never found and, as items, find nothing. Items that repeat an id are searched
one by one. Documents that repeat an id are ranked as rows of their own; equal scores go by ascending id, NULL ids last. Very long texts form
blocks of their own. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wearline.llm.common import arrow_map, cut, scratch
from wearline.llm.words import Numbers, Sieve, folded_words, list_column

#: Terms, and at most documents, of a block; items of a bundle; term owners; documents an item gets.
BLOCK_TERMS, BLOCK_DOCS, BUNDLE_ITEMS, OWNERS, BEST = 2_000_000, 32_768, 256, 4, 10

_INDEX = "doc_ids array<long>, sizes array<int>, terms array<string>, counts array<int>, most array<int>, least array<int>, docs binary, times binary"
_DEALT = "block long, bundle long, owner int, doc_ids array<long>, items array<int>, lists array<int>, factors array<long>, rest array<long>, starts array<int>, docs binary, points binary"
_STATE = "block long, bundle long, items binary, docs binary, sums binary"


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, bundle, item, term, uses): terms of every item with their repeats; `item` numbers the items of a bundle."""

    numbered = cut(items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")))
    # a row number holds its partition in the upper bits and counts from 0 below, so bundles never cross partitions
    return numbered.select("item_id", F.expr(f"row div {BUNDLE_ITEMS}").alias("bundle"), F.expr(f"int(row % {BUNDLE_ITEMS})").alias("item"), "text").transform(_with_terms)


def _with_terms(items: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, uses = [], []
            for text in batch.column(3).to_pylist():
                seen: dict[bytes, int] = {}
                for word in folded_words(text):
                    seen[word] = seen.get(word, 0) + 1
                lists.append([w.decode("utf-8", "surrogatepass") for w in seen])
                uses.append(list(seen.values()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lists, pa.list_(pa.string())), pa.array(uses, pa.list_(pa.int32()))], names=["item_id", "bundle", "item", "terms", "uses"])

    listed = arrow_map(items, rows, "item_id long, bundle long, item int, terms array<string>, uses array<int>")
    return listed.select("item_id", "bundle", "item", F.explode(F.arrays_zip("terms", "uses")).alias("t")).select("item_id", "bundle", "item", F.col("t.terms").alias("term"), F.col("t.uses").alias("uses"))


def _term_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _hash_terms(terms: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([_term_hash(t.encode("utf-8", "surrogatepass")) for t in batch.column(0).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], names=["hash"])

    return arrow_map(terms, rows, "hash long")


def _inverted(ids: list, docs: list[np.ndarray], numbers: Numbers, sieve: Sieve) -> pa.RecordBatch:
    """One block: per listed term how many documents hold it, its most repeats, the shortest of these documents; documents and repeats of all lists."""
    words = list(numbers)
    listed = sieve(np.fromiter(map(_term_hash, words), dtype=np.uint64, count=len(words)))
    sizes = np.array([len(d) for d in docs], dtype=np.int32)
    flat = np.concatenate([np.zeros(0, np.int32), *docs]).astype(np.int64)
    owner = np.repeat(np.arange(len(docs)), sizes)
    keep = listed[flat] if len(flat) else np.zeros(0, dtype=bool)
    posting, times = np.unique(flat[keep] * len(docs) + owner[keep], return_counts=True)
    term, doc = posting // max(1, len(docs)), posting % max(1, len(docs))
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(term)))
    most = np.maximum.reduceat(times, first) if len(first) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(sizes[doc], first) if len(first) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([ids], pa.list_(pa.int64())), list_column([sizes], pa.int32()), pa.array([[words[t].decode("utf-8", "surrogatepass") for t in term[first].tolist()]], pa.list_(pa.string())),
            list_column([counts], pa.int32()), list_column([most], pa.int32()), list_column([least], pa.int32()),
            pa.array([doc.astype(np.uint16).tobytes()], pa.binary()), pa.array([times.astype(np.int32).tobytes()], pa.binary()),
        ],
        names=["doc_ids", "sizes", "terms", "counts", "most", "least", "docs", "times"],
    )


def index(docs: DataFrame, id_col: str, text_col: str, sieve: Sieve, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The written blocks of the inverted index."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, numbers, terms = [], [], Numbers(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                held.append(numbers.of(folded_words(text.as_py())))
                terms += len(held[-1])
                if terms >= block_terms or len(ids) == BLOCK_DOCS:
                    yield _inverted(ids, held, numbers, sieve)
                    ids, held, numbers, terms = [], [], Numbers(), 0
        if ids:
            yield _inverted(ids, held, numbers, sieve)

    blocks = arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), rows, _INDEX)
    return cut(blocks.withColumn("block", F.monotonically_increasing_id()))


def weighted(blocks: DataFrame, used: DataFrame, owners: int) -> tuple[DataFrame, int, int]:
    """(term, weight, limit, owner) of the items' terms in the corpus, the number of documents with a term, and of all their terms."""
    totals = blocks.select(F.explode("sizes").alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum(F.col("n").cast("long")).alias("terms")).first()
    n, length = totals["docs"], totals["terms"] or 0
    lists = blocks.select(F.explode(F.arrays_zip("terms", "counts", "most", "least")).alias("t")).select("t.*")
    counts = lists.groupBy(F.col("terms").alias("term")).agg(F.sum("counts").alias("df"), F.max("most").cast("long").alias("tf"), F.min("least").cast("long").alias("size"))
    known = cut(
        counts.join(used.select("term").distinct(), "term", "left_semi")
        .withColumn("weight", F.floor(1000 * F.log((F.lit(2.0) * n + 2) / (2.0 * F.col("df") + 1))).cast("long"))
        # no document holds the term more often than the most or is shorter than the shortest
        .withColumn("limit", F.expr(f"weight * ((1000000000L * tf) div (1000 * tf + 8 * (25 + (75 * size * {n}L) div {max(1, length)}L)))"))
    )
    # weights are bounded by 1000 * ln(2N + 2), so their postings are a short table
    volume = known.groupBy("weight").agg(F.sum("df").alias("postings")).orderBy(F.col("weight").desc()).collect()
    total, passed, edges = sum(r["postings"] for r in volume), 0, []
    for row in volume:
        if len(edges) + 1 < owners and passed >= total * (len(edges) + 1) / owners:
            edges.append(row["weight"])
        passed += row["postings"]
    owner = sum((F.when(F.col("weight") <= e, 1).otherwise(0) for e in edges), F.lit(0)).cast("int")
    return known.withColumn("owner", owner), n, length


def bundles(used: DataFrame, known: DataFrame) -> DataFrame:
    """One row per bundle: its (item, term, factor, limit, owner) entries; a factor is a term's weight times its repeats in the item."""
    entry = F.struct("item", "term", (F.col("weight") * F.col("uses")).alias("factor"), (F.col("limit") * F.col("uses")).alias("limit"), "owner")
    return used.join(known, "term").groupBy("bundle").agg(F.sort_array(F.collect_list(entry)).alias("entries"))


def dealt(blocks: DataFrame, packed: DataFrame, n: int, length: int, owners: int) -> str:
    """Writes, by owner, every block's postings of a bundle's terms with their points, and where the items use them; returns the folder."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)}
                yield from _split(row, n, length, owners)

    columns = ["block", "doc_ids", "sizes", "terms", "counts", "docs", "times", "bundle", "entries"]
    pairs = blocks.select(*columns[:7]).crossJoin(packed).select(*columns)
    folder = scratch(blocks.sparkSession, "postings")
    arrow_map(pairs, rows, _DEALT).write.partitionBy("owner").parquet(folder)
    return folder


def _split(row: dict, n: int, length: int, owners: int) -> Iterator[pa.RecordBatch]:
    spot = {t: i for i, t in enumerate(row["terms"].as_py())}
    stops = np.cumsum(row["counts"].values.to_numpy(zero_copy_only=False).astype(np.int64))
    docs = np.frombuffer(row["docs"].as_py(), dtype=np.uint16)
    times = np.frombuffer(row["times"].as_py(), dtype=np.int32).astype(np.int64)
    sizes = row["sizes"].values.to_numpy(zero_copy_only=False).astype(np.int64)
    entries = row["entries"].as_py()
    limits = np.zeros((BUNDLE_ITEMS, owners + 1), dtype=np.int64)
    for e in entries:
        if e["term"] in spot:
            limits[e["item"], e["owner"]] += e["limit"]
    rest = np.cumsum(limits[:, ::-1], axis=1)[:, ::-1]  # what an owner and all later ones can add
    for owner in range(owners):
        mine = [e for e in entries if e["owner"] == owner and e["term"] in spot]
        order = sorted({spot[e["term"]] for e in mine})
        number = {s: i for i, s in enumerate(order)}
        taken = [np.arange(stops[s - 1] if s else 0, stops[s]) for s in order]
        starts = np.concatenate([[0], np.cumsum([len(t) for t in taken])])
        flat = np.concatenate([np.zeros(0, np.int64), *taken])
        tf, m = times[flat], 25 + (75 * sizes[docs[flat]] * n) // max(1, length)
        points = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([row["block"].as_py()]), pa.array([row["bundle"].as_py()]), pa.array([owner], pa.int32()),
                pa.array([row["doc_ids"].as_py() if owner == owners - 1 else None], pa.list_(pa.int64())),
                pa.array([[e["item"] for e in mine]], pa.list_(pa.int32())), pa.array([[number[spot[e["term"]]] for e in mine]], pa.list_(pa.int32())),
                pa.array([[e["factor"] for e in mine]], pa.list_(pa.int64())), list_column([rest[:, owner : owner + 2].ravel()], pa.int64()),
                list_column([starts], pa.int32()), pa.array([docs[flat].tobytes()], pa.binary()), pa.array([points.astype(np.int32).tobytes()], pa.binary()),
            ],
            names=[f.split()[0] for f in _DEALT.split(", ")],
        )


def added(state: tuple[np.ndarray, np.ndarray, np.ndarray], postings: dict, best: int, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The accumulators (items, documents, sums) after one owner's contributions, without those that cannot reach the `best`."""
    items, docs, sums = state
    lists, factors, starts = postings["lists"], postings["factors"], postings["starts"]
    begin = np.searchsorted(items, np.arange(BUNDLE_ITEMS + 1))
    uses = np.searchsorted(postings["items"], np.arange(BUNDLE_ITEMS + 1))
    rest = postings["rest"].reshape(BUNDLE_ITEMS, 2)
    out, total = [], np.zeros(documents, dtype=np.int64)
    for item in range(BUNDLE_ITEMS):
        held = slice(begin[item], begin[item + 1])
        mine = range(uses[item], uses[item + 1])
        if held.start == held.stop and not len(mine):
            continue
        total[:] = 0
        total[docs[held]] = sums[held]
        entering = _least(sums[held], best) <= rest[item, 0]  # may documents that have nothing yet still be among the best?
        for u in mine:
            a, b = starts[lists[u]], starts[lists[u] + 1]
            total[postings["docs"][a:b]] += factors[u] * postings["points"][a:b]
        there = np.flatnonzero(total) if entering else docs[held]
        left = total[there]
        stay = (left > 0) & (left + rest[item, 1] >= _least(left, best))
        there, left = there[stay], left[stay]
        out.append((np.full(len(there), item, dtype=np.int16), there.astype(np.uint16), left))
    if not out:
        return items[:0], docs[:0], sums[:0]
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _least(sums: np.ndarray, best: int) -> int:
    """The sum a document needs to be among the `best` so far."""
    return int(np.partition(sums, len(sums) - best)[len(sums) - best]) if len(sums) >= best else 0


def _stage(best: int, last: bool):
    """Cogroup function of one owner: (accumulators, its postings) of one block and bundle to accumulators, or at the end to the best documents."""

    def apply(key, left: pa.Table, right: pa.Table) -> pa.Table:
        block, bundle = (k.as_py() for k in key)
        kinds = (np.int16, np.uint16, np.int64)
        state = tuple(np.concatenate([np.zeros(0, k), *[np.frombuffer(v, dtype=k) for v in left.column(c).to_pylist()]]) for c, k in zip(("items", "docs", "sums"), kinds, strict=True))
        owned = {c: right.column(c).combine_chunks() for c in right.column_names}
        postings = {c: np.concatenate([np.zeros(0, np.int64), *[np.asarray(v) for v in owned[c].to_pylist()]]).astype(np.int64) for c in ("items", "lists", "factors", "rest", "starts")}
        postings["docs"] = np.frombuffer(owned["docs"][0].as_py(), dtype=np.uint16)
        postings["points"] = np.frombuffer(owned["points"][0].as_py(), dtype=np.int32).astype(np.int64)
        items, docs, sums = added(state, postings, best, BLOCK_DOCS)
        if not last:
            return pa.table([pa.array([block]), pa.array([bundle]), *[pa.array([c.tobytes()], pa.binary()) for c in (items, docs, sums)]], names=["block", "bundle", "items", "docs", "sums"])
        ids = owned["doc_ids"][0].values
        known = np.where(ids.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).max, ids.fill_null(0).to_numpy(zero_copy_only=False)) if len(ids) else np.zeros(0, np.int64)
        order = np.lexsort((known[docs], -sums, items))
        items, docs, sums = items[order], docs[order], sums[order]
        nth = np.arange(len(items)) - np.searchsorted(items, items)
        keep = nth < best
        return pa.table(
            [pa.array(np.full(int(keep.sum()), bundle), pa.int64()), pa.array(items[keep].astype(np.int32)), ids.take(pa.array(docs[keep].astype(np.int64))), pa.array(sums[keep])],
            names=["bundle", "item", "doc_id", "score"],
        )

    return apply


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", best: int = BEST, owners: int = OWNERS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The `best` documents of every item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    used = cut(item_terms(items, item_id_col, item_text_col))
    blocks = index(docs, id_col, text_col, Sieve.of(_hash_terms(used.select("term").distinct())), block_terms)
    known, n, length = weighted(blocks, used, owners)
    folder = dealt(blocks, cut(bundles(used, known)), n, length, owners)
    postings = spark.read.schema(_DEALT).parquet(folder)
    none = F.lit(b"")
    state = postings.where("owner = 0").select("block", "bundle", none.alias("items"), none.alias("docs"), none.alias("sums"))
    for owner in range(owners):
        last = owner == owners - 1
        own = postings.where(F.col("owner") == owner)
        state = state.groupBy("block", "bundle").cogroup(own.groupBy("block", "bundle")).applyInArrow(_stage(best, last), "bundle long, item int, doc_id long, score long" if last else _STATE)
    order = Window.partitionBy("bundle", "item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = state.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    names = used.select("bundle", "item", "item_id").distinct()
    return ranked.join(names, ["bundle", "item"]).select("item_id", "rank", "doc_id", "score")


#: Plain SQL over all (item, document) pairs that share a term.
ORACLE = r"""
WITH words AS (
  SELECT rowid AS r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY r),
totals AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sizes),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(big_n) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY term),
items AS (
  SELECT i, item_id, term, count(*) AS uses
  FROM (SELECT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark))
  GROUP BY ALL),
scores AS (
  SELECT i, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id,
         CAST(sum(uses * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM items JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (r), totals GROUP BY i, r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS k FROM scores WHERE score > 0)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM ranked WHERE k <= 10
"""
