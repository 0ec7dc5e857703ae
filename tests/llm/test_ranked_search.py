"""Pipelined accumulators next to plain scores of all documents."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from wearline.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain(docs, items, best=10):
    counts = [(doc, Counter(terms(text))) for doc, text in docs]
    counts = [(doc, c, sum(c.values())) for doc, c in counts if c]
    n_docs, total = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c, n in counts:
            m = 100 - 75 + (75 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if absent else doc, -s) for k, (s, absent, doc) in enumerate(sorted(scored)[:best])]
    return sorted(out, key=str)


def items_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "item_id long, text string, term string, bundle int")


def got(frame):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()), key=str)


def corpus(rng, n):
    # many frequent words, some rare ones, ties, copies, repeated and NULL ids
    rows = []
    for i in range(n):
        words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice([i, i, i, 5, None]), " ".join(words)))
    return rows + rows[:20]


@pytest.mark.parametrize("owners", [1, 2, 4])
def test_random_texts_match_plain_scores(spark, table, owners):
    rng = random.Random(owners)
    docs = corpus(rng, 150)
    items = [(i, " ".join(f"W{int(rng.paretovariate(0.5)) % 400}" for _ in range(rng.randint(0, 25)))) for i in range(30)] + [(3, "w1 w1 w2"), (99, None), (None, "w7 w9")]
    assert got(ranked_search.search(table(docs), items_frame(spark, items), owners=owners)) == plain(docs, items)


def test_many_small_blocks(spark, table):
    rng = random.Random(9)
    docs = corpus(rng, 300)
    items = [(i, " ".join(f"w{int(rng.paretovariate(0.5)) % 400}" for _ in range(12))) for i in range(40)]
    assert got(ranked_search.search(table(docs), items_frame(spark, items), best=3, block_terms=300)) == plain(docs, items, 3)


def test_pruning_drops_only_hopeless_documents():
    import numpy as np

    # item 0: documents 0..4 with sums; the owner adds to document 5 and 1; later owners can add at most 5
    state = (np.zeros(5, np.int16), np.arange(5, dtype=np.uint16), np.array([10, 20, 30, 40, 50]))
    rest = np.zeros((ranked_search.BUNDLE_ITEMS, 2), dtype=np.int64)
    rest[0] = [100, 5]
    postings = {"items": np.array([0]), "lists": np.array([0]), "factors": np.array([2]), "rest": rest.ravel(), "starts": np.array([0, 2]), "docs": np.array([1, 5], dtype=np.uint16), "points": np.array([10, 18])}
    items, docs, sums = ranked_search.added(state, postings, 3, ranked_search.BLOCK_DOCS)
    assert dict(zip(docs.tolist(), sums.tolist())) == {1: 40, 3: 40, 4: 50, 5: 36}  # third best is 40; 36 + 5 still may pass it, 30 + 5 cannot
    rest[0] = [20, 5]  # nobody new can pass the third best of 30
    items, docs, sums = ranked_search.added(state, {**postings, "rest": rest.ravel()}, 3, ranked_search.BLOCK_DOCS)
    assert 5 not in docs.tolist()


def test_odd_rows_empty_tables_and_names(spark, table):
    items = [(1, "alpha gamma"), (2, "LONG words"), (3, "日本 é à"), (4, ""), (5, "absent")]
    assert got(ranked_search.search(table(ODD), items_frame(spark, items))) == plain(ODD, items)
    assert got(ranked_search.search(table(ODD).limit(0), items_frame(spark, items))) == []
    assert got(ranked_search.search(table(ODD), items_frame(spark, items).limit(0))) == []
    named = table(ODD).select("doc_id", "text", F.lit("x").alias("block"), F.lit(1).alias("terms"), F.lit("g").alias("item_id"))
    assert got(ranked_search.search(named, items_frame(spark, items))) == plain(ODD, items)
