"""Winnowed spans next to a plain search for shared spans."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from wearline.llm import decontaminate
from wearline.llm.words import Numbers, Sieve, folded_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, span=10):
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            b = words(body)
            n = min(span, len(b))
            pieces = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in pieces:
                    hit |= set(range(i, i + n))
                    found.add("" if item is None else str(item))
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def got(found):
    rows = [(r.doc_id, r.n_words, sum(s.stop - s.start for s in r.hits), list(r["items"])) for r in found.collect()]
    assert all(a.stop < b.start for r in found.collect() for a, b in zip(r.hits, r.hits[1:]))
    return sorted(rows, key=str)


def items_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "item_id long, text string, mark string, `row` int")


def test_folded_words_follow_the_pattern():
    text = "".join(chr(c) for c in range(0x300)) + " Straße ÀÉ 日本 x1-Y2 z"
    assert [w.decode() for w in folded_words(text)] == words(text)
    assert folded_words(None) == folded_words("") == folded_words(" .,;") == []


def test_winnowing_takes_the_least():
    values = np.array([5, 3, 3, 9, 1, 1, 7], dtype=np.uint64)
    assert decontaminate.winnowed(values, 3).tolist() == [3, 3, 1, 1, 1]
    assert len(decontaminate.winnowed(values[:2], 3)) == 0


def test_equal_spans_share_their_fingerprint():
    rng = random.Random(1)
    for _ in range(50):
        shared = [f"w{rng.randrange(30)}" for _ in range(rng.randint(10, 14))]
        texts = [" ".join([f"a{rng.randrange(9)}" for _ in range(rng.randint(0, 20))] + shared + [f"b{rng.randrange(9)}" for _ in range(rng.randint(0, 20))]) for _ in range(2)]
        marks = [set(decontaminate.fingerprinted(decontaminate.hashed(folded_words(t)), 10, 5).tolist()) for t in texts]
        assert marks[0] & marks[1]


def test_sieve_keeps_all_members(spark):
    members = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 3000)
    sieve = Sieve.of(spark.createDataFrame([(int(m),) for m in members], "h long"))
    assert sieve(members.view(np.uint64)).all()
    others = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 20000)
    assert sieve(others.view(np.uint64)).mean() < 0.05
    empty = Sieve.of(spark.createDataFrame([], "h long"))
    assert not empty(members.view(np.uint64)).any()


def test_random_texts_match_the_plain_search(spark, table):
    rng = random.Random(3)
    items = [(i, " ".join(f"v{rng.randrange(40)}" for _ in range(rng.choice([0, 1, 2, 5, 9, 10, 11, 25])))) for i in range(12)]
    items += [(3, items[5][1]), (None, items[6][1]), (50, None), (51, "  .")]
    docs = []
    for i in range(60):
        text = [f"v{rng.randrange(60)}" for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            piece = words(rng.choice(items)[1])
            a = rng.randint(0, len(piece))
            text[len(text) // 2 : len(text) // 2] = [w.upper() for w in piece[a : a + rng.randint(5, 20)]]
        docs.append((rng.choice([i, i, 7, None]), " -\n".join(text)))
    assert got(decontaminate.overlaps(table(docs), items_frame(spark, items))) == plain(docs, items)


def test_odd_rows_empty_tables_and_names(spark, table):
    items = [(1, "alpha beta gamma"), (2, "here again long words here again long words here again long"), (3, "mit license")]
    found = decontaminate.overlaps(table(ODD), items_frame(spark, items))
    assert got(found) == plain(ODD, items)
    none = decontaminate.summary(decontaminate.overlaps(table(ODD), items_frame(spark, items).limit(0)))
    assert none.count() == len(ODD) and none.where("contaminated OR n_hit > 0 OR n_items > 0").count() == 0
    assert {r.items_sha256 for r in none.collect()} == {"e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"}
    assert decontaminate.overlaps(table(ODD).limit(0), items_frame(spark, items)).count() == 0
    named = table(ODD).select(F.col("doc_id").alias("row"), F.col("text").alias("spans"), F.lit(1).alias("doc_id"), F.lit("a").alias("text"))
    assert got(decontaminate.overlaps(named, items_frame(spark, items), "row", "spans")) == plain(ODD, items)


def test_a_passage_a_third_of_all_documents_share(spark, table):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [(i, f"u{i} {passage} x{i}" if i % 3 == 0 else f"u{i} other words {i}") for i in range(300)]
    items = [(1, passage), (2, passage + " more"), (3, "nothing here")]
    found = got(decontaminate.overlaps(table(docs), items_frame(spark, items)))
    assert sum(n == 30 and held == ["1", "2"] for _, _, n, held in found) == 100 and sum(n > 0 for _, _, n, _ in found) == 100


@pytest.mark.parametrize("text", ["", None, "one"])
def test_short_items(spark, table, text):
    docs = [(1, "one two one"), (2, "two")]
    assert got(decontaminate.overlaps(table(docs), items_frame(spark, [(9, text)]))) == plain(docs, [(9, text)])
    assert Numbers().of([]).tolist() == []
