"""Runs found on the grammar next to a plain search over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from wearline.llm import periodic_runs


def plain(w):
    """Every maximal stretch of every period that is its smallest one."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)  # periods come in ascending order
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def texts(rng, pieces):
    w = []
    for _ in range(rng.randint(0, pieces)):
        kind = rng.random()
        if kind < 0.3:
            w += [rng.randint(0, 3000) for _ in range(rng.randint(0, 40))]
        elif kind < 0.5:
            w += [rng.randint(0, 1) for _ in range(rng.randint(0, 60))]
        elif kind < 0.65:
            inner = [rng.randint(0, 3) for _ in range(rng.randint(1, 4))] * rng.randint(2, 12) + [rng.randint(0, 9)]
            w += (inner * rng.randint(2, 6))[: rng.randint(1, 300)]
        else:
            base = [rng.randint(0, rng.choice([2, 5, 1000])) for _ in range(rng.randint(1, 30))]
            w += (base * rng.randint(2, 12))[: rng.randint(1, 300)]
    return w


def test_random_texts_match_the_plain_search():
    rng = random.Random(11)
    for _ in range(80):
        docs = [texts(rng, 6) for _ in range(rng.randint(1, 6))]
        found = periodic_runs.runs([np.array(d, dtype=np.int32) for d in docs])
        assert [[tuple(r) for r in f.tolist()] for f in found] == [plain(d) for d in docs]


def test_words_without_square_structure():
    thue = [bin(i).count("1") % 2 for i in range(2000)]
    fib = [0]
    other = [0, 1]
    while len(other) < 1500:
        fib, other = other, other + fib
    assert [[tuple(r) for r in f.tolist()] for f in periodic_runs.runs([np.array(thue, np.int32), np.array(other, np.int32)])] == [plain(thue), plain(other)]


def test_grammar_derives_the_words():
    rng = random.Random(2)
    words = np.array(texts(rng, 6) * 3 + [10**6], dtype=np.int64)
    grammar = periodic_runs.Grammar(words, np.where(np.arange(len(words)) == len(words) - 1, -1, 0))
    for node in range(grammar.nodes):
        own = words[grammar.first[node] : grammar.stop[node]]
        assert grammar.first[node] < grammar.middle[node] < grammar.stop[node]
        for place in grammar.place[grammar.node == node]:
            assert (words[place : place + len(own)] == own).all()


def test_long_texts_take_little_more_than_their_words():
    for words, run in (([0] * 200_000, (0, 200_000, 1)), (list(range(30_000)) * 4, (0, 120_000, 30_000)), (([1] * 7 + [2]) * 20_000, (0, 160_000, 8))):
        assert [tuple(r) for r in periodic_runs.runs([np.array(words, np.int32)])[0].tolist()] == [run]


def repeated(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 or not w:
        return w
    g, n = zlib.crc32(str(doc_id).encode()) // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    w = repeated(doc_id, text)
    found = plain(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def got(frame):
    rows = periodic_runs.summary(periodic_runs.periodic_runs(periodic_runs.with_repeats(frame))).collect()
    return sorted(((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in rows), key=str)


def test_the_query_matches_a_plain_version(table):
    rng = random.Random(4)
    docs = [(i, " \n".join(f"w{x}" for x in texts(rng, 4))) for i in range(120)]
    docs += [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(0, 200)))) for i in range(-60, 0)]
    assert got(table(docs)) == sorted((expected(*d) for d in docs), key=str)


def test_odd_rows_empty_tables_and_names(spark, table):
    odd = [r for r in ODD if r[0] != 9] + [(9, "long words here again " * 300), (8, "a\x0bb\x1cc d"), (8, "a\x0bb\x1cc d")]
    assert got(table(odd)) == sorted((expected(*d) for d in odd), key=str)
    assert got(table(odd).limit(0)) == []
    named = table(odd).select("doc_id", "text", F.lit("x").alias("runs"), F.lit(1).alias("words"), F.lit("g").alias("g"), F.lit(2).alias("a"))
    assert got(named) == got(table(odd))
