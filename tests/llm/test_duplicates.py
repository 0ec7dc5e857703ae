"""Exact and near copies, components and fingerprints against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from wearline.llm import components, exact_dedup, imatch, ngram_join

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def copies():
    return [*ODD, *[(100 + i, "the hot text of many rows") for i in range(60)], (40, "the hot\ntext of  many rows"), (30, f"nbsp{chr(0xA0)}stays"), (31, "nbsp stays")]


@pytest.mark.parametrize("bucket_keys", [1, 4, 16_384])
def test_exact_groups(table, bucket_keys):
    rows = copies()
    groups = defaultdict(list)
    for doc, text in rows:
        groups[SPACES.sub(" ", text or "")].append(doc)
    got = exact_dedup.exact_groups(table(rows), bucket_keys=bucket_keys).collect()
    assert len(got) == len(rows)
    seen = defaultdict(int)
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256 and r.doc_id in groups[t])
        ids = [i for i in groups[text] if i is not None]
        assert r.keep_id == (min(ids) if ids else None) and r.group_size == len(groups[text])
        if r.kept:
            assert r.doc_id == r.keep_id
            seen[text] += 1
    assert dict(seen) == dict.fromkeys(groups, 1)  # one of each, also where id and text repeat


def test_without_copies_keeps_columns(table):
    docs = table(copies())
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({SPACES.sub(" ", t or "") for _, t in copies()})
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_directory_doubles_only_what_is_overfull():
    counts = {0: 50, 1: 50, 2: 1, 9: 1}
    table = exact_dedup.directory(counts, bucket_keys=60, depth=4)
    assert [p for p, _, _ in table] == list(range(16))
    depth = {p: d for p, _, d in table}
    assert depth[0] == depth[1] == 4 and depth[15] == 1
    for first in {b for _, b, _ in table}:
        assert sum(counts.get(p, 0) for p, b, _ in table if b == first) <= 60


def shingles_of(text):
    words = re.findall(r"\w+", (text or "").lower())
    return words, {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_copies():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows, doc = [*ODD], 1000
    for size in (2, 3, 40):
        text = [word() for _ in range(120)]
        for k in range(size):
            edited = list(text)
            for _ in range(k % 4):
                edited[r.randrange(120)] = word()
            rows.append((doc, " ".join(edited)))
            doc += 1
    passage = [word() for _ in range(60)]
    for _ in range(60):  # documents that share a long passage but are no copies
        rows.append((doc, " ".join([*passage, *[word() for _ in range(40)]])))
        doc += 1
    rows += [(doc, "Short TEXT"), (doc + 1, "short, text"), (doc + 2, "short other")]
    return rows


@pytest.mark.parametrize("block", [7, 512])
def test_near_duplicates(table, block):
    rows = near_copies()
    marks = [shingles_of(t) for _, t in rows]
    contents = [" ".join(w) for w, _ in marks]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = defaultdict(set)
    for i in range(len(rows)):
        for j in range(i):
            a, b = marks[i][1], marks[j][1]
            same = contents[i] == contents[j]
            if same or len(a & b) >= 0.8 * len(a | b):
                parent[root(i)] = root(j)
                if not same:
                    links[i].add(contents[j])
                    links[j].add(contents[i])
    classes = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        classes[root(i)].append(doc)
    got = defaultdict(set)
    for r in ngram_join.near_duplicates(table(rows), block=block).collect():
        got[r.doc_id].add((r.class_id, r.n_links))
    found = total = 0
    for i, (doc, _) in enumerate(rows):
        ids = [d for d in classes[root(i)] if d is not None]
        assert {c for c, _ in got[doc]} == {min(ids) if ids else None}
        found, total = found + max(n for _, n in got[doc]), total + len(links[i])
        assert max(n for _, n in got[doc]) <= len(links[i])  # nothing that is not a link
    assert total > 300 and found >= 0.995 * total


def test_one_of_each(table):
    docs = table(near_copies())
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    left = [r.doc_id for r in kept.collect()]
    assert {1000, 1002, 1005} <= set(left) and not {1001, 1003, 1004, 1006} & set(left)
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_one_of_each_judges_rows_with_null_or_repeated_ids_one_by_one(table):
    r = random.Random(6)
    text = lambda: ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(120)]
    edited = lambda words: " ".join([*words[:-1], "edited"])
    near, alone, among_nulls = text(), text(), text()
    rows = [
        (1, " ".join(near)), (None, edited(near)), (None, " ".join(text())), (None, " ".join(text())),  # one NULL id is a near copy, two are not
        (5, " ".join(alone)), (5, edited(near)),  # a repeated id whose second text is a near copy
        (None, " ".join(among_nulls)), (None, edited(among_nulls)),  # a class of NULL ids only
        (8, "twice the same row"), (8, "twice the same row"),
    ]
    left = [(x.doc_id, x.text) for x in ngram_join.one_of_each(table(rows)).collect()]
    assert len(left) == len(set(left)) == 6
    assert {rows[0], rows[2], rows[3], rows[4], rows[8]} <= set(left) and len({rows[6], rows[7]} & set(left)) == 1


def test_prefixes_shorten_until_the_recall_is_reached():
    assert ngram_join.prefix_length(0.8, 0.5) > ngram_join.prefix_length(0.8, 0.99) >= ngram_join.prefix_length(0.8, 0.9999)
    for recall in (0.5, 0.9, 0.995):
        k = ngram_join.prefix_length(0.8, recall)
        assert 1 - (1 - 0.8**k) ** ngram_join.TREES >= recall


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 200), (5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 300: 200}
    assert got == want


def plain_pairs(rows):
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for i, (doc, text) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        half = len(text) // 2
        yield doc, text, text[: len(text) - half] + following[:half], following


def test_edited_fingerprints(spark, table):
    r = random.Random(8)
    rows = [*ODD[:-5], (None, "no id here"), *[(200 + i, " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(r.randrange(40)) for _ in range(r.randrange(1, 200)))) for i in range(60)]]
    docs = table([x for i, x in enumerate(rows) if x[0] != 7 or i == 6])
    band = imatch.lexicon(docs, least=0.02)
    make = imatch.Fingerprinter(band)
    got = sorted(imatch.edited_fingerprints(docs, band).collect(), key=lambda x: (x.doc_id is not None, x.doc_id or 0))
    kept = [x for i, x in enumerate(rows) if x[0] != 7 or i == 6]
    want = list(plain_pairs(kept))
    assert len(got) == len(want)
    for row, (doc, text, edited, following) in zip(got, want, strict=True):
        assert (row.doc_id, row.n_chars, row.edited_sha256) == (doc, len(text), hashlib.sha256(edited.encode()).hexdigest())
        marks = make(text), make(edited), make(following)
        assert (row.fingerprint, row.edited_fingerprint) == marks[:2]
        assert row.near_edited == imatch.likeness(marks[0], marks[1]) and row.near_next == imatch.likeness(marks[0], marks[2])
    whole = imatch.fingerprints(docs, band).collect()
    assert sorted(x.fingerprint for x in whole) == sorted(x.fingerprint for x in got)
    assert imatch.edited_fingerprints(docs.limit(0), band).count() == 0


def test_lexicon_is_the_band_of_document_frequencies(table):
    rows = [(i, " ".join(["everywhere", f"half{i % 2}", f"fifth{i % 5}", f"once{i}"])) for i in range(40)]
    band = set(imatch.lexicon(table(rows), least=0.1, most=0.3).tolist())
    assert band == set(imatch.word_hashes([f"fifth{i}" for i in range(5)]).tolist())


def test_likeness_follows_the_similarity_of_term_sets():
    make = imatch.Fingerprinter(np.zeros(0, np.uint64))
    words = [f"word{i}" for i in range(300)]
    own = make(" ".join(words))
    assert imatch.likeness(own, make(" ".join(reversed(words)))) == 1.0
    near = imatch.likeness(own, make(" ".join([*words[:270], *[f"new{i}" for i in range(30)]])))
    far = imatch.likeness(own, make(" ".join(f"new{i}" for i in range(300))))
    assert near > 0.5 > 0.1 > far


def test_single_document_is_its_own_next(table):
    row = imatch.edited_fingerprints(table([(1, "one two three")]), np.zeros(0, np.uint64)).first()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"one two" + b"one tw").hexdigest()


def test_one_null_id_spreads_over_ranges_of_the_hash(table):
    rows = [(None, f"text {i} of no id") for i in range(60)] + [(5, f"text {i} of five") for i in range(60)] + [(i, f"row {i}") for i in range(10, 40)]
    keyed = table(rows).select("doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    keyed = keyed.withColumn("key", F.struct(F.col("doc_id").isNotNull().alias("there"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash")))
    sizes = [r["count"] for r in keyed.groupBy(imatch._range_of(F.col("key"), imatch._cuts(keyed, 16)).alias("b")).count().collect()]
    assert sum(sizes) == 150 and max(sizes) <= 30
    got = imatch.edited_fingerprints(table(rows), np.zeros(0, np.uint64)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == sorted((d is not None, d or 0) for d, _ in rows)
    ordered = sorted(keyed.collect(), key=lambda r: tuple(r.key))
    make = imatch.Fingerprinter(np.zeros(0, np.uint64))
    want = sorted((make(a.text), imatch.likeness(make(a.text), make(b.text))) for a, b in zip(ordered, ordered[1:] + ordered[:1], strict=True))
    assert sorted((r.fingerprint, r.near_next) for r in got) == want


def test_a_band_beyond_the_limit_is_an_error(table):
    with pytest.raises(ValueError, match="least"):
        imatch.lexicon(table([(i, "some words here") for i in range(4)]), least=0.1, most=1.0, limit=2)


def test_rows_of_one_null_id_fetch_their_own_text_only(table):
    r = random.Random(8)
    text = lambda: ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(60)]
    pairs = [text() for _ in range(25)]
    rows = [(None, " ".join(w)) for w in pairs] + [(None, " ".join([*w[:-1], "edited"])) for w in pairs] + [(None, " ".join(pairs[0]))] * 40 + [(3, " ".join(text())), (None, None)]
    docs = table(rows)
    contents = ngram_join.signatures(docs).groupBy("content").agg(F.min(F.struct("doc_id", "text_hash")).alias("t"), F.max("sig").alias("sig")).select("content", "t.*", "sig").where("sig IS NOT NULL")
    prefix = ngram_join.prefix_length()
    wanted = ngram_join.requests(ngram_join.groups(contents, prefix), contents, prefix, 0.8)
    fetched = ngram_join.with_texts(wanted, docs).collect()
    assert len(fetched) == wanted.count() >= 50  # linear: neither the 90 rows of one id nor the 40 copies multiply
    assert all(ngram_join.content_of(ngram_join.words(x.text)) == bytes(x.content) for x in fetched)
    got = [(x.n_links, x.n_copies) for x in ngram_join.near_duplicates(docs).collect()]
    assert sorted(got) == sorted([(1, 41)] * 41 + [(1, 1)] * 49 + [(0, 1)] * 2)
