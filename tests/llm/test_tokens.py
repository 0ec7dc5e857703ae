"""Token files, word BPE and packing against the tokenizers library and plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import ODD
from wearline.llm import byte_tokens, packing, token_files, word_bpe


def packed(ids):
    return np.array(ids, dtype="<u4").tobytes()


@pytest.fixture(scope="module")
def byte_bpe():
    return Tokenizer.from_file(byte_tokens.default_path())


@pytest.fixture(scope="module")
def word_tokenizer():
    return Tokenizer.from_file(word_bpe.default_path())


def odd_texts(n, seed):
    r = random.Random(seed)
    parts = ["a", "bc", "é", "日", " ", "  ", "\n", "\t", "'s", "'", "1", "23", ".", "%%%", "<|endoftext|>", "<|startoftext|>", "Ab", "ñ", chr(0xA0), chr(0x3000), chr(0x85), "\x1c", "_", "Σ", "İ", "😀"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(n)]


def test_byte_ids_are_the_library_s(byte_bpe):
    texts = odd_texts(1500, 1)
    want = [packed(e.ids) for e in byte_bpe.encode_batch(texts, add_special_tokens=False)]
    assert byte_tokens.ByteEncoder(byte_tokens.default_path(), size=50).encode(texts) == want  # a map that is renewed all the time


def test_word_ids_and_decoding_are_the_library_s(word_tokenizer):
    one = word_bpe.encoder(word_bpe.default_path())
    r = random.Random(2)
    texts = [*odd_texts(1500, 3), *["".join(r.choice("abeinrst") for _ in range(r.randrange(1, 60))) for _ in range(1500)]]
    for text, want in zip(texts, word_tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert one.encode(text) == packed(want.ids), text
        assert one.decode(packed(want.ids)) == word_tokenizer.decode(want.ids, skip_special_tokens=False)


def test_word_bpe_rows(table, word_tokenizer):
    got = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids), r.decoded) for r in word_bpe.decode(word_bpe.encode(table(ODD))).collect())
    ids = [(d, word_tokenizer.encode(t or "", add_special_tokens=False).ids) for d, t in ODD]
    assert got == sorted((d is None, d or 0, packed(i), word_tokenizer.decode(i, skip_special_tokens=False)) for d, i in ids)


def test_token_files_round_trip(spark, table, byte_bpe, tmp_path):
    token_files.write(table(ODD), str(tmp_path / "tokens"))
    got = [tuple(r) for r in token_files.read(spark, str(tmp_path / "tokens")).collect()]
    got.sort(key=lambda r: r[1])
    start = 0
    for (doc, text), row in zip(sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)), got, strict=True):
        ids = packed(byte_bpe.encode(text or "", add_special_tokens=False).ids + [2])
        assert (row[0], row[1], row[2], bytes(row[3])) == (doc, start, len(ids) // 4, ids)
        start += len(ids) // 4
    sizes = [p.stat().st_size for p in (tmp_path / "tokens").glob("*.bin")]
    assert sum(sizes) == 2 * start  # ids below 2**16 take two bytes
    assert not list((tmp_path / "tokens").glob("*.draft"))


def test_token_files_of_an_empty_table(spark, table, tmp_path):
    assert token_files.write(table(ODD).limit(0), str(tmp_path / "none")) == []
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0


def test_pieces_and_places(table, byte_bpe):
    rows = packing.pack(table(ODD), capacity=64).collect()
    want = Counter()
    for doc, text in ODD:
        ids = byte_bpe.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 64 or 64
        bounds = [0, len(ids)] if len(ids) <= 64 else [0, *range(first, len(ids) + 1, 64)]
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want[doc, i, a, b - a, packed(ids[a:b])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(table(ODD).limit(0)).count() == 0


def test_hot_length_is_ranked_in_blocks(spark):
    rows = spark.range(5000).selectExpr("id AS doc_id", "0 AS piece", "CASE WHEN id % 5 = 0 THEN 7L ELSE 20L END AS length")
    got = packing.placed(rows, capacity=40, block_pieces=100).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 5000
    assert len({r.sequence_id for r in got}) <= -(-(1000 * 7 + 4000 * 20) // 40) + 25


@pytest.mark.parametrize("n", [1, 30, 3000, 3_000_000])
def test_plans_use_up_the_histogram(n):
    r = np.random.default_rng(n)
    lengths = np.clip(r.lognormal(6, 1.2, min(n, 30_000)).astype(int), 1, 2048)
    histogram = {int(k): int(v) * max(1, n // 30_000) for k, v in Counter(lengths.tolist()).items()}
    groups = packing.best_plan(histogram)
    used = Counter()
    for places, count in groups:
        assert sum(places) <= 2048
        for length in places:
            used[length] += count
    assert used == histogram
    least = -(-sum(k * v for k, v in histogram.items()) // 2048)
    assert sum(count for _, count in groups) <= least * 1.01 + 2


def test_least_squares_is_non_negative_and_optimal():
    r = np.random.default_rng(0)
    a, b = r.random((12, 40)), r.random(12) * 10
    x = packing.non_negative_least_squares(a, b, 200)
    gradient = a.T @ (b - a @ x)
    assert (x >= 0).all() and gradient.max() < 1e-6 and abs(gradient[x > 0]).max() < 1e-6


def test_digests_match_spark(spark, table):
    from pyspark.sql import functions as F

    row = word_bpe.encode(table([(1, "some words")])).select("ids", F.sha2("ids", 256).alias("s"), F.crc32("ids").alias("c")).first()
    assert row.s == hashlib.sha256(bytes(row.ids)).hexdigest() and row.c == zlib.crc32(bytes(row.ids))


def test_token_files_of_one_null_id_are_written_by_several_tasks(spark, table, byte_bpe, tmp_path):
    rows = [(None, f"{i:03d} text of no id") for i in range(200)] + [(i, f"row {i}") for i in range(20)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tiny ranges would be merged again
    try:
        shards = token_files.write(table(rows), str(tmp_path / "nulls"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(s["docs"] for s in shards) <= 110 and sum(s["docs"] for s in shards) == 220
    got = sorted(token_files.read(spark, str(tmp_path / "nulls")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 200 + list(range(20))
    texts = [t for _, t in rows[:200]] + [t for _, t in rows[200:]]
    assert [r.n_tokens for r in got] == [len(byte_bpe.encode(t, add_special_tokens=False).ids) + 1 for t in texts]
