"""Odd rows, empty tables, clashing names and letters of all scripts, where other tests do not have them."""

import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import ODD
from wearline.llm import language_id, ngram_join, exact_dedup, packing, secret_scan, toxicity, word_bpe

CLASHING = ["d", "_key", "_hits", "id", "content", "length", "hits", "key", "x", "c0"]


def clashing(frame):
    """The table with extra columns named like what operators use inside."""
    return frame.select("*", *[F.lit(f"extra {n}").alias(n) for n in CLASHING])


def test_word_ids_of_every_code_point():
    """Inside a word, every character below U+20000 gives the library's ids."""
    one, library = word_bpe.encoder(word_bpe.default_path()), Tokenizer.from_file(word_bpe.default_path())
    texts = [f"a{chr(c)}b 1{chr(c)}" for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    wrong = [t for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True) if list(memoryview(one.encode(t)).cast("I")) != e.ids]
    assert not wrong, (len(wrong), [hex(ord(t[1])) for t in wrong[:20]])


def test_one_pass_and_two_give_the_same(table):
    one = sorted((str(r.doc_id), bytes(r.ids), r.decoded) for r in word_bpe.round_trip(table(ODD)).collect())
    two = sorted((str(r.doc_id), bytes(r.ids), r.decoded) for r in word_bpe.decode(word_bpe.encode(table(ODD))).collect())
    assert one == two and len(one) == len(ODD)


@pytest.mark.parametrize("text", ["½ ²", "Ⅷ ⅔", "123 ①", "", "?!", "٣ ৪"])
def test_numerals_are_no_letters(text):
    model = language_id.Model(["de", "en"], {0: {"und": 0}, 1: {"u": 0}, 2: {}, 3: {}, 4: {}}, {s: [[0.5, -0.5]] for s in range(5)})
    assert language_id.words(text) == []
    assert language_id.Classifier(model, 30_000)(text) == ("und", 0.0)
    assert language_id.words("ein½halb x²y") == ["ein", "halb", "x", "y"]
    assert all(unicodedata.category(c)[0] == "L" for w in language_id.words("Straße ªº ʰ 日本 ⅷ¼") for c in w)


SECRET = "password = hunter2secretvalue99"


def test_masking_with_clashing_names_and_repeated_ids(table):
    rows = [(1, SECRET, None, "s1"), (1, "clean text"), (None, f"x {SECRET}x", None, "s2"), (None, None), (2, ""), (2, "")]
    docs = clashing(table(rows))
    got = secret_scan.masked(docs)
    assert got.columns == docs.columns and got.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    found = got.collect()
    assert Counter((r.doc_id, r.text is None, len(r.text or "")) for r in found) == Counter((d[0], d[1] is None, len(d[1] or "")) for d in rows)
    assert all(r[n] == f"extra {n}" for r in found for n in CLASHING)
    assert sum("*" in (r.text or "") for r in found) == 2 and not any("hunter2" in (r.text or "") for r in found)


def test_empty_tables(spark, table):
    none = table(ODD).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.learn(none, labels)
    languages = language_id.learn(none)
    assert secret_scan.scan(none).count() == secret_scan.masked(none).count() == 0
    assert word_bpe.round_trip(none).count() == toxicity.scores(none, model).count() == toxicity.without_toxic(none, model).count() == 0
    assert language_id.predict(none, languages).count() == 0 and exact_dedup.without_copies(none).count() == 0 and ngram_join.one_of_each(none).count() == 0
    assert packing.pack(none).count() == 0 and packing.pieces(none, digests=True).count() == 0


def test_digests_are_those_of_the_ids(table):
    ids = packing.pieces(table(ODD)).select("doc_id", "piece", F.crc32("ids").alias("ids_crc32"))
    digests = packing.pieces(table(ODD), digests=True).select("doc_id", "piece", "ids_crc32")
    assert sorted(map(str, ids.collect())) == sorted(map(str, digests.collect()))


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_over_odd_rows(spark, table, tmp_path, empty):
    """The whole chain over nulls, repeated rows, long texts and clashing names, or over an empty table."""
    docs = clashing(table([*ODD, (20, SECRET), (21, "alpha beta gamma"), (None, None)]))
    docs = docs.limit(0) if empty else docs
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (4, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        after = stage(spark, step, str(tmp_path))
        assert after.columns == docs.columns
        after.write.parquet(str(tmp_path / f"stage{i}"))
        step = spark.read.parquet(str(tmp_path / f"stage{i}"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if empty:
        assert rows == [] and step.count() == 0
    else:
        texts = [r.text for r in step.collect()]
        assert len({" ".join((t or "").split()) for t in texts}) == len(texts) and not any("hunter2" in (t or "") for t in texts)
        assert {r.doc_id for r in rows} == {r.doc_id for r in step.collect()}
