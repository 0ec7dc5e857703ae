"""The registered queries and the pipeline on the smallest tables, next to SQL or plain versions."""

import os
import re
from collections import Counter

import pytest

import corpus_pipeline
from tests.compare import compare, connect
from wearline.llm import language_id, toxicity
from wearline.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def documents(spark):
    from wearline.session import ship_package

    ship_package(spark)
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_thirteen_operators_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(names) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, documents, name):
    assert compare(spark, connect(FOLDER), QUERIES[name], ORACLES[name], FOLDER)[0] == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op9_best_fit_packing", "op13_ranked_search"}))
def test_one_row_per_document(spark, documents, name):
    rows = QUERIES[name](spark, FOLDER).select("doc_id").collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in documents.select("doc_id").collect())


def test_packing_covers_every_document(spark, documents):
    rows = QUERIES["op9_best_fit_packing"](spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in documents.select("doc_id").collect()}
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= 1.02 * -(-total // 2048) + 1


def test_language_accuracy_on_held_out_documents(spark, documents):
    got = language_id.predict(documents, language_id.learn(documents)).where("held_out").join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)


def near(a, b):
    def marks(text):
        words = re.findall(r"\w+", text.lower())
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    a, b = marks(a), marks(b)
    return a == b or len(a & b) >= 0.8 * len(a | b)


def test_pipeline_stages(spark, documents, tmp_path):
    """Each stage next to a plain version on the rows it was given."""
    steps, docs = [documents], documents
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        steps.append(docs)
    assert all(s.columns == documents.columns for s in steps[:5])
    start, calm, single, distinct, masked, packed = ([r.asDict() for r in s.collect()] for s in steps)

    model = toxicity.learn(documents, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.scores(documents, model).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in calm} == {r["doc_id"] for r in start} - rejected

    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for r in sorted(calm, key=lambda r: r["doc_id"]):
        first.setdefault(plain(r["text"]), r["doc_id"])
    assert {r["doc_id"] for r in single} == set(first.values())

    kept, single = {r["doc_id"]: r["text"] for r in distinct}, {r["doc_id"]: r["text"] for r in single}
    assert kept.items() <= single.items()
    ids = sorted(single)
    classes = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if j < i and abs(len(single[i]) - len(single[j])) < 0.5 * len(single[i]) and near(single[i], single[j]):
                a, b = classes[i], classes[j]
                classes = {k: min(a, b) if c in (a, b) else c for k, c in classes.items()}
    assert set(kept) == set(classes.values())

    assert sorted(r["doc_id"] for r in masked) == sorted(kept)
    for r in masked:
        text = kept[r["doc_id"]]
        assert len(r["text"]) == len(text) and all(x == y or x == "*" for x, y in zip(r["text"], text))
        assert not re.search(r"(?:password|token|secret|api_?key) ?[:=] ?[\"']?[0-9a-f]{16,}", r["text"])
        if not re.search(r"token|secret|password|passwd|api|AKIA|[0-9a-f]{24}|BEGIN|eyJ|earer|://", text, re.IGNORECASE):
            assert r["text"] == text
    assert {r["doc_id"] for r in packed} == set(kept)


def test_pipeline_runs_whole(spark, documents):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert rows
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        assert sum(n for _, n in p) <= 2048 and all(a + n == b for (a, n), (b, _) in zip(sorted(p), sorted(p)[1:]))
