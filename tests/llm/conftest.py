import pytest
from pyspark.sql import types as T

#: A column named like an operator's own output, and an extra one, ride along in every fixture.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("row", T.StringType()), T.StructField("score", T.StringType()),
])


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """Makes a documents table, in several files, of (id, text) or (id, text, lang, source)."""
    from wearline.session import ship_package

    ship_package(spark)

    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, len(r[1] or ""), "x", "y") for r in rows]
        folder = str(tmp_path_factory.mktemp("table") / "documents.parquet")
        spark.createDataFrame(full, SCHEMA).repartition(parts).write.parquet(folder)
        return spark.read.parquet(folder)

    return make


#: Nulls, empties, white space, ties, repeated rows and one long text.
ODD = [
    (3, "alpha beta  gamma"), (1, "alpha beta gamma"), (2, "alpha\tbeta gamma"), (4, ""), (5, None), (6, " "), (7, "MIT License"), (7, "MIT License"),
    (None, "no id here"), (9, "long words here again " * 5000), (10, "<|endoftext|> é ÀÉ ß 日本 'll  x\n\n y "), (11, "..."),
]
