import hashlib

from wearline.operators import quality as q


def test_only_candidates_are_hashed(spark):
    long = "x" * 200_000
    rows = [
        (1, "same"), (2, "same"), (3, "diff"), (4, "alone in its size"), (5, None), (6, ""), (7, ""),
        (8, "a" + long + "z"), (9, "a" + long + "z"), (10, "a" + long[:100_000] + "y" + long[100_001:] + "z"), (11, "b" + long + "z"),
    ]
    content = spark.createDataFrame(rows, "id bigint, body string").repartition(3)
    stages = q.duplicate_stages(content, "id", "body")
    ids = lambda name: {r["id"] for r in stages[name].select("id").collect()}
    assert ids("sized") == {1, 2, 3, 6, 7, 8, 9, 10, 11}
    assert ids("boundary") == ids("hashed") == {1, 2, 6, 7, 8, 9, 10}  # 10 agrees with 8 and 9 at both ends
    assert ids("full") == {1, 2, 6, 7, 8, 9}
    got = {(r["id"], r["digest"], r["copies"]) for r in q.duplicate_content(content, "id", "body").collect()}
    assert got == {(i, hashlib.sha256(b.encode()).hexdigest(), 2) for i, b in rows if i in (1, 2, 6, 7, 8, 9)}
    counts = q.duplicate_counters(content, "id", "body").first()
    assert (counts["boundary_hashed"], counts["fully_hashed"], counts["duplicate_groups"], counts["duplicate_rows"]) == (9, 7, 3, 6)


def test_no_exchange_carries_a_body(spark, tmp_path):
    content = spark.createDataFrame([(i, f"body {i % 7} " + "y" * (i % 3)) for i in range(60)], "id bigint, body string")
    content.write.parquet(str(tmp_path / "content"))
    seen = []
    original = q.cut

    def noted(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return original(df)

    q.cut = noted
    try:
        q.duplicate_stages(spark.read.parquet(str(tmp_path / "content")), "id", "body")
    finally:
        q.cut = original
    assert len(seen) == 4
    for plan in seen:
        exchanges = [line for line in plan.splitlines() if "Exchange" in line]
        assert exchanges and not any("body" in line for line in exchanges)
    whole = seen[-1]
    assert whole.count("Filter") and "sha2(" in whole


def test_empty_content(spark):
    empty = spark.createDataFrame([], "id bigint, body string")
    assert q.duplicate_content(empty, "id", "body").count() == 0
    assert q.duplicate_counters(empty, "id", "body").first()["fully_hashed"] == 0
