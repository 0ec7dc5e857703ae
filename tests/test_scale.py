import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wearline.operators import scale as sc


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(3)
    unit = np.where(rng.random(900) < 0.4, 0, rng.integers(1, 40, 900))
    return spark.createDataFrame(pd.DataFrame({"unit": unit, "at": rng.permutation(900), "v": rng.integers(0, 50, 900) / 4})), unit


@pytest.mark.parametrize("exclusive", [False, True])
def test_running_totals_agree(hot, exclusive):
    df, _ = hot
    out = [
        sorted(map(tuple, sc.running(df, ["unit"], ["at"], {"s": ("sum", F.col("v")), "m": ("min", F.col("v"))}, split, exclusive).fillna(0).select("unit", "at", "s", "m").collect()))
        for split in (False, True)
    ]
    assert out[0] == out[1]


def test_percentiles_and_ranks_agree_with_pandas(hot):
    df, _ = hot
    pdf = df.toPandas()
    for split in (False, True):
        got = sc.percentiles(df, ["unit"], {"a": (F.col("v"), 0.25), "b": (F.col("v"), 0.5)}, {"n": F.count("*")}, split).toPandas().set_index("unit").sort_index()
        want = pdf.groupby("unit")["v"].quantile([0.25, 0.5]).unstack()
        assert np.allclose(got[["a", "b"]].to_numpy(), want.to_numpy())
        ranks = sc.average_ranks(df, ["unit"], "v", "r", split).toPandas().sort_values("at")["r"].to_numpy()
        assert np.allclose(ranks, pdf.assign(r=pdf.groupby("unit")["v"].rank()).sort_values("at")["r"].to_numpy())
        whole = sc.percentiles(df, [], {"m": (F.col("v"), 0.5)}, split=split).first()["m"]
        assert whole == pdf["v"].median()


@pytest.mark.parametrize("segment", [1, 5, 64, 65536])
def test_trailing_frames_cross_segments(hot, segment):
    df, _ = hot
    indexed = sc.index_units(df, ["unit"], ["at"], split=True)
    out = sc.trailing(indexed, ["unit"], 6, {"m": lambda w: sc.rolling_median("v", w, 7), "b": lambda w: F.lag("v").over(w)}, segment).toPandas()
    want = df.toPandas().sort_values(["unit", "at"])
    want["m"] = want.groupby("unit")["v"].transform(lambda x: x.rolling(7, min_periods=1).median())
    merged = out.merge(want, on=["unit", "at"])
    assert len(out) == len(want) and np.allclose(merged["m_x"], merged["m_y"])
    assert out["b"].isna().sum() == out["unit"].nunique()


def test_middle_ignores_nulls(spark):
    row = spark.range(1).select(sc.middle([F.lit(None).cast("double"), F.lit(3.0), F.lit(1.0), F.lit(2.0), F.lit(10.0)]).alias("m"), sc.middle([F.lit(None).cast("double")]).alias("n")).first()
    assert row["m"] == 2.5 and row["n"] is None


@pytest.fixture(scope="module")
def holes(spark):
    """NULL keys, NULL values, a group of NULLs only, ties."""
    rows = [(None, 1, 2.0), (None, 2, None), (None, 3, 1.0), (1, 1, None), (1, 2, None), (2, 1, None), (2, 2, 5.0), (2, 3, 5.0), (2, 4, 1.0), (3, 1, 0.0)]
    return spark.createDataFrame(rows, "unit int, at int, v double")


def both_plans(make, *columns):
    out = [sorted(make(split).select(*columns).collect(), key=str) for split in (False, True)]
    assert out[0] == out[1]
    return out[1]


@pytest.mark.parametrize("exclusive", [False, True])
def test_running_keeps_nulls_in_both_plans(holes, exclusive):
    totals = {"s": ("sum", F.col("v")), "m": ("min", F.col("v")), "x": ("max", F.col("v"))}
    rows = both_plans(lambda split: sc.running(holes, ["unit"], ["at"], totals, split, exclusive), "unit", "at", "s", "m", "x")
    by = {(r["unit"], r["at"]): r["s"] for r in rows}
    assert len(rows) == 10 and by[1, 2] is None and by[None, 3] == (2.0 if exclusive else 3.0)
    assert by[3, 1] == (None if exclusive else 0.0)


def test_totals_percentiles_and_ranks_keep_nulls_in_both_plans(holes):
    totals = both_plans(lambda split: sc.with_totals(holes, ["unit"], {"n": F.count("v"), "t": F.sum("v")}, split), "unit", "at", "n", "t")
    assert len(totals) == 10 and {r["n"] for r in totals if r["unit"] is None} == {2}
    middles = both_plans(lambda split: sc.percentiles(holes, ["unit"], {"p": (F.col("v"), 0.5)}, {"n": F.count(F.lit(1))}, split), "unit", "p", "n")
    assert {r["unit"]: (r["p"], r["n"]) for r in middles} == {None: (1.5, 3), 1: (None, 2), 2: (5.0, 4), 3: (0.0, 1)}
    ranks = both_plans(lambda split: sc.average_ranks(holes, ["unit"], "v", "r", split), "unit", "at", "v", "r")
    assert {(r["unit"], r["at"]): r["r"] for r in ranks if r["unit"] in (1, 2)} == {(1, 1): 1.5, (1, 2): 1.5, (2, 1): 1.0, (2, 4): 2.0, (2, 2): 3.5, (2, 3): 3.5}


def test_percentiles_of_long_expressions_stay_apart(hot):
    df, _ = hot
    many = [F.when(F.col("v") == i, i) for i in range(60)]
    one, two = (F.coalesce(*many, F.col("v") * k) for k in (1, 2))
    row = sc.percentiles(df, [], {"a": (one, 0.9), "b": (two, 0.9)}, split=True).first()
    same = sc.percentiles(df, [], {"a": (one, 0.9), "b": (two, 0.9)}, split=False).first()
    assert (row["a"], row["b"]) == (same["a"], same["b"])


def test_the_largest_group_decides_beyond_small_sources(spark, hot, monkeypatch):
    from wearline.session import TASK_BYTES_KEY

    df, unit = hot
    most, before = int(np.bincount(unit).max()), spark.conf.get(TASK_BYTES_KEY)
    total = lambda: sc.running(df, ["unit"], ["at"], {"s": ("sum", F.col("v"))})
    middle = lambda: sc.percentiles(df, ["unit"], {"a": (F.col("v"), 0.25), "b": (F.col("v"), 0.5), "c": (-F.col("v"), 0.5)})
    rows = lambda x: sorted(map(tuple, x.collect()))
    want = rows(total()), rows(middle())
    try:
        with monkeypatch.context() as m:
            m.setattr(sc, "cut", None)  # the plans that split groups write blocks
            spark.conf.set(TASK_BYTES_KEY, str(most * 64))
            assert (rows(total()), rows(middle())) == want
        spark.conf.set(TASK_BYTES_KEY, str((most - 1) * 64))
        with monkeypatch.context() as m:
            m.setattr(sc, "cut", None)
            for make in (total, middle):
                with pytest.raises(TypeError):
                    make()
        assert (rows(total()), rows(middle())) == want
    finally:
        spark.conf.set(TASK_BYTES_KEY, before)


def test_groups_that_grew_beyond_a_task_are_split(spark, monkeypatch, tmp_path):
    from wearline.session import TASK_BYTES_KEY

    before = spark.conf.get(TASK_BYTES_KEY)
    spark.range(50).write.parquet(f"{tmp_path}/few")
    size = sum(f.stat().st_size for f in (tmp_path / "few").glob("*.parquet"))
    grown = spark.read.parquet(f"{tmp_path}/few").select((F.col("id") % 2).alias("g"), F.explode(F.sequence(F.lit(1), F.lit(2000))).alias("v"))
    plans = []
    monkeypatch.setattr(sc, "running", lambda *a, _run=sc.running, **k: plans.append(1) or _run(*a, **k))
    try:
        spark.conf.set(TASK_BYTES_KEY, str(size * 2))  # the source fits one task, its 50,000 rows a group do not
        got = sc.percentiles(grown, ["g"], {"m": (F.col("v"), 0.5)}, grown=True).collect()
        assert plans and {r["m"] for r in got} == {1000.5}
    finally:
        spark.conf.set(TASK_BYTES_KEY, before)


def test_group_percentiles_on_every_row_need_no_join(spark, hot):
    df, _ = hot
    one = sc.with_percentiles(df, ["unit"], {"m": (F.col("v"), 0.5), "q": (F.col("v"), 0.25)}, split=False)
    two = sc.with_percentiles(df, ["unit"], {"m": (F.col("v"), 0.5), "q": (F.col("v"), 0.25)}, split=True)
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(one) and "Join" in plan(two)
    assert np.allclose(sorted(map(tuple, one.collect())), sorted(map(tuple, two.collect())))
    lost = spark.createDataFrame([(None, 1.0), (1, 2.0), (1, 4.0)], "unit bigint, v double")
    for split in (False, True):  # rows without a key drop out of both
        assert [tuple(r) for r in sc.with_percentiles(lost, ["unit"], {"m": (F.col("v"), 0.5)}, split).orderBy("v").collect()] == [(1, 2.0, 3.0), (1, 4.0, 3.0)]


def test_large_groups_count_only_values_near_a_percentile(spark, monkeypatch):
    rng = np.random.default_rng(5)
    groups = {
        1: rng.normal(size=4000).tolist(), 2: [7.0] * 50, 3: (10.0 ** rng.uniform(-9, 9, 3000)).tolist(), 4: [1.0, float("inf"), 2.0, 3.0], 5: [None, None], 6: [1.0, None, 2.0],
        None: rng.integers(0, 4, 900).astype(float).tolist(), 8: [float("nan"), 1.0, 2.0], 9: [-1.7e308, 0.5, 1.7e308],
    }
    df = spark.createDataFrame([(g, v) for g, values in groups.items() for v in values], "g bigint, v double").repartition(5)
    wanted = {f"p{i}": (F.col("v"), p) for i, p in enumerate((0.0, 0.25, 0.5, 0.9, 1.0))}
    rows = lambda **k: {r["g"]: tuple(r) for r in sc.percentiles(df, ["g"], wanted, **k).collect()}
    seen = []
    monkeypatch.setattr(sc, "running", lambda counts, *a, _run=sc.running, **k: seen.append(counts.count()) or _run(counts, *a, **k))
    want = rows(split=True)
    near = rows(split=True, grown=True)
    assert seen[1] < seen[0] / 2
    assert near.keys() == want.keys() == groups.keys()
    for g, row in near.items():
        assert repr(row) == repr(want[g])
    few = sc.percentiles(df.where("g IN (1, 3)"), ["g"], wanted, split=False).collect()
    assert all(tuple(r) == pytest.approx(near[r["g"]]) for r in few)


def test_ranks_of_a_well_packed_table_count_its_rows(spark):
    from wearline.session import TASK_BYTES_KEY, cut

    packed = cut(spark.range(2000).select(F.lit(0).alias("g"), (F.col("id") % 2).alias("v")))
    whole = spark.conf.get(TASK_BYTES_KEY)
    try:
        spark.conf.set(TASK_BYTES_KEY, str(64 * 100))  # the files have fewer bytes, the group more rows
        ranked = sc.average_ranks(packed, ["g"], "v", "r")
    finally:
        spark.conf.set(TASK_BYTES_KEY, whole)
    assert "rank(v" not in ranked._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in ranked.select("v", "r").collect()} == {(0, 500.5), (1, 1500.5)}
