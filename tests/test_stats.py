import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wearline.operators import stats as st


def table(spark, deltas):
    return spark.createDataFrame([(1, i, 1, float(d)) for i, d in enumerate(deltas)], "g int, unit_id int, condition_id int, delta_mae double")


def test_exact_wilcoxon_and_sign(spark):
    d = [1.5, -2.25, 3.0, 4.5, 5.25, -0.5, 7.0]
    row = st.wilcoxon(table(spark, d), ["g"]).first()
    ranks = pd.Series(np.abs(d)).rank().to_numpy()
    neg = ranks[np.array(d) < 0].sum()
    pos = ranks.sum() - neg
    sums = [sum(r for r, s in zip(range(1, 8), signs) if s) for signs in itertools.product([0, 1], repeat=7)]
    assert row["wilcoxon_statistic"] == min(neg, pos)
    assert row["wilcoxon_p_raw"] == pytest.approx(min(1, 2 * np.mean([s <= min(neg, pos) for s in sums])))
    assert row["rank_biserial_effect"] == pytest.approx((pos - neg) / (pos + neg))
    for split in (False, True):
        sign = st.sign_test(table(spark, d), ["g"], split=split).first()
        assert sign["sign_test_p_raw"] == pytest.approx(2 * sum(math.comb(7, k) for k in range(3)) / 2**7)


def test_ties_use_the_normal_approximation(spark):
    row = st.wilcoxon(table(spark, [1, 1, -1, 2, 0]), ["g"]).first()
    var = 4 * 5 * 9 / 24 - (27 - 3) / 48
    z = (row["wilcoxon_statistic"] - 5) / math.sqrt(var)
    assert row["zero_differences"] == 1 and row["wilcoxon_p_raw"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_holm(spark):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.01, 0.04, 0.2])], "family string, id int, p double")
    for split in (False, True):
        got = [r["holm_p_adjusted"] for r in st.holm(df, ["family"], "p", "id", split=split).orderBy("id").collect()]
        assert got == pytest.approx([0.03, 0.08, 0.2])


def test_bootstrap_is_repeatable_and_brackets_the_mean(spark):
    t = table(spark, np.arange(-7, 8))
    a, b = (st.bootstrap_difference(t, 200, seed=1).first().asDict() for _ in range(2))
    assert a == b and a["mean_ci_lower"] < 0 < a["mean_ci_upper"] and a["effective_replicates"] == 200
    draws = st.resample_units(t, ["condition_id"], 50, 1).groupBy("replicate").count().collect()
    assert len(draws) == 50 and all(r["count"] == 15 for r in draws)


@pytest.mark.parametrize("split", [False, True])
def test_pareto_against_brute_force(spark, split):
    rng = np.random.default_rng(2)
    pts = rng.integers(0, 12, (60, 2)).tolist()
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id int, x double, y double")
    got = {r["id"]: r["pareto"] for r in st.pareto_front(df, "x", "y", split).collect()}
    for i, (x, y) in enumerate(pts):
        assert got[i] == (not any(a <= x and b <= y and (a < x or b < y) for a, b in pts))


def test_support(spark):
    rows = [(m, 0, 1, u, k, 1.0, 2.0) for m in ("a", "b", "c") for u in range(15) for k in range(3) if not (m == "b" and k == 0)]
    df = spark.createDataFrame(rows, "experiment string, fold int, condition_id int, unit_id int, acquisition_number int, rul_minutes double, prediction_non_negative_minutes double")
    data = st.harmonise([df], ["a", "b"])
    assert data.where("experiment = 'a'").count() == 45 and st.strict_support(data, ["a", "b"]).where("experiment = 'a'").count() == 30
    assert st.harmony_issues(data).count() == 0
    codes = {r["code"] for r in st.harmony_issues(data.unionByName(data.limit(1).withColumn("rul_minutes", F.lit(9.0)))).collect()}
    assert codes == {"duplicate_key", "truth_mismatch"}


def test_bootstrap_emits_no_row_per_draw_and_equals_the_joined_draws(spark, monkeypatch):
    rows = [(f, c, u, e, float(u * 7 % 5) + (e == "b") * (u % 3) - 1.5, None if u == 4 and e == "a" else float(u % 4)) for f, c, u in [(0, 1, 1), (1, 1, 1), (0, 1, 2), (0, 2, 4), (0, 2, 5), (0, 2, 6), (0, 2, None)] for e in "ab" if u is not None]
    units = spark.createDataFrame(rows + [(0, 2, None, "a", 1.0, 1.0)], "fold int, condition_id long, unit_id long, experiment string, mae double, rmse double")
    table = units.where("experiment = 'a'").withColumn("delta_mae", F.col("rmse") - 1.5)

    def both(make):
        whole = sorted(map(tuple, make(True).collect()))
        with monkeypatch.context() as m:  # the packed plan asks for no draws
            m.setattr(st, "resample_units", None)
            packed = sorted(map(tuple, make(False).collect()))
        assert len(whole) == len(packed)
        for a, b in zip(whole, packed):
            assert a == pytest.approx(b)

    both(lambda split: st.bootstrap_difference(table, 150, split=split))
    both(lambda split: st.bootstrap_ranks(units, 150, split=split))
    both(lambda split: st.bootstrap_metrics(units, ["mae", "rmse"], 150, split=split))
