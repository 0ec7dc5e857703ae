import itertools

import numpy as np
import pandas as pd
import pytest

from wearline.operators import folds as fo
from wearline.operators import trajectory as tr


def long(spark, series):
    rows = [(1 + i % 3, i, "f", k, len(v), float(x)) for i, v in series.items() for k, x in enumerate(v)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["condition_id", "unit_id", "feature", "sequence_index", "total_acquisitions", "value"]))


def test_unit_scores(spark):
    s = tr.unit_scores(long(spark, {0: range(10), 1: range(10, 0, -1), 2: [5] * 10, 3: [0, 2, 1, 3, 2, 4, 3, 5, 4, 6]})).toPandas().set_index("unit_id").sort_index()
    assert list(s["monotonicity"][:3]) == [1, 1, 0] and s["monotonicity"][3] < 1
    assert list(s["trend_sign"][:3]) == [1, -1, 0] and list(s["spearman"][:3]) == [1, -1, 0]
    assert s["fluctuation"][2] == 0 and s["tie_differences"][2] == 9


def test_resample_matches_interpolation(spark):
    rng = np.random.default_rng(0)
    series = {i: rng.normal(size=n) for i, n in enumerate((1, 2, 7, 40))}
    got = tr.resample(long(spark, series), 11).toPandas()
    for i, v in series.items():
        part = got[got.unit_id == i].sort_values("grid")["value"].to_numpy()
        assert np.allclose(part, np.interp(np.linspace(0, 1, 11), np.linspace(0, 1, len(v)) if len(v) > 1 else [0.0], v))


@pytest.mark.parametrize("block", [512, 3])
def test_trendability_counts_pairs_in_blocks(spark, block):
    rng = np.random.default_rng(1)
    series = {i: np.cumsum(rng.normal(size=20 + i)) for i in range(8)} | {8: np.ones(9)}
    grid = tr.resample(long(spark, series), 15)
    members = spark.createDataFrame([(i, "all") for i in series] + [(i, "few") for i in (0, 1, 2, 3, 4)], "unit_id long, scope string")
    got = {r["scope"]: r for r in tr.trendability(grid, members, block).collect()}
    v = {i: np.interp(np.linspace(0, 1, 15), np.linspace(0, 1, len(x)), x) for i, x in series.items()}
    for scope, units in (("all", range(8)), ("few", range(5))):
        pairs = [abs(np.corrcoef(v[a], v[b])[0, 1]) for a, b in itertools.combinations(units, 2)]
        assert got[scope]["trendability_valid_pairs"] == len(pairs)
        assert got[scope]["trendability"] == pytest.approx(np.median(pairs), abs=1e-9)


@pytest.mark.parametrize("most", [2, 8192])
def test_blocks_of_units_share_their_scopes(spark, most):
    rng = np.random.default_rng(2)
    series = {i: np.cumsum(rng.normal(size=30)) for i in range(12)}
    grid = tr.resample(long(spark, series), 15)
    scopes = {"all": range(12), "even": range(0, 12, 2), "third": range(0, 12, 3)}
    members = spark.createDataFrame([(i, s) for s, units in scopes.items() for i in units], "unit_id long, scope string")
    blocks = tr.unit_blocks(members, most).toPandas()
    assert blocks.groupby("block")["scopes"].agg(lambda x: len(set(map(tuple, x)))).eq(1).all()
    assert blocks["block"].nunique() == (6 if most == 2 else 4) and blocks["unit_id"].is_unique
    got = {r["scope"]: r for r in tr.trendability(grid, members, 3, most).collect()}
    v = {i: np.interp(np.linspace(0, 1, 15), np.linspace(0, 1, len(x)), x) for i, x in series.items()}
    for scope, units in scopes.items():
        pairs = [abs(np.corrcoef(v[a], v[b])[0, 1]) for a, b in itertools.combinations(units, 2)]
        assert got[scope]["trendability_valid_pairs"] == len(pairs)
        assert got[scope]["trendability"] == pytest.approx(np.median(pairs), abs=1e-9)


def test_constant_endpoints_and_ranking_ties(spark):
    rows = long(spark, {0: [2] * 10, 1: [2] * 12})
    members = spark.createDataFrame([(0, "all"), (1, "all")], "unit_id long, scope string")
    assert tr.prognosability(tr.endpoint_medians(rows), members).first()["prognosability"] == 1
    scores = spark.createDataFrame([("all", n, 0.5, 0.5, 0.5, 0.5, 0.5) for n in "cab"], "scope string, feature string, monotonicity double, trendability double, prognosability double, spearman_abs double, stability double")
    ranked = tr.rank_features(scores, dict.fromkeys(tr.METRICS, 1.0), 2).orderBy("rank").collect()
    assert [r["feature"] for r in ranked] == ["a", "b", "c"] and [r["selected"] for r in ranked] == [True, True, False]


def test_folds_split_units_completely(spark):
    units = spark.createDataFrame([(c, 10 * c + u) for c in (1, 2, 3) for u in range(5) for _ in range(4)], "condition_id long, unit_id long")
    plan = fo.rotate_folds(units, 5)
    assert fo.fold_issues(plan).count() == 0
    assert plan.groupBy("fold", "subset").count().where("subset = 'train'").first()["count"] == 9
    broken = plan.where("NOT (unit_id = 10 AND subset = 'test')")
    assert {r["code"] for r in fo.fold_issues(broken).where("path = '1/10'").collect()} == {"not_tested_once"}


def test_no_vector_is_sent_per_pair_of_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    series = {i: np.cumsum(rng.normal(size=30)) for i in range(9)}
    grid = tr.resample(long(spark, series), 15)
    members = spark.createDataFrame([(i, "all") for i in series], "unit_id long, scope string")
    frame, sent = type(grid), []
    mapped = frame.mapInPandas
    monkeypatch.setattr(frame, "mapInPandas", lambda self, *a, **k: sent.append((self.columns, self.count())) or mapped(self, *a, **k))
    got = tr.trendability(grid, members, 3, 2).first()
    assert got["trendability_valid_pairs"] == 36
    assert sent == [(["feature", "low", "high"], 15)] * 3  # five blocks, one row per pair and pass
