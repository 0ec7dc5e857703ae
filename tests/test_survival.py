import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wearline.operators import survival as su
from wearline.session import TASK_BYTES_KEY


def cohort(spark, n=90, seed=4):
    rng = np.random.default_rng(seed)
    x, z = rng.normal(size=n), rng.normal(size=n)
    time = np.ceil(rng.exponential(20 * np.exp(-0.7 * x)) + 1)
    pdf = pd.DataFrame({"fold": 0, "unit_id": np.arange(n) % 6, "landmark_id": [f"l{i}" for i in range(n)], "duration_minutes": time, "event_observed": (rng.random(n) < 0.7).astype(int), "x": x, "z": z, "landmark_weight": 1.0})
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("split", [False, True])
def test_concordance_against_all_pairs(spark, split):
    df, pdf = cohort(spark)
    pdf["risk"] = np.round(pdf.x, 1)
    rows = df.withColumns({"risk": F.round("x", 1), "w": F.col("unit_id") + 1.0})
    got = su.concordance(rows, ["fold"], "duration_minutes", "event_observed", "risk", "w", split).first()
    con = tie = every = 0.0
    for a in pdf.itertuples():
        for b in pdf.itertuples():
            if a.event_observed and (a.duration_minutes < b.duration_minutes or (a.duration_minutes == b.duration_minutes and not b.event_observed)):
                w = a.unit_id + 1.0
                every += w
                con += w * (a.risk > b.risk)
                tie += w * (a.risk == b.risk)
    assert (got["concordant"], got["tied_risk"], got["comparable"]) == pytest.approx((con, tie, every))


def test_cox_maximises_the_penalised_likelihood(spark):
    df, pdf = cohort(spark)
    beta = {r["feature"]: r["standardized_coefficient"] for r in su.fit_cox(df, ["x", "z"], 1.0).collect()}
    b = np.array([beta["x"], beta["z"]])
    design = pdf[["x", "z"]].to_numpy()

    def value(w):
        eta = design @ w
        ll = sum(eta[i] - np.log(np.exp(eta[pdf.duration_minutes >= pdf.duration_minutes[i]]).sum()) for i in range(len(pdf)) if pdf.event_observed[i])
        return ll - 0.5 * w @ w

    assert all(value(b) >= value(b + d) for d in np.vstack([np.eye(2), -np.eye(2)]) * 1e-3) and beta["x"] > 0.3


def test_cox_does_not_depend_on_a_covariate_s_origin(spark):
    df, _ = cohort(spark)
    here, there = (
        {r["feature"]: r["standardized_coefficient"] for r in su.fit_cox(df.withColumn("x", F.col("x") * 30 + shift), ["x", "z"], 1.0).collect()} for shift in (0.0, 5000.0)
    )
    assert here == pytest.approx(there, rel=1e-6)


def test_cox_curves_fall_within_bounds(spark):
    df, _ = cohort(spark)
    beta = su.fit_cox(df, ["x", "z"], 1.0)
    grid = su.evaluation_grid(df, ["fold"], 7)
    curves = su.cox_curves(df, beta, su.baseline_hazard(df, beta, ["x", "z"]), grid, ["x", "z"])
    assert su.curve_issues(curves, ["landmark_id"]).count() == 0
    forest = su.hazard_forest(df, df, grid, ["x", "z"], {"numTrees": 3, "maxDepth": 3})
    assert su.curve_issues(forest, ["landmark_id"]).count() == 0 and forest.count() == 90 * 7


def test_kaplan_meier_by_hand(spark):
    df = spark.createDataFrame([(0, t, e) for t, e in ((1.0, 1), (2.0, 0), (2.0, 1), (3.0, 1))], "fold int, duration_minutes double, event_observed int")
    for split in (False, True):
        curve = su.kaplan_meier(df, ["fold"], split=split).orderBy("time").collect()
        assert [r["survival"] for r in curve] == pytest.approx([0.75, 0.5, 0.0])
        g = su.censoring_curve(df, ["fold"], split=split).orderBy("time").collect()
        assert [r["survival"] for r in g] == pytest.approx([1.0, 0.5, 0.5])
        points = spark.createDataFrame([(0, 0.5), (0, 2.0), (0, 9.0)], "fold int, t double")
        found = su.step_lookup(su.kaplan_meier(df, ["fold"]), points, ["fold"], "t", split=split).orderBy("t").collect()
        assert [r["survival"] for r in found] == pytest.approx([1.0, 0.5, 0.0])


def test_median_and_horizon(spark):
    curves = spark.createDataFrame([("a", i, float(t), s) for i, (t, s) in enumerate(((1, 0.9), (2, 0.5), (3, 0.2)))] + [("b", i, float(i + 1), 0.9) for i in range(3)], "landmark_id string, grid_index int, evaluation_time double, survival double")
    assert {r[0]: r[1] for r in su.median_survival(curves, ["landmark_id"]).collect()} == {"a": 2.0, "b": None}
    got = {(r["landmark_id"], r["horizon_minutes"]): r["survival_probability"] for r in su.horizon_survival(curves, ["landmark_id"], (1.0, 1.5, 3.0, 9.0)).collect()}
    assert got[("a", 1.0)] == 0.9 and got[("a", 1.5)] == pytest.approx(0.7) and got[("a", 3.0)] == 0.2 and got[("a", 9.0)] is None


def test_censoring_of_cohorts(spark):
    marks = spark.createDataFrame([(0, "train", i, float(t), t / 1.0) for i, t in enumerate((10, 100, 20, 200, 30, 300))], "fold int, subset string, unit_id int, true_time_to_failure_minutes double, rul_minutes double")
    rows = su.fixed_horizon(marks, (60.0,)).orderBy("unit_id").collect()
    assert [r["duration_minutes"] for r in rows] == [10, 60, 20, 60, 30, 60] and [r["event_observed"] for r in rows] == [1, 0, 1, 0, 1, 0]
    assert su.rate_horizons(marks, (0.5,)).first()["administrative_horizon_minutes"] == pytest.approx(65.0)


def odd_pairs(spark):
    """Groups of several sizes with NULL keys, times, events, risks and weights, NaN risks and times, and many ties."""
    draw = np.random.default_rng(5)
    pick = lambda values: values[draw.integers(len(values))]
    rows = [
        (pick(["a", "b", "c", None]), pick([1, 2, 2, 2]), pick([1.0, 2.0, 3.0, 4.0, float("nan"), None]), pick([0, 1, 1, None]), pick([0.5, -0.5, 0.0, -0.0, 1e9, float("nan"), None]), pick([1.0, 0.25, None]))
        for _ in range(300)
    ]
    return spark.createDataFrame(rows, "g string, h int, t double, e int, x double, w double")


def test_concordance_in_tasks_equals_a_row_per_digit(spark, monkeypatch):
    rows = odd_pairs(spark)
    names = ["g", "h", "concordant", "tied_risk", "comparable", "concordance"]
    found = {}
    for mark, split, most in (("digits", True, 200_000), ("tasks", False, 200_000), ("small tasks", False, 7)):
        monkeypatch.setattr(su, "COUNTED_ROWS", most)
        got = su.concordance(rows.repartition(3), ["g", "h"], "t", "e", "x", "w", split).select(*names).collect()
        found[mark] = sorted((tuple(r) for r in got), key=lambda r: (str(r[0]), r[1]))
    for mark in ("tasks", "small tasks"):
        assert [r[:2] for r in found[mark]] == [r[:2] for r in found["digits"]]
        for a, b in zip(found[mark], found["digits"], strict=True):
            assert a[2:5] == pytest.approx(b[2:5]) and (a[5] is None) == (b[5] is None) and (a[5] is None or a[5] == pytest.approx(b[5]))


def test_concordance_of_groups_that_fit_makes_no_row_per_digit(spark):
    counted = su.concordance(odd_pairs(spark), ["g", "h"], "t", "e", "x", "w", False)
    assert "Generate" not in counted._jdf.queryExecution().optimizedPlan().toString()


def test_brier_reads_censoring_values_off_a_small_table(spark, tmp_path):
    draw = np.random.default_rng(6)
    rows = [("train", u, float(draw.integers(1, 30)), int(draw.random() < 0.7)) for u in range(80)] + [("test", u, float(draw.integers(1, 30)), int(draw.random() < 0.7)) for u in range(40)]
    table = spark.createDataFrame(rows, "subset string, landmark_id int, duration_minutes double, event_observed int").selectExpr("'f' AS fold", "landmark_id % 4 AS unit_id", "*")
    train, test = table.where("subset = 'train'"), table.where("subset = 'test'")
    grid = spark.range(6).selectExpr("'f' AS fold", "int(id) AS grid_index", "4.0D + 3 * id AS evaluation_time")
    lines = test.join(grid, "fold").withColumn("survival", F.exp(-F.col("evaluation_time") / (10 + F.col("landmark_id") % 7)))
    lines.write.parquet(f"{tmp_path}/lines")
    lines = spark.read.parquet(f"{tmp_path}/lines")
    support = su.supported_grid(train, test, grid, ["fold"], ["fold", "unit_id"])
    plain = su.brier(train, lines, support, ["fold"], ["fold", "unit_id"])
    before = spark.conf.get(TASK_BYTES_KEY)
    try:
        spark.conf.set(TASK_BYTES_KEY, "1024")
        looked = su.brier(train, lines, support, ["fold"], ["fold", "unit_id"])
        plan = looked._jdf.queryExecution().optimizedPlan().toString()
        got = {tuple(r)[:3]: r["brier_score"] for r in looked.collect()}
    finally:
        spark.conf.set(TASK_BYTES_KEY, before)
    assert plan.count("strategy=broadcast") == 2  # own times and evaluation times
    want = {tuple(r)[:3]: r["brier_score"] for r in plain.collect()}
    assert got.keys() == want.keys() and len(got) > 10 and all(got[k] == pytest.approx(want[k]) for k in want)


def test_forest_rows_are_dealt_to_tasks_by_their_work(spark, monkeypatch):
    df, _ = cohort(spark)
    grid = su.evaluation_grid(df, ["fold"], 7)
    fit, seen = su.RandomForestClassifier.fit, []
    monkeypatch.setattr(su.RandomForestClassifier, "fit", lambda self, rows: seen.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    monkeypatch.setattr(su, "PERIOD_ROWS", 100, raising=False)
    forest = su.hazard_forest(df, df, grid, ["x", "z"], {"numTrees": 3, "maxDepth": 3})
    assert seen == [7]  # 90 landmarks at 7 times
    assert su.curve_issues(forest, ["landmark_id"]).count() == 0 and forest.count() == 90 * 7
