import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.operators import cox
from wearline.operators import survival as su


def sample(seed, n=160, p=4, ties=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, p))
    t = np.ceil(rng.exponential(1, n) * np.exp(-x @ np.linspace(0.8, -0.5, p)) * ties)
    e = (rng.random(n) < 0.7).astype(int)
    t = np.minimum(t, np.quantile(t, 0.7))  # a third of all rows share the last time
    e[t == t.max()] = 0
    return t, e, x


def reference(t, e, x, alpha, steps=60):
    """Newton steps over explicit risk sets."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        w = np.exp(x @ beta)
        gradient, hessian = -alpha * beta, alpha * np.eye(len(beta))
        for i in np.flatnonzero(e):
            risk = t >= t[i]
            mean = w[risk] @ x[risk] / w[risk].sum()
            gradient = gradient + x[i] - mean
            hessian = hessian + (x[risk] * w[risk][:, None]).T @ x[risk] / w[risk].sum() - np.outer(mean, mean)
        move = np.linalg.solve(hessian, gradient)
        beta = beta + move
        if np.abs(move).max() < 1e-11:
            break
    return beta


def hazard(t, e, x, beta, at):
    w = np.exp(x @ beta)
    return sum(1 / w[t >= t[i]].sum() for i in np.flatnonzero(e) if t[i] <= at)


@pytest.mark.parametrize("block_rows", [7, 50_000])
def test_many_fits_match_explicit_risk_sets(spark, block_rows):
    data = {("a", 0): sample(1), ("a", 1): sample(2, n=90), (None, 1): sample(3, n=60)}
    rows = [(s, f, float(t), int(e), x.tolist()) for (s, f), d in data.items() for t, e, x in zip(*d)]
    frame = spark.createDataFrame(rows, "scenario string, fold int, duration_minutes double, event_observed int, x array<double>").repartition(6)
    blocks = cox.packed(frame, ["scenario", "fold"], block_rows=block_rows)
    assert blocks.agg(F.sum("rows")).first()[0] == len(rows) and (block_rows > 100 or blocks.count() > 20)
    specs = [cox.Spec(scope, i, columns, alpha) for scope in data for i, (columns, alpha) in enumerate([((0, 1, 2, 3), 0.1), ((1, 3), 1.0), ((2,), 10.0)])]
    grids = {scope: np.quantile(d[0], [0.1, 0.3, 0.6]) for scope, d in data.items()}
    fits = cox.fit_many(blocks, ["scenario", "fold"], specs)
    base = cox.hazards(blocks, ["scenario", "fold"], fits, grids)
    for fit, h in zip(fits, base, strict=True):
        t, e, x = data[fit.spec.scope]
        own = x[:, fit.spec.columns]
        assert fit.failure is None
        want = reference(t, e, own, fit.spec.alpha)
        assert np.allclose(fit.beta, want, atol=1e-7)
        assert np.allclose(h, [hazard(t, e, own, want, g) for g in grids[fit.spec.scope]], rtol=1e-6)
    out = cox.curves(frame.limit(20).withColumn("landmark_id", F.monotonically_increasing_id()), ["scenario", "fold"], fits, base, grids).collect()
    assert len(out) == 20 * 3 * 3 and all(0 < r.survival <= 1 for r in out)


def test_the_single_fit_is_one_of_many(spark):
    t, e, x = sample(5)
    frame = spark.createDataFrame([(0, float(a), int(b), float(c[0]), float(c[1])) for a, b, c in zip(t, e, x)], "fold int, duration_minutes double, event_observed int, u double, v double")
    got = {r.feature: r.standardized_coefficient for r in su.fit_cox(frame, ["u", "v"], 1.0).collect()}
    assert np.allclose([got["u"], got["v"]], reference(t, e, x[:, :2], 1.0), atol=1e-7)


def test_failures_are_named(spark):
    frame = spark.createDataFrame([(0, 1.0, 1, [1.0, 1.0]), (0, 2.0, 1, [2.0, 2.0]), (0, 3.0, 0, [0.5, 0.5])], "fold int, duration_minutes double, event_observed int, x array<double>")
    blocks = cox.packed(frame, ["fold"])
    fits = cox.fit_many(blocks, ["fold"], [cox.Spec((0,), 1, (0, 1), 0.0), cox.Spec((3,), 2, (0,), 1.0), cox.Spec((0,), 3, (0,), 1.0)], steps=30)
    assert fits[0].failure is not None and fits[1].failure == "no rows to fit" and fits[2].failure is None
    with pytest.raises(ValueError, match="did not converge"):
        su.fit_cox(frame.select("fold", "duration_minutes", "event_observed", F.get("x", F.lit(0)).alias("u")), ["u"], 1.0, steps=1)


def test_metrics_of_curve_arrays_equal_those_of_a_row_per_grid_time(spark):
    draw = np.random.default_rng(11)
    rows = [(s, "train", None, f"t{i}", float(draw.integers(1, 40)), int(draw.random() < 0.7)) for s in ("a", "b") for i in range(60)]
    rows += [(s, "test", i % 6 or None, f"u{i}", float(draw.integers(1, 45)), int(draw.random() < 0.6)) for s in ("a", "b") for i in range(70)]
    rows += [("a", "test", 7, "single", 12.0, 1), ("b", "test", 8, "long", 90.0, 1), ("b", "test", 8, "early", 3.0, 1)]
    table = spark.createDataFrame(rows, "scenario string, subset string, unit_id int, landmark_id string, duration_minutes double, event_observed int")
    train, test = table.where("subset = 'train'"), table.where("subset = 'test'")
    grid = spark.createDataFrame([(s, i, 4.0 + step * i) for s, n, step in (("a", 9, 3.0), ("b", 6, 4.5)) for i in range(n)], "scenario string, grid_index int, evaluation_time double")
    lines = test.join(grid, "scenario").withColumn("survival", F.exp(-F.col("evaluation_time") / (5 + F.abs(F.hash("landmark_id")) % 9 * 4)))
    keys = ["scenario", "unit_id", "landmark_id", "duration_minutes", "event_observed"]
    arrays = lines.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("grid_index", "survival"))), lambda p: p["survival"]).alias("survival"))
    horizons = spark.createDataFrame([("a", 11.0), ("b", 1.0)], "scenario string, main_horizon double")
    scope, by = ["scenario"], ["scenario", "unit_id"]
    want = {tuple(r[k] for k in by): r.asDict() for r in su.unit_metrics(train, lines, grid, scope, by).collect()}
    got = {tuple(r[k] for k in by): r.asDict() for r in su.array_unit_metrics(train, arrays, grid, scope, by, horizons).collect()}
    assert got.keys() == want.keys() and {r["valid"] for r in want.values()} == {True, False} and len({r["failure_reason"] for r in want.values()}) > 2
    for key, row in want.items():
        for name, value in row.items():
            assert got[key][name] == (pytest.approx(value, abs=1e-9) if isinstance(value, float) else value), (key, name)
    scores = {}
    for r in su.supported_scores(train, lines, grid, scope, by).join(horizons, "scenario").collect():
        scores.setdefault((r["scenario"], r["unit_id"]), []).append((abs(r["evaluation_time"] - r["main_horizon"]), r["evaluation_time"], r["brier_score"]))
    assert scores and all(got[k]["_near"] == pytest.approx(min(v)[2]) for k, v in scores.items())
    plan = su.array_unit_metrics(train, arrays, grid, scope, by)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
