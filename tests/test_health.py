import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wearline.operators import health as he

BASE = {"penalty": 5.0, "minimum_segment_size": 5, "jump": 1, "persistence_window": 5, "minimum_effect_size": 1.0, "cost_model": "l2"}


def onset(spark, signal, baseline=10, **changes):
    n = len(signal)
    pdf = pd.DataFrame({"condition_id": 1, "unit_id": 7, "sequence_index": np.arange(n), "total_acquisitions": n, "baseline_acquisitions": baseline, "elapsed_minutes": np.arange(n, dtype=float), "rul_minutes": np.arange(n - 1, -1, -1, dtype=float), "x": np.asarray(signal, float)})
    rows = spark.createDataFrame(pdf.assign(**(BASE | changes)))
    smooth = he.smoothed(rows, ["unit_id"], "x", 3)
    keys = ["condition_id", "unit_id"]
    setting = BASE | changes
    found = he.change_points(smooth, keys, [(setting["cost_model"], setting["penalty"], setting["minimum_segment_size"])], jump=setting["jump"])
    return he.onsets(smooth, found, keys).first()


@pytest.mark.parametrize("model", ["l2", "rbf"])
def test_step_is_found(spark, model):
    row = onset(spark, [0] * 30 + [4] * 30, cost_model=model)
    assert row["onset_status"] == "detected" and 25 <= row["onset_index"] <= 35 and row["rul_at_onset"] == 59 - row["onset_index"]


def test_no_onset_without_a_persistent_shift(spark):
    flat = onset(spark, [0] * 60)
    assert flat["onset_status"] == "not_detected" and flat["rejection_reasons"] == "no_internal_breakpoint"
    assert onset(spark, [0] * 30 + [20] + [0] * 29)["onset_status"] == "not_detected"
    assert onset(spark, [0] * 20 + [2] * 20 + [5] * 20)["onset_index"] <= 25
    early = onset(spark, [0] * 5 + [4] * 55)
    assert early["onset_status"] == "not_detected"
    assert onset(spark, [0] * 8)["rejection_reasons"] == "trajectory_too_short"


@pytest.mark.parametrize("jump", [1, 3])
def test_segmenter_reaches_the_optimum(jump):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 1, n) for m, n in ((0, 23), (5, 17), (1, 31), (6, 12))])
    n, least, penalty = len(x), 4, 6.0
    machine = he._Segmenter(penalty, least, jump)
    for k in range(0, n, jump):
        part = x[k : k + jump]
        machine.feed(len(part), float(part.sum()), float((part * part).sum()))
    ends = [e for e in range(0, n, jump)] + [n]
    best = {0: (0.0, [])}
    for e in ends[1:]:
        options = [(best[t][0] + float(((x[t:e] - x[t:e].mean()) ** 2).sum()) + penalty, [*best[t][1], e]) for t in ends if t in best and e - t >= least]
        if options:
            best[e] = min(options, key=lambda o: o[0])
    assert machine.boundaries() == best[n][1][:-1]


def test_parameter_grid_ids(spark):
    grid = he.parameter_grid(spark).orderBy("parameter_id").collect()
    assert len(grid) == 96 and [r["parameter_id"] for r in grid] == list(range(96)) and grid[0]["cost_model"] == "rbf"
    out = he.with_parameters(spark.range(2), he.parameter_grid(spark))
    assert out.count() == 192


def long_series(n=3000):
    rng = np.random.default_rng(8)
    parts = [rng.normal(m, s, k) for m, s, k in ((0, 1, 700), (3, 1, 300), (3, 4, 500), (-2, 0.3, 400), (5, 2, 1100))]
    return np.round(np.concatenate(parts)[:n], 3)


def kernel_reference(x, penalty, least, jump):
    """Penalised optimal partitioning with pruning over the whole kernel matrix."""
    n = len(x)
    gaps = (x[:, None] - x[None, :]) ** 2
    kernel = np.exp(-np.clip(gaps / np.median(gaps[np.triu_indices(n, 1)]), 1e-2, 1e2))
    np.fill_diagonal(kernel, 1.0)
    area = np.zeros((n + 1, n + 1))
    area[1:, 1:] = kernel.cumsum(axis=0).cumsum(axis=1)
    best, live = {0: (0.0, [])}, []
    for end in [e for e in range(0, n, jump) if e >= least] + [n]:
        start = (end - least) // jump * jump
        if start in best and start not in live:
            live.append(start)
        if not live:
            continue
        values = [best[t][0] + (end - t) - (area[end, end] - area[t, end] - area[end, t] + area[t, t]) / (end - t) + penalty for t in live]
        top = int(np.argmin(values))
        best[end] = (values[top], [*best[live[top]][1], end])
        live = [t for t, v in zip(live, values) if v <= values[top] + penalty]
    return best[n][1][:-1]


def test_both_kernel_plans_reach_the_whole_matrix(spark):
    x = long_series()
    settings = [("rbf", 1.0, 5), ("rbf", 5.0, 10), ("l2", 40.0, 10), ("rbf", 8.0, 5)]
    frames = [("long", x), ("short", x[:400]), (None, x[650:1400])]
    pdf = pd.concat([pd.DataFrame({"unit_id": u, "sequence_index": np.arange(len(v)), "smoothed": v}) for u, v in frames])
    rows = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "unit_id string, sequence_index bigint, smoothed double").repartition(5)
    want = {(u, p, m): kernel_reference(v, p, m, 5) for u, v in frames for c, p, m in settings if c == "rbf"}
    for cells in (128, 1000):  # tiles for the two longer series; one block for each
        got = he.change_points(rows, ["unit_id"], settings, tile_cells=cells).collect()
        found = {k: sorted(r.boundary for r in got if (r.unit_id, r.penalty, r.minimum_segment_size) == k and r.cost_model == "rbf") for k in want}
        assert found == want
        assert {r.cost_model for r in got} == {"l2", "rbf"}


def test_median_gap_by_digits(spark):
    rng = np.random.default_rng(3)
    for x in (np.round(rng.normal(0, 2, 301), 2), np.zeros(40), rng.normal(0, 1e-9, 64)):
        parts = [x[i : i + 50] for i in range(0, len(x), 50)]
        rows = [("u", j, i, len(b), len(a), a.tolist(), b.tolist()) for j, b in enumerate(parts) for i, a in enumerate(parts[: j + 1])]
        tiles = spark.createDataFrame(rows, "unit_id string, later bigint, earlier bigint, rows bigint, rows_before bigint, a array<double>, b array<double>")
        gaps = ((x[:, None] - x[None, :]) ** 2)[np.triu_indices(len(x), 1)]
        assert he._median_gaps(tiles, ["unit_id"]).first()["middle"] == np.median(gaps)


def test_yeo_johnson_repeats_no_row_per_candidate(spark, monkeypatch):
    from wearline.operators import scaling as sc

    rng = np.random.default_rng(3)
    values = {"skewed": np.exp(rng.normal(size=500)), "signed": rng.normal(size=400), "big": 100 + 50 * rng.uniform(size=300), "same": np.ones(20), "none": [None] * 3}
    rows = [(f, None if v is None else float(v)) for f, list_ in values.items() for v in list_] + [("signed", None), (None, 1.0)]
    long = spark.createDataFrame(rows, "feature string, value double").repartition(6)
    best = sc.yeo_johnson_lambdas(long)
    assert "Explode" not in best._jdf.queryExecution().optimizedPlan().toString()
    got = {r["feature"]: (r["lambda"], r["log_likelihood"]) for r in best.collect()}
    assert got.keys() == {"skewed", "signed", "big"}  # without spread there is no fit
    for feature, (lam, likelihood) in got.items():
        x = np.array([v for v in values[feature]], dtype=float)
        n = len(x) + (feature == "signed")

        def fit(at):
            moved = spark.createDataFrame([(float(v),) for v in x], "v double").select(sc.yeo_johnson(F.col("v"), F.lit(float(at))).alias("m")).agg(F.var_pop("m")).first()[0]
            return -n / 2 * np.log(moved) + (at - 1) * np.sum(np.sign(x) * np.log1p(np.abs(x)))

        assert likelihood == pytest.approx(fit(lam), rel=1e-6)
        assert all(fit(lam) >= fit(lam + d) - 1e-6 * abs(likelihood) for d in (-0.05, 0.05))


def test_stability_takes_no_join(spark):
    rows = [(0, 1, 1, p, "detected" if p % 3 else "not_detected", float(p), p / 40) for p in range(12)] + [(0, 1, 2, p, "not_detected", None, None) for p in range(4)]
    df = spark.createDataFrame(rows, "fold int, condition_id bigint, unit_id bigint, parameter_id bigint, onset_status string, onset_elapsed_minutes double, life_fraction_at_onset double")
    keys = ["fold", "condition_id", "unit_id"]
    one, two = (he.stability(df, keys, minutes=3.0, split=s) for s in (False, True))
    assert "Join" not in one._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
    at = np.array([p for p in range(12) if p % 3], dtype=float)
    row = one.where("unit_id = 1").first()
    assert (row["median_onset_minutes"], row["detection_proportion"]) == (np.median(at), pytest.approx(8 / 12))
    assert row["onset_iqr_minutes"] == pytest.approx(np.subtract(*np.quantile(at, [0.75, 0.25])))
    assert row["agreement_within_minutes"] == pytest.approx(np.mean(np.abs(at - np.median(at)) <= 3.0))


def test_windows_of_boundaries_come_from_packed_stretches(spark, monkeypatch):
    """Medians on both sides equal those over single rows, also where a window spans stretches, values are NULL or NaN, and a series has no key."""
    monkeypatch.setattr(he, "STRETCH", 8, raising=False)
    draw = np.random.default_rng(3)
    odd = lambda: [None, float("nan"), 1.0, 1.0][draw.integers(4)] if draw.random() < 0.2 else float(draw.normal())
    data = {u: [odd() for _ in range(n)] for u, n in ((1, 37), (2, 9), (3, 64), (None, 20))}
    rows = spark.createDataFrame([(u, i, v, float(i), float(-i)) for u, x in data.items() for i, v in enumerate(x)], "unit_id int, sequence_index bigint, smoothed double, elapsed_minutes double, rul_minutes double")
    spots = [(u, c, p) for u, x in data.items() for c in range(0, len(x) + 30, 5) for p in (3, 5)]
    frame = spark.createDataFrame(spots, "unit_id int, boundary bigint, persistence_window int")
    packed = he._sides(rows, frame, ["unit_id"], "smoothed", 5)
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "percentile" not in plan
    got = {(r["unit_id"], r["boundary"], r["persistence_window"]): r for r in packed.collect()}
    offsets = frame.select("*", F.explode(F.sequence(-F.col("persistence_window"), F.col("persistence_window") - 1)).alias("_at")).withColumn("sequence_index", F.col("boundary") + F.col("_at"))
    single = offsets.join(rows, ["unit_id", "sequence_index"]).groupBy("unit_id", "boundary", "persistence_window").agg(
        F.percentile(F.when(F.col("_at") < 0, F.col("smoothed")), F.lit(0.5)).alias("pre"), F.percentile(F.when(F.col("_at") >= 0, F.col("smoothed")), F.lit(0.5)).alias("post"),
        F.sort_array(F.collect_list(F.when(F.col("_at") >= 0, F.col("smoothed")))).alias("later"), F.max(F.when(F.col("_at") == 0, F.col("elapsed_minutes"))).alias("elapsed"),
    ).collect()
    assert len(single) == len(got) > 30
    for r in single:
        found = got[r["unit_id"], r["boundary"], r["persistence_window"]]
        assert repr((found["pre_change_median"], found["post_change_median"])) == repr((r["pre"], r["post"]))
        assert repr(sorted(found["_post"], key=lambda v: (v != v, v))) == repr(r["later"]) and found["elapsed_minutes"] == r["elapsed"]


def test_median_of_a_few_columns_skips_nulls(spark):
    from wearline.operators.scale import middle

    nan = float("nan")
    cases = [((None, None, None), None), ((3.0, None, 1.0), 2.0), ((None, 5.0, None), 5.0), ((2.0, 9.0, 4.0), 4.0), ((nan, 1.0, 2.0), 2.0), ((nan, None, 1.0), nan), ((nan, None, None), nan)]
    rows = spark.createDataFrame([c for c, _ in cases], "a double, b double, c double").select(middle([F.col("a"), F.col("b"), F.col("c")]).alias("m"))
    assert repr([r["m"] for r in rows.collect()]) == repr([m for _, m in cases])
