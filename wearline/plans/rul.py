"""Remaining-life estimation, prediction metrics and sequence queries (survey rows I, J and K)."""

from pyspark.sql import functions as F

from wearline.functions.rounding import r6
from wearline.operators import folds as fo
from wearline.operators import manifest as mf
from wearline.operators import metrics as me
from wearline.operators import rul
from wearline.operators import scaling as sc
from wearline.operators import sequences as sq
from wearline.operators.quality import coverage_issues
from wearline.operators.scale import settled
from wearline.plans.catalog import VIEWS, register
from wearline.plans.health import FEATURES, balanced, chosen_onsets, engineered, folds
from wearline.session import cut, parameter_table
from wearline.sources.tables import UNIT, readings

INPUTS = ["horizontal", "vertical", "elapsed_minutes"]


SUBSETS = ("train", "validation", "test")


def planned(spark, sf):
    """Readings, each once, with the folds that train, validate or test on their unit; written once, as every subset is taken from them."""
    taken = [F.collect_list(F.when(F.col("subset") == s, F.col("fold"))).alias(f"_{s}") for s in SUBSETS]
    return settled(readings(spark, sf).join(folds(spark, sf).groupBy("unit_id").agg(*taken), "unit_id"))


def by_subset(spark, sf, subset, rows=None):
    """Readings, or `rows` made of the planned ones, repeated per fold that has their unit in `subset`."""
    rows = planned(spark, sf) if rows is None else rows
    kept = [c for c in rows.columns if c not in {f"_{s}" for s in SUBSETS}]
    return rows.select(*kept, F.explode(f"_{subset}").alias("fold"), F.lit(subset).alias("subset"))


def training(spark, sf, rows=None):
    return fo.balanced_weights(by_subset(spark, sf, "train", rows), ["fold"])


def predictions(spark, sf, rows=None, lifetimes=None):
    """Test predictions of the two parameter-free baselines, from the planned readings and countdown lifetimes where they are at hand."""
    rows = planned(spark, sf) if rows is None else rows
    train, test = training(spark, sf, rows), by_subset(spark, sf, "test", rows)
    lifetimes = settled(rul.countdown_lifetimes(by_subset(spark, sf, "train", rows))) if lifetimes is None else lifetimes
    count = rul.countdown(test, lifetimes).withColumns({"experiment": F.lit("condition_countdown"), "model": F.lit("countdown")})
    middle = test.join(rul.weighted_median(train, ["fold"], "rul_minutes"), "fold").withColumns(
        {"prediction_raw_minutes": F.col("weighted_median"), "experiment": F.lit("median_baseline"), "model": F.lit("median")}
    )
    keep = ["experiment", "model", "fold", *UNIT, "acquisition_number", "sequence_index", "total_acquisitions", "elapsed_minutes", "rul_minutes", "prediction_raw_minutes"]
    return mf.prediction_diagnostics(count.select(*keep).unionByName(middle.select(*keep)))


VIEWS["v_train"] = "SELECT fold, weight AS sample_weight, r.* FROM v_readings r JOIN v_weights USING (unit_id)"
VIEWS["v_test"] = "SELECT fold, subset, r.* FROM v_readings r JOIN (SELECT fold, subset, unit_id FROM v_folds WHERE subset = 'test') USING (unit_id)"
VIEWS["v_life"] = """
SELECT fold, condition_id, median(life) AS lifetime_minutes, count(*) AS training_units FROM (SELECT fold, condition_id, unit_id, max(elapsed_minutes) AS life FROM v_train GROUP BY 1, 2, 3) GROUP BY 1, 2
"""
VIEWS["v_median"] = """
SELECT fold, min(rul_minutes) AS weighted_median FROM (
  SELECT fold, rul_minutes, sum(sum(sample_weight)) OVER (PARTITION BY fold ORDER BY rul_minutes) AS upto, sum(sum(sample_weight)) OVER (PARTITION BY fold) AS total FROM v_train GROUP BY 1, 2)
WHERE upto >= total / 2 * (1 - 1e-12::DOUBLE) GROUP BY 1
"""
VIEWS["v_predictions"] = """
SELECT 'condition_countdown' AS experiment, 'countdown' AS model, t.*, greatest(0, lifetime_minutes - elapsed_minutes) AS p FROM v_test t JOIN v_life USING (fold, condition_id)
UNION ALL SELECT 'median_baseline', 'median', t.*, weighted_median FROM v_test t JOIN v_median USING (fold)
"""
_METRICS = """avg(abs(p - rul_minutes)) AS mae, sqrt(avg((p - rul_minutes) ** 2)) AS rmse, CASE WHEN max(rul_minutes) > min(rul_minutes) THEN 1 - sum((p - rul_minutes) ** 2) / (count(*) * var_pop(rul_minutes)) END AS r2, avg(p - rul_minutes) AS signed_error"""
VIEWS["v_unit_metrics"] = f"""
SELECT experiment, model, fold, condition_id, unit_id, {_METRICS}, max(rul_minutes) AS life, count(*) FILTER (p < 0) AS negative_raw_prediction_count, count(*) AS acquisition_count,
       count(*) FILTER (rise > 0) AS violations, coalesce(sum(rise) FILTER (rise > 0), 0) AS magnitude, count(*) FILTER (rise > 0) / nullif(count(rise), 0)::DOUBLE AS rate
FROM (SELECT *, p - lag(p) OVER (PARTITION BY experiment, fold, unit_id ORDER BY sequence_index) AS rise FROM v_predictions) GROUP BY 1, 2, 3, 4, 5
"""


def rounded(df, keys, numbers, rest=()):
    return df.select(*keys, *[r6(n).alias(n) for n in numbers], *rest)


def _r(*names):
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


_GRIDS = {
    "ridge": ["alpha=0.01", "alpha=0.1", "alpha=1.0", "alpha=10.0", "alpha=100.0", "alpha=1000.0"],
    "forest": [
        "featureSubsetStrategy=sqrt,maxDepth=30,minInstancesPerNode=1,numTrees=200", "featureSubsetStrategy=0.7,maxDepth=12,minInstancesPerNode=3,numTrees=250",
        "featureSubsetStrategy=all,maxDepth=20,minInstancesPerNode=5,numTrees=250",
    ],
    "boosting": ["maxDepth=5,maxIter=200,minInstancesPerNode=20,stepSize=0.05", "maxDepth=4,maxIter=300,minInstancesPerNode=30,stepSize=0.05", "maxDepth=5,maxIter=150,minInstancesPerNode=20,stepSize=0.1"],
    "countdown": [""], "median": [""],
}


@register(
    "i1_experiment_matrix",
    f"""WITH e(experiment, inputs, family, complexity_order) AS (VALUES ('dummy_median', 'none', 'median', 0), ('condition_lifetime_countdown', 'context', 'countdown', 0), ('time_only_ridge', 'time', 'ridge', 1), ('selected_features_ridge', 'selected', 'ridge', 1),
            ('selected_features_random_forest', 'selected', 'forest', 3), ('selected_features_hist_gradient_boosting', 'selected', 'boosting', 2), ('all_features_ridge', 'all', 'ridge', 1), ('all_features_random_forest', 'all', 'forest', 3),
            ('all_features_hist_gradient_boosting', 'all', 'boosting', 2), ('selected_features_plus_time_ridge', 'selected+time', 'ridge', 1)),
          g(family, candidate_id, parameters) AS (VALUES {', '.join(f"('{f}', {i}, '{c}')" for f, grid in _GRIDS.items() for i, c in enumerate(grid))}),
          n AS (SELECT fold, count(*) AS training_rows FROM v_readings JOIN v_folds USING (unit_id) WHERE subset = 'train' GROUP BY 1)
        SELECT experiment, inputs, family, complexity_order, candidate_id, parameters, fold, training_rows FROM e JOIN g USING (family), n""",
)
def experiment_matrix(spark, sf):
    """Candidates per experiment with the training rows each of them would read in every fold."""
    rows = by_subset(spark, sf, "train").groupBy("fold").agg(F.count("*").alias("training_rows"))
    matrix = rul.experiment_matrix(spark).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return matrix.join(rows, "fold")


@register("i2_weighted_median", "SELECT fold, weighted_median FROM v_median")
def weighted_median(spark, sf):
    return rul.weighted_median(training(spark, sf), ["fold"], "rul_minutes")


@register(
    "i3_condition_countdown",
    "SELECT fold, unit_id, sequence_index, greatest(0, lifetime_minutes - elapsed_minutes) AS prediction_raw_minutes FROM v_test JOIN v_life USING (fold, condition_id)",
)
def condition_countdown(spark, sf):
    rows = planned(spark, sf)
    life = rul.countdown_lifetimes(by_subset(spark, sf, "train", rows))
    return rul.countdown(by_subset(spark, sf, "test", rows), life).select("fold", "unit_id", "sequence_index", "prediction_raw_minutes")


VIEWS["v_ridge"] = """
SELECT fold, alpha, sxy / (sxx + alpha) AS beta, my - mx * sxy / (sxx + alpha) AS intercept FROM (
  SELECT fold, sum(sample_weight * (elapsed_minutes - mx) ** 2) AS sxx, sum(sample_weight * (elapsed_minutes - mx) * (rul_minutes - my)) AS sxy, any_value(mx) AS mx, any_value(my) AS my FROM (
    SELECT *, sum(sample_weight * elapsed_minutes) OVER w / sum(sample_weight) OVER w AS mx, sum(sample_weight * rul_minutes) OVER w / sum(sample_weight) OVER w AS my FROM v_train WINDOW w AS (PARTITION BY fold)) GROUP BY 1),
  (VALUES (0.01::DOUBLE), (0.1), (1.0), (10.0), (100.0), (1000.0)) a(alpha)
"""


@register("i4_ridge_time_only", "SELECT fold, alpha, round(beta, 6) + 0.0 AS beta, round(intercept, 6) + 0.0 AS intercept FROM v_ridge")
def ridge_time_only(spark, sf):
    fits = rul.ridge_fits(training(spark, sf), ["elapsed_minutes"], "rul_minutes", rul.RIDGE_ALPHAS)
    return fits.select("fold", "alpha", r6(F.get("coefficients", F.lit(0))).alias("beta"), r6("intercept").alias("intercept"))


def _tree(family, parameters):
    def query(spark, sf):
        rows = planned(spark, sf)
        train, test, scored = cut(training(spark, sf, rows)), cut(by_subset(spark, sf, "test", rows)), None
        for fold in range(5):  # one distributed fit per fold
            part = rul.tree_predictions(train.where(F.col("fold") == fold), test.where(F.col("fold") == fold), INPUTS, "rul_minutes", family, parameters)
            scored = part if scored is None else scored.unionByName(part)
        diag = mf.prediction_diagnostics(scored)
        return diag.groupBy("fold", "unit_id").agg(r6(F.avg("absolute_error_minutes"), 3).alias("mae"), F.count("*").alias("n"))

    return query


register("i5_random_forest")(_tree("forest", {"numTrees": 8, "maxDepth": 5, "minInstancesPerNode": 5, "featureSubsetStrategy": "all"}))
register("i6_boosted_trees")(_tree("boosting", {"stepSize": 0.1, "maxIter": 4, "maxDepth": 4, "minInstancesPerNode": 20}))


def _masked(feature):
    return f"(CASE WHEN feature IN ('horizontal_energy', 'vertical_rms') THEN ln(1 + value) ELSE value END - center) / scale) FILTER (feature = '{feature}')"


VIEWS["v_inputs"] = f"""
SELECT fold, subset, unit_id, sequence_index, {', '.join(f"max({_masked(f)} AS {f}" for f in FEATURES)} FROM v_engineered JOIN v_robust USING (feature) JOIN (SELECT fold, subset, unit_id FROM v_folds) USING (fold, unit_id) GROUP BY ALL
"""


def inputs(spark, sf):
    """Every reading in every fold with the features as that fold's training rows scale them."""
    plan = folds(spark, sf).select("fold", "subset", "unit_id")
    wide = sc.transformed(engineered(spark, sf), sc.robust_parameters(balanced(spark, sf), ["fold"]), ["fold"], [*UNIT, "sequence_index"], FEATURES)
    return wide.join(plan, ["fold", "unit_id"])


@register("i7_experiment_transform", f"SELECT fold, unit_id, sequence_index, {_r(*FEATURES)} FROM v_inputs WHERE subset = 'test'")
def experiment_transform(spark, sf):
    return rounded(inputs(spark, sf).where("subset = 'test'"), ["fold", "unit_id", "sequence_index"], FEATURES)


#: The frozen selection and the inputs of the ridge experiments.
SELECTED = ["horizontal_energy", "vertical_rms"]
RIDGES = {"time_only_ridge": ["elapsed_minutes"], "selected_features_ridge": SELECTED, "all_features_ridge": FEATURES, "selected_features_plus_time_ridge": [*SELECTED, "elapsed_minutes"]}


def _solved(source, features, alphas, name):
    """SQL of the ridge coefficients b0, b1, ... of all folds and alphas by Gaussian elimination; b0 belongs to the first feature."""
    p, y = len(features), "rul_minutes"
    cell = lambda u, v: f"sum(sample_weight * {u} * {v}) - sum(sample_weight * {u}) * sum(sample_weight * {v}) / sum(sample_weight)"
    moments = [f"{cell(features[i], features[j])} AS s{i}_{j}" for i in range(p) for j in range(i, p)] + [f"{cell(f, y)} AS s{i}_{p}" for i, f in enumerate(features)]
    means = [f"sum(sample_weight * {f}) / sum(sample_weight) AS m{i}" for i, f in enumerate([*features, y])]
    keep = ", ".join(f"m{i}" for i in range(p + 1))
    sql = f"SELECT fold, {', '.join(moments + means)} FROM {source} GROUP BY fold"
    start = [f"s{min(i, j)}_{max(i, j)}{' + alpha' if i == j else ''} AS a{i}_{j}" for i in range(p) for j in range(p)] + [f"s{i}_{p} AS a{i}_{p}" for i in range(p)]
    sql = f"SELECT fold, alpha, {keep}, {', '.join(start)} FROM ({sql}), (VALUES {', '.join(f'({a}::DOUBLE)' for a in alphas)}) t(alpha)"
    for k in range(p - 1):
        cells = [f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" if i > k else f"a{i}_{j}" for i in range(p) for j in range(p + 1)]
        sql = f"SELECT fold, alpha, {keep}, {', '.join(cells)} FROM ({sql})"
    for i in range(p - 1, -1, -1):
        rest = "".join(f" - a{i}_{j} * b{j}" for j in range(i + 1, p))
        sql = f"SELECT *, (a{i}_{p}{rest}) / a{i}_{i} AS b{i} FROM ({sql})"
    return f"SELECT '{name}' AS experiment, fold, alpha, m{p}{''.join(f' - m{i} * b{i}' for i in range(p))} AS intercept, {', '.join(f'b{i}' for i in range(p))} FROM ({sql})"


VIEWS["v_design"] = "SELECT i.*, elapsed_minutes, rul_minutes FROM v_inputs i JOIN v_readings USING (unit_id, sequence_index)"
VIEWS["v_design_train"] = "SELECT d.*, weight AS sample_weight FROM v_design d JOIN v_weights USING (fold, unit_id) WHERE subset = 'train'"
for _i, (_name, _features) in enumerate(RIDGES.items()):
    VIEWS[f"v_ridge_{_i}"] = _solved("v_design_train", _features, [f"{a!r}" for a in rul.RIDGE_ALPHAS], _name)
VIEWS["v_ridge_scored"] = " UNION ALL ".join(
    f"SELECT experiment, d.fold, subset, unit_id, sequence_index, alpha, rul_minutes, greatest(intercept{''.join(f' + b{j} * {f}' for j, f in enumerate(features))}, 0) AS p FROM v_design d JOIN v_ridge_{i} USING (fold) WHERE subset <> 'train'"
    for i, features in enumerate(RIDGES.values())
)
VIEWS["v_ridge_ranked"] = """
SELECT experiment, fold, alpha, mae, rmse, CAST(row_number() OVER (PARTITION BY experiment, fold ORDER BY alpha) - 1 AS INTEGER) AS candidate_id, CAST(row_number() OVER (PARTITION BY experiment, fold ORDER BY round(mae, 9), round(rmse, 9), alpha) AS INTEGER) AS selection_rank FROM (
  SELECT experiment, fold, alpha, avg(mae) AS mae, avg(rmse) AS rmse FROM (
    SELECT experiment, fold, alpha, unit_id, avg(abs(p - rul_minutes)) AS mae, sqrt(avg((p - rul_minutes) ** 2)) AS rmse FROM v_ridge_scored WHERE subset = 'validation' GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)
"""


def ridge_selection(spark, sf):
    """All ridge experiments: every alpha fitted per fold on training rows, scored on validation rows, ranked."""
    extra = readings(spark, sf).select("unit_id", "sequence_index", "elapsed_minutes", "rul_minutes", "total_acquisitions", "acquisition_number")
    rows = cut(inputs(spark, sf).join(extra, ["unit_id", "sequence_index"]))
    train = fo.balanced_weights(rows.where("subset = 'train'"), ["fold"])
    fits, features = rul.ridge_many(train, RIDGES, "rul_minutes", rul.RIDGE_ALPHAS)
    scored = mf.prediction_diagnostics(rul.ridge_predict(rows.where("subset = 'validation'"), fits, features))
    records = rul.validation_records(scored, ["experiment", "fold", "candidate_id"])
    ranked = rul.rank_candidates(
        records.withColumns({"validation_macro_mae": F.round("validation_macro_mae", 9), "validation_macro_rmse": F.round("validation_macro_rmse", 9)}),
        ["experiment", "fold"], ["validation_macro_mae", "validation_macro_rmse", "candidate_id"],
    )
    return rows, fits, features, ranked


@register(
    "i8_select_refit_predict",
    """SELECT experiment, fold, unit_id, round(avg(abs(p - rul_minutes)), 6) AS mae FROM v_ridge_scored JOIN (SELECT experiment, fold, alpha FROM v_ridge_ranked WHERE selection_rank = 1) USING (experiment, fold, alpha) WHERE subset = 'test' GROUP BY 1, 2, 3
       UNION ALL SELECT CASE model WHEN 'median' THEN 'dummy_median' ELSE 'condition_lifetime_countdown' END, fold, unit_id, round(avg(abs(greatest(p, 0) - rul_minutes)), 6) FROM v_predictions GROUP BY 1, 2, 3""",
)
def select_refit_predict(spark, sf):
    """Test error of the frozen winners of the ridge experiments next to both parameter-free ones."""
    rows, fits, features, ranked = ridge_selection(spark, sf)
    chosen = fits.join(ranked.where("selected").select("experiment", "fold", "candidate_id"), ["experiment", "fold", "candidate_id"])
    test = mf.prediction_diagnostics(rul.ridge_predict(rows.where("subset = 'test'"), chosen, features)).select("experiment", "fold", "unit_id", "absolute_error_minutes")
    name = F.when(F.col("model") == "median", "dummy_median").otherwise("condition_lifetime_countdown")
    free = predictions(spark, sf).select(name.alias("experiment"), "fold", "unit_id", "absolute_error_minutes")
    return test.unionByName(free).groupBy("experiment", "fold", "unit_id").agg(r6(F.avg("absolute_error_minutes")).alias("mae"))


@register(
    "i9_rank_candidates",
    "SELECT experiment, fold, candidate_id, round(mae, 6) AS validation_macro_mae, round(rmse, 6) AS validation_macro_rmse, selection_rank, selection_rank = 1 AS selected FROM v_ridge_ranked",
)
def rank_candidates(spark, sf):
    return rounded(ridge_selection(spark, sf)[3], ["experiment", "fold", "candidate_id"], ["validation_macro_mae", "validation_macro_rmse"], ["selection_rank", "selected"])


def _linear(spark, sf, alphas=(1.0,), rows=None):
    return rul.ridge_fits(training(spark, sf, rows), INPUTS, "rul_minutes", alphas)


VIEWS["v_linear"] = _solved("v_train", INPUTS, ["1.0"], "linear")


@register(
    "i10_coefficients",
    """SELECT fold, unnest(['horizontal', 'vertical', 'elapsed_minutes']) AS feature, CAST(sign(unnest([b0, b1, b2])) AS INTEGER) AS sign, round(unnest([b0, b1, b2]), 6) + 0.0 AS coefficient, round(abs(unnest([b0, b1, b2])), 6) AS absolute_coefficient FROM v_linear""",
)
def coefficients(spark, sf):
    return rul.coefficient_table(_linear(spark, sf), INPUTS).select("fold", "feature", "sign", r6("coefficient").alias("coefficient"), r6("absolute_coefficient").alias("absolute_coefficient"))


#: Permutations per feature. Fixed value.
REPEATS = 5
VIEWS["v_permuted"] = f"""
SELECT t.fold, feature, repeat, unit_id, rul_minutes, CASE feature WHEN 'horizontal' THEN x ELSE horizontal END AS horizontal, CASE feature WHEN 'vertical' THEN x ELSE vertical END AS vertical, CASE feature WHEN 'elapsed_minutes' THEN x ELSE elapsed_minutes END AS elapsed_minutes
FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY acquisition_number) AS place FROM v_test) t
JOIN (SELECT fold, feature, repeat, CASE feature WHEN 'horizontal' THEN horizontal WHEN 'vertical' THEN vertical ELSE elapsed_minutes END AS x,
             row_number() OVER (PARTITION BY fold, feature, repeat ORDER BY md5('42:' || feature || ':' || repeat || ':' || acquisition_number), acquisition_number) AS place
      FROM v_test, (VALUES ('horizontal'), ('vertical'), ('elapsed_minutes')) f(feature), range({REPEATS}) r(repeat)) d ON d.fold = t.fold AND d.place = t.place
"""
VIEWS["v_importance"] = """
SELECT fold, feature, avg(mae - base) AS gain, stddev_pop(mae - base) AS sd FROM (
  SELECT fold, feature, repeat, avg(mae) AS mae FROM (SELECT fold, feature, repeat, unit_id, avg(abs(greatest(intercept + b0 * horizontal + b1 * vertical + b2 * elapsed_minutes, 0) - rul_minutes)) AS mae FROM v_permuted JOIN v_linear USING (fold) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)
JOIN (SELECT fold, avg(mae) AS base FROM (SELECT fold, unit_id, avg(abs(greatest(intercept + b0 * horizontal + b1 * vertical + b2 * elapsed_minutes, 0) - rul_minutes)) AS mae FROM v_test JOIN v_linear USING (fold) GROUP BY 1, 2) GROUP BY 1) USING (fold) GROUP BY 1, 2
"""


def permutation(spark, sf):
    rows = planned(spark, sf)
    fits = _linear(spark, sf, rows=rows)
    test = by_subset(spark, sf, "test", rows).select("fold", *UNIT, "acquisition_number", "rul_minutes", *INPUTS)
    permuted = rul.permuted_inputs(test, INPUTS, "acquisition_number", REPEATS)
    intact = mf.prediction_diagnostics(rul.ridge_predict(test, fits, INPUTS))
    moved = mf.prediction_diagnostics(rul.ridge_predict(permuted, fits, INPUTS))
    macro = lambda df, by: df.groupBy(*by, "unit_id").agg(F.avg("absolute_error_minutes").alias("mae")).groupBy(*by).agg(F.avg("mae").alias("mae"))
    base = macro(intact, ["fold"]).withColumnRenamed("mae", "base")
    raised = macro(moved, ["fold", "feature", "repeat"]).join(base, "fold").withColumn("increase", F.col("mae") - F.col("base"))
    return raised.groupBy("fold", "feature").agg(F.avg("increase").alias("importance_mean_macro_mae_increase"), F.stddev_pop("increase").alias("importance_std"))


@register("i11_permutation_importance", "SELECT fold, feature, round(gain, 6) + 0.0 AS importance_mean_macro_mae_increase, round(sd, 6) AS importance_std FROM v_importance")
def permutation_importance(spark, sf):
    return rounded(permutation(spark, sf), ["fold", "feature"], ["importance_mean_macro_mae_increase", "importance_std"])


@register(
    "i12_importance_summary",
    """SELECT coalesce(a.feature, b.feature) AS feature, coalesce(m, 0) AS ridge_mean_absolute_coefficient, coalesce(a.n, 0) AS ridge_fold_count, coalesce(v, 0) AS permutation_mean_macro_mae_increase, coalesce(b.n, 0) AS permutation_fold_count
       FROM (SELECT event_type AS feature, round(avg(horizontal), 6) AS m, count(DISTINCT unit_id % 5) AS n FROM v_readings WHERE event_type <> 'view' GROUP BY 1) a
       FULL JOIN (SELECT event_type AS feature, round(avg(vertical), 6) AS v, count(DISTINCT unit_id % 5) AS n FROM v_readings WHERE event_type <> 'click' GROUP BY 1) b ON a.feature = b.feature""",
)
def importance_summary(spark, sf):
    rows = readings(spark, sf).select((F.col("unit_id") % 5).alias("fold"), F.col("event_type").alias("feature"), F.col("horizontal").alias("absolute_coefficient"), F.col("vertical").alias("importance_mean_macro_mae_increase"))
    out = rul.importance_summary(rows.where("feature <> 'view'"), rows.where("feature <> 'click'"))
    return rounded(out, ["feature"], ["ridge_mean_absolute_coefficient", "permutation_mean_macro_mae_increase"], ["ridge_fold_count", "permutation_fold_count"])


@register("j1_regression_metrics", f"SELECT experiment, {_r('mae', 'rmse', 'r2', 'signed_error')} FROM (SELECT experiment, {_METRICS} FROM v_predictions GROUP BY 1)")
def regression_metrics(spark, sf):
    out = predictions(spark, sf).groupBy("experiment").agg(*[c.alias(n) for n, c in me.regression().items()])
    return rounded(out, ["experiment"], ["mae", "rmse", "r2", "signed_error"])


@register(
    "j2_unit_metrics",
    f"SELECT experiment, fold, unit_id, {_r('mae', 'rmse', 'r2', 'signed_error')}, round(mae / life, 6) AS normalized_mae, round(rmse / life, 6) AS normalized_rmse, negative_raw_prediction_count, acquisition_count FROM v_unit_metrics",
)
def unit_metrics(spark, sf):
    out = me.unit_metrics(predictions(spark, sf))
    return rounded(out, ["experiment", "fold", "unit_id"], ["mae", "rmse", "r2", "signed_error", "normalized_mae", "normalized_rmse"], ["negative_raw_prediction_count", "acquisition_count"])


@register(
    "j3_monotonicity_violations",
    """SELECT unit_id, count(*) FILTER (d > 0) AS monotonicity_violation_count, round(sum(d) FILTER (d > 0), 6) AS monotonicity_violation_magnitude, round(count(*) FILTER (d > 0) / count(d)::DOUBLE, 6) AS monotonicity_violation_rate
       FROM (SELECT unit_id, horizontal - lag(horizontal) OVER (PARTITION BY unit_id ORDER BY sequence_index) AS d FROM v_readings) GROUP BY 1""",
)
def monotonicity_violations(spark, sf):
    out = me.with_violations(readings(spark, sf), UNIT, "horizontal").groupBy("unit_id").agg(*[c.alias(n) for n, c in me.violations().items()])
    return rounded(out, ["unit_id"], ["monotonicity_violation_magnitude", "monotonicity_violation_rate"], ["monotonicity_violation_count"])


@register(
    "j4_grouped_metrics",
    f"SELECT experiment, fold, condition_id, {_r('mae', 'rmse')}, acquisition_count FROM (SELECT experiment, fold, condition_id, {_METRICS}, count(*) AS acquisition_count FROM v_predictions GROUP BY GROUPING SETS ((experiment), (experiment, fold), (experiment, condition_id)))",
)
def grouped_metrics(spark, sf):
    out = me.grouping_sets(predictions(spark, sf), [["experiment"], ["experiment", "fold"], ["experiment", "condition_id"]])
    return rounded(out, ["experiment", "fold", "condition_id"], ["mae", "rmse"], ["acquisition_count"])


_FOLD = "SELECT experiment, model, fold, avg(mae) AS macro_mae, avg(rmse) AS macro_rmse, avg(r2) AS macro_r2, avg(mae / life) AS macro_normalized_mae, count(*) AS test_unit_count FROM v_unit_metrics GROUP BY 1, 2, 3"


@register("j5_fold_metrics", f"SELECT experiment, fold, {_r('macro_mae', 'macro_rmse', 'macro_r2', 'macro_normalized_mae')}, test_unit_count FROM ({_FOLD})")
def fold_metrics(spark, sf):
    out = me.fold_metrics(me.unit_metrics(predictions(spark, sf)))
    return rounded(out, ["experiment", "fold"], ["macro_mae", "macro_rmse", "macro_r2", "macro_normalized_mae"], ["test_unit_count"])


@register(
    "j6_condition_metrics",
    f"""SELECT experiment, condition_id, {_r('mae', 'rmse', 'macro_mae', 'macro_rmse')}, unit_count FROM (SELECT experiment, condition_id, {_METRICS}, count(DISTINCT unit_id) AS unit_count FROM v_predictions GROUP BY 1, 2)
        LEFT JOIN (SELECT experiment, condition_id, avg(mae) AS macro_mae, avg(rmse) AS macro_rmse FROM v_unit_metrics GROUP BY 1, 2) USING (experiment, condition_id)""",
)
def condition_metrics(spark, sf):
    rows = cut(predictions(spark, sf))
    out = me.condition_metrics(rows, me.unit_metrics(rows))
    return rounded(out, ["experiment", "condition_id"], ["mae", "rmse", "macro_mae", "macro_rmse"], ["unit_count"])


_COMPARED = ["global_mae", "global_rmse", "global_signed_error", "macro_mae", "macro_rmse", "median_unit_mae", "unit_mae_q1", "unit_mae_q3", "monotonicity_violation_rate", "fold_macro_mae_mean", "fold_macro_mae_std"]


@register(
    "j7_model_comparison",
    f"""SELECT experiment, {_r(*_COMPARED)} FROM (SELECT experiment, mae AS global_mae, rmse AS global_rmse, signed_error AS global_signed_error FROM (SELECT experiment, {_METRICS} FROM v_predictions GROUP BY 1))
        JOIN (SELECT experiment, avg(mae) AS macro_mae, avg(rmse) AS macro_rmse, median(mae) AS median_unit_mae, quantile_cont(mae, 0.25) AS unit_mae_q1, quantile_cont(mae, 0.75) AS unit_mae_q3, avg(rate) AS monotonicity_violation_rate FROM v_unit_metrics GROUP BY 1) USING (experiment)
        JOIN (SELECT experiment, avg(macro_mae) AS fold_macro_mae_mean, stddev_samp(macro_mae) AS fold_macro_mae_std FROM ({_FOLD}) GROUP BY 1) USING (experiment) ORDER BY macro_mae""",
)
def model_comparison(spark, sf):
    rows = cut(predictions(spark, sf))  # read by the row, unit and fold summaries
    units = me.unit_metrics(rows)
    return rounded(me.model_comparison(rows, units, me.fold_metrics(units)), ["experiment"], _COMPARED)


def test_onsets(spark, sf):
    """The onset of every test unit under the setting its fold chose."""
    return cut(chosen_onsets(spark, sf).where("subset = 'test'").select("fold", "unit_id", "onset_status", "onset_index"))


VIEWS["v_test_onsets"] = "SELECT fold, unit_id, CASE WHEN hit THEN 'detected' ELSE 'not_detected' END AS onset_status, CAST(hit_at AS BIGINT) AS onset_index FROM v_onsets WHERE subset = 'test'"
VIEWS["v_posthoc"] = """
SELECT p.*, CASE WHEN (CASE WHEN total_acquisitions > 1 THEN sequence_index / (total_acquisitions - 1)::DOUBLE ELSE 0 END) < 0.33 THEN 'early' WHEN sequence_index / (total_acquisitions - 1)::DOUBLE < 0.66 THEN 'intermediate' ELSE 'late' END AS life_stage,
       CASE WHEN onset_status <> 'detected' THEN 'estimated onset not detected' WHEN sequence_index < onset_index THEN 'before estimated onset' ELSE 'after estimated onset' END AS estimated_onset_region
FROM v_predictions p LEFT JOIN v_test_onsets USING (fold, unit_id)
"""


@register("j8_posthoc_regions", "SELECT experiment, fold, unit_id, sequence_index, life_stage, estimated_onset_region FROM v_posthoc")
def posthoc_regions(spark, sf):
    out = me.annotate_posthoc(predictions(spark, sf), test_onsets(spark, sf))
    return out.select("experiment", "fold", "unit_id", "sequence_index", "life_stage", "estimated_onset_region")


for _name, _column in (("j9_life_stage_metrics", "life_stage"), ("j9_onset_region_metrics", "estimated_onset_region")):

    def _regional(spark, sf, column=_column):
        out = me.grouped_metrics(me.annotate_posthoc(predictions(spark, sf), test_onsets(spark, sf)), ["experiment", column])
        return rounded(out, ["experiment", column], ["mae", "rmse", "signed_error"], ["acquisition_count", "unit_count"])

    register(
        _name,
        f"SELECT experiment, {_column}, {_r('mae', 'rmse', 'signed_error')}, acquisition_count, unit_count FROM (SELECT experiment, {_column}, {_METRICS}, count(*) AS acquisition_count, count(DISTINCT unit_id) AS unit_count FROM v_posthoc GROUP BY 1, 2)",
    )(_regional)


@register(
    "j10_countdown_lifetimes",
    f"""SELECT u.fold, u.condition_id, u.unit_id, lifetime_minutes, training_units, u.life AS true_lifetime_minutes, lifetime_minutes - u.life AS lifetime_error_minutes, {_r('mae')} FROM v_unit_metrics u JOIN v_life USING (fold, condition_id) WHERE experiment = 'condition_countdown'""",
)
def countdown_lifetimes(spark, sf):
    rows = planned(spark, sf)
    life = settled(rul.countdown_lifetimes(by_subset(spark, sf, "train", rows)))
    if not coverage_issues(life, life, ["fold", "condition_id"]).where("code = 'duplicate_key'").isEmpty():
        raise ValueError("lifetimes are not unique per fold and condition")
    units = me.unit_metrics(predictions(spark, sf, rows, life).where("experiment = 'condition_countdown'"))
    truth = by_subset(spark, sf, "test", rows).groupBy("fold", *UNIT).agg(F.max("rul_minutes").alias("true_lifetime_minutes"))
    out = units.join(truth, ["fold", *UNIT]).join(life, ["fold", "condition_id"])
    return out.withColumn("lifetime_error_minutes", F.col("lifetime_minutes") - F.col("true_lifetime_minutes")).select(
        "fold", *UNIT, "lifetime_minutes", "training_units", "true_lifetime_minutes", "lifetime_error_minutes", r6("mae").alias("mae")
    )


@register(
    "j11_support_matched",
    f"""WITH m AS (SELECT k AS length, p.* FROM v_predictions p, (VALUES (5), (20)) t(k) WHERE sequence_index >= k - 1)
        SELECT 'sequence_' || length AS candidate_experiment, experiment, {_r('mae', 'macro_mae')}, acquisition_count FROM (SELECT length, experiment, {_METRICS}, count(*) AS acquisition_count FROM m GROUP BY 1, 2)
        JOIN (SELECT length, experiment, avg(mae) AS macro_mae FROM (SELECT length, experiment, fold, unit_id, {_METRICS} FROM m GROUP BY 1, 2, 3, 4) GROUP BY 1, 2) USING (length, experiment)""",
)
def support_matched(spark, sf):
    every = planned(spark, sf)
    rows = predictions(spark, sf, every)
    held = by_subset(spark, sf, "test", every).select("fold", "unit_id", "acquisition_number", "sequence_index", F.explode(F.array(F.lit(5), F.lit(20))).alias("k"))
    candidates = held.where("sequence_index >= k - 1").withColumn("experiment", F.concat(F.lit("sequence_"), F.col("k").cast("string")))
    return rounded(me.support_matched(rows, candidates), ["candidate_experiment", "experiment"], ["mae", "macro_mae"], ["acquisition_count"])


@register("j12_onset_coverage", "SELECT fold, unit_id, CAST(CASE WHEN unit_id % 3 = 0 THEN 0 ELSE 2 END AS BIGINT) AS onset_rows FROM v_folds WHERE subset = 'test' AND unit_id % 3 < 2")
def onset_coverage(spark, sf):
    onsets = test_onsets(spark, sf).where("unit_id % 3 > 0")
    return me.onset_coverage_issues(onsets.unionByName(onsets.where("unit_id % 3 = 1")), folds(spark, sf))


ROLES = [("rul_minutes", "target"), ("unit_id", "identifier"), ("total_acquisitions", "future_derived"), ("elapsed_minutes", "context"), ("horizontal", "feature"), ("vertical", "feature")]


@register(
    "j13_input_columns",
    """SELECT 'rul_minutes' AS "column", 'target' AS role, count(rul_minutes) AS rows FROM v_readings UNION ALL SELECT 'total_acquisitions', 'future_derived', count(total_acquisitions) FROM v_readings
       UNION ALL SELECT 'acquisition_number', 'unregistered', count(acquisition_number) FROM v_readings""",
)
def input_columns(spark, sf):
    roles = parameter_table(spark, ROLES, "column string, role string")
    return me.input_column_issues(readings(spark, sf), ["horizontal", "vertical", "elapsed_minutes", "rul_minutes", "total_acquisitions", "acquisition_number"], roles)


@register(
    "k1_trailing_sequences",
    """SELECT unit_id, sequence_index, round(list_sum(h), 6) AS total, round(h[1], 6) AS oldest, round(h[5], 6) AS newest, rul_minutes FROM (
       SELECT unit_id, sequence_index, rul_minutes, list(horizontal) OVER (PARTITION BY unit_id ORDER BY sequence_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS h FROM v_readings) WHERE sequence_index >= 4""",
)
def trailing_sequences(spark, sf):
    rows = sq.build_sequences(readings(spark, sf), UNIT, ["horizontal", "vertical"], 5)
    h = F.transform("steps", lambda s: s["horizontal"])
    total = F.aggregate(h, F.lit(0.0), lambda a, v: a + v)
    return rows.select("unit_id", "sequence_index", r6(total).alias("total"), r6(F.get(h, F.lit(0))).alias("oldest"), r6(F.get(h, F.lit(4))).alias("newest"), "rul_minutes")


@register(
    "k2_sequence_coverage",
    """SELECT unit_id, CAST(10 AS INTEGER) AS sequence_length, n AS original_acquisitions, CAST(greatest(n - 9, 0) AS BIGINT) AS eligible_sequences, CAST(least(9, n) AS BIGINT) AS dropped_prefix, round(greatest(n - 9, 0) / n::DOUBLE, 6) AS coverage_proportion FROM v_units""",
)
def sequence_coverage(spark, sf):
    out = sq.coverage(readings(spark, sf), ["unit_id"], 10)
    return out.withColumn("coverage_proportion", r6("coverage_proportion"))


@register(
    "k3_sequence_context",
    """WITH t AS (SELECT fold, sum(sample_weight * rul_minutes) / sum(sample_weight) AS c FROM v_train GROUP BY 1), s AS (SELECT fold, sqrt(sum(sample_weight * (rul_minutes - c) ** 2) / sum(sample_weight)) AS s FROM v_train JOIN t USING (fold) GROUP BY 1)
       SELECT fold, unit_id, sequence_index, elapsed_minutes, round(horizontal, 6) AS last_horizontal, round((rul_minutes - c) / s, 6) + 0.0 AS scaled_target FROM v_test JOIN t USING (fold) JOIN s USING (fold) WHERE sequence_index >= 2""",
)
def sequence_context(spark, sf):
    from wearline.operators.scaling import weighted_target

    every = planned(spark, sf)
    rows = sq.build_sequences(by_subset(spark, sf, "test", every), ["fold", *UNIT], ["horizontal"], 3)
    target = weighted_target(training(spark, sf, every), ["fold"], "rul_minutes")
    last = F.element_at("steps", -1)["horizontal"]
    return rows.join(target, "fold").select(
        "fold", "unit_id", "sequence_index", "elapsed_minutes", r6(last).alias("last_horizontal"), r6((F.col("rul_minutes") - F.col("center")) / F.col("scale")).alias("scaled_target")
    )


LENGTHS = (1, 5, 10, 20)


def sequence_candidates(spark, sf, subset):
    """Lag-matrix ridge per window length: train on training windows, score the subset's windows.

    Folds take whole units, so a window is built once for all of them. Weights join the readings in front of their windows, so that no
    exchange carries a wide row.
    """
    rows, scored = planned(spark, sf).select(*UNIT, "sequence_index", "rul_minutes", "horizontal", "vertical", *[f"_{s}" for s in SUBSETS]), None
    for length in LENGTHS:
        names = [f"{f}_lag{length - 1 - k}" for k in range(length) for f in ("horizontal", "vertical")]

        def matrix(rows, extra=(), length=length):
            windows = sq.build_sequences(rows.select(*UNIT, "sequence_index", "rul_minutes", "horizontal", "vertical", *extra), UNIT, ["horizontal", "vertical"], length)
            return windows.select(*UNIT, "sequence_index", "rul_minutes", *extra, *sq.flat_features("steps", ["horizontal", "vertical"], length))

        weights = fo.unit_weights(by_subset(spark, sf, "train", matrix(rows, ["_train"])), ["fold"])
        weighted = weights.groupBy("unit_id").agg(F.collect_list(F.struct("fold", "sample_weight")).alias("_weighted"))
        train = matrix(rows.join(weighted, "unit_id"), ["_weighted"]).select("*", F.inline("_weighted")).drop("_weighted")
        fits = rul.ridge_fits(train, names, "rul_minutes", (1.0,))
        held = by_subset(spark, sf, subset, matrix(rows, [f"_{subset}"]))
        part = mf.prediction_diagnostics(rul.ridge_predict(held, fits, names)).select(
            "fold", "subset", *UNIT, "rul_minutes", "prediction_non_negative_minutes", F.lit(length).alias("sequence_length"), F.lit(2 * length + 1).alias("parameter_count")
        )
        scored = part if scored is None else scored.unionByName(part)
    return scored


@register("k4_sequence_regression")
def sequence_regression(spark, sf):
    scored = sequence_candidates(spark, sf, "validation")
    return rounded(rul.validation_records(scored, ["fold", "sequence_length", "parameter_count"]), ["fold", "sequence_length", "parameter_count"], ["validation_macro_mae", "validation_macro_rmse"])


@register(
    "k5_rank_sequence_candidates",
    """SELECT fold, sequence_length, CAST(row_number() OVER (PARTITION BY fold ORDER BY mae, rmse, sequence_length) AS INTEGER) AS selection_rank FROM (
       SELECT CAST(unit_id % 5 AS INTEGER) AS fold, CAST(1 + (unit_id // 5) % 3 AS INTEGER) AS sequence_length, round(avg(horizontal), 9) AS mae, round(stddev_pop(horizontal), 9) AS rmse FROM v_readings GROUP BY 1, 2)""",
)
def rank_sequence_candidates(spark, sf):
    records = readings(spark, sf).groupBy((F.col("unit_id") % 5).cast("int").alias("fold"), (1 + F.floor(F.col("unit_id") / 5) % 3).cast("int").alias("sequence_length")).agg(
        F.round(F.avg("horizontal"), 9).alias("mae"), F.round(F.stddev_pop("horizontal"), 9).alias("rmse")
    )
    return rul.rank_candidates(records, ["fold"], ["mae", "rmse", "sequence_length"]).select("fold", "sequence_length", "selection_rank")


def occlusion(spark, sf):
    """Macro-MAE increase when one feature is silenced in every step of the test windows."""
    features, length = ["horizontal", "vertical"], 3
    names = [f"{f}_lag{length - 1 - k}" for k in range(length) for f in features]
    every = planned(spark, sf)
    windows = lambda subset: sq.build_sequences(by_subset(spark, sf, subset, every), ["fold", *UNIT], features, length)
    flat = sq.flat_features("steps", features, length)
    train = fo.balanced_weights(windows("train").select("fold", *UNIT, "rul_minutes", *flat), ["fold"])
    fits = rul.ridge_fits(train, names, "rul_minutes", (1.0,))
    silenced = sq.occluded(windows("test"), features).select("fold", *UNIT, "occluded", "rul_minutes", *flat)
    scored = mf.prediction_diagnostics(rul.ridge_predict(silenced, fits, names))
    macro = scored.groupBy("fold", "occluded", "unit_id").agg(F.avg("absolute_error_minutes").alias("mae")).groupBy("fold", "occluded").agg(F.avg("mae").alias("mae"))
    base = macro.where("occluded = 'none'").select("fold", F.col("mae").alias("base"))
    return macro.where("occluded <> 'none'").join(base, "fold").select("fold", F.col("occluded").alias("feature"), (F.col("mae") - F.col("base")).alias("importance_macro_mae_increase"))


@register("k6_occlusion")
def occlusion_importance(spark, sf):
    return rounded(occlusion(spark, sf), ["fold", "feature"], ["importance_macro_mae_increase"])


@register(
    "k7_occlusion_summary",
    "SELECT event_type AS feature, round(avg(horizontal - vertical), 6) + 0.0 AS importance_macro_mae_increase FROM v_readings GROUP BY 1 ORDER BY 2 DESC, 1",
)
def occlusion_summary(spark, sf):
    rows = readings(spark, sf).select(F.col("event_type").alias("feature"), (F.col("horizontal") - F.col("vertical")).alias("increase"))
    return rows.groupBy("feature").agg(r6(F.avg("increase")).alias("importance_macro_mae_increase")).orderBy(F.desc("importance_macro_mae_increase"), "feature")


