"""Remaining-life estimators: countdown and median baselines, ridge for all folds in one pass, MLlib trees."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wearline.operators.scale import TINY, index_units, percentiles, running, same_keys, settled
from wearline.session import fits_one_task, parameter_table

#: Rows of a scope per hash range of a permutation.
RANGE_ROWS = 65_536
#: Candidate grids. Fixed values.
RIDGE_ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
FOREST_GRID = (
    {"numTrees": 200, "maxDepth": 30, "minInstancesPerNode": 1, "featureSubsetStrategy": "sqrt"},
    {"numTrees": 250, "maxDepth": 12, "minInstancesPerNode": 3, "featureSubsetStrategy": "0.7"},
    {"numTrees": 250, "maxDepth": 20, "minInstancesPerNode": 5, "featureSubsetStrategy": "all"},
)
BOOSTING_GRID = (
    {"stepSize": 0.05, "maxIter": 200, "maxDepth": 5, "minInstancesPerNode": 20},
    {"stepSize": 0.05, "maxIter": 300, "maxDepth": 4, "minInstancesPerNode": 30},
    {"stepSize": 0.1, "maxIter": 150, "maxDepth": 5, "minInstancesPerNode": 20},
)
#: Experiments: inputs, model family and complexity order. Fixed values.
EXPERIMENTS = (
    ("dummy_median", "none", "median", 0),
    ("condition_lifetime_countdown", "context", "countdown", 0),
    ("time_only_ridge", "time", "ridge", 1),
    ("selected_features_ridge", "selected", "ridge", 1),
    ("selected_features_random_forest", "selected", "forest", 3),
    ("selected_features_hist_gradient_boosting", "selected", "boosting", 2),
    ("all_features_ridge", "all", "ridge", 1),
    ("all_features_random_forest", "all", "forest", 3),
    ("all_features_hist_gradient_boosting", "all", "boosting", 2),
    ("selected_features_plus_time_ridge", "selected+time", "ridge", 1),
)


def experiment_matrix(spark: SparkSession) -> DataFrame:
    """Every experiment with each candidate of its model family, numbered inside the experiment."""
    grids = {"ridge": [{"alpha": a} for a in RIDGE_ALPHAS], "forest": FOREST_GRID, "boosting": BOOSTING_GRID}
    rows = [
        (name, inputs, family, order, i, ",".join(f"{k}={v}" for k, v in sorted(candidate.items())))
        for name, inputs, family, order in EXPERIMENTS
        for i, candidate in enumerate(grids.get(family, [{}]))
    ]
    return parameter_table(spark, rows, "experiment string, inputs string, family string, complexity_order int, candidate_id int, parameters string")


def countdown_lifetimes(training: DataFrame, scope: Sequence[str] = ("fold",), split: bool | None = None) -> DataFrame:
    """Median training lifetime per condition; a unit whose end points disagree is an error."""
    units = training.groupBy(*scope, "condition_id", "unit_id").agg(F.max("elapsed_minutes").alias("_life"), F.max("rul_minutes").alias("_rul"))
    agreed = F.when(F.abs(F.col("_life") - F.col("_rul")) <= 1e-6, F.col("_life")).otherwise(
        F.raise_error(F.lit("lifetime and remaining life disagree")).cast("double")
    )
    return percentiles(units.withColumn("_life", agreed), [*scope, "condition_id"], {"lifetime_minutes": (F.col("_life"), 0.5)}, {"training_units": F.count(F.lit(1))}, split)


def countdown(rows: DataFrame, lifetimes: DataFrame, scope: Sequence[str] = ("fold",)) -> DataFrame:
    """Lifetime minus elapsed time, floored at 0; a condition without training units is an error."""
    joined = rows.join(lifetimes.select(*scope, "condition_id", "lifetime_minutes"), [*scope, "condition_id"], "left")
    life = F.coalesce("lifetime_minutes", F.raise_error(F.lit("no training lifetime for the condition")).cast("double"))
    return joined.withColumn("prediction_raw_minutes", F.greatest(F.lit(0.0), life - F.col("elapsed_minutes"))).drop("lifetime_minutes")


def weighted_median(rows: DataFrame, scope: Sequence[str], value: str, weight: str = "sample_weight", split: bool | None = None) -> DataFrame:
    """First value whose cumulative weight reaches half of the total, per scope."""
    tallied = settled(rows.groupBy(*scope, value).agg(F.sum(weight).alias("_w")))
    summed = running(tallied, scope, [value], {"_upto": ("sum", F.col("_w"))}, split)
    totals = tallied.groupBy(*scope).agg(F.sum("_w").alias("_total"))
    reached = F.col("_upto") >= F.col("_total") / 2 * (1 - 1e-12)
    return summed.join(totals, list(scope)).where(reached).groupBy(*scope).agg(F.min(value).alias("weighted_median"))


def _products(features: int, scope: str):
    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, part in pdf.groupby(scope):
                rows = np.stack(part["x"].to_numpy())
                design = np.column_stack([np.ones(len(rows)), rows, part["y"].to_numpy(float)])
                yield pd.DataFrame({scope: [key], "m": [((design * part["w"].to_numpy(float)[:, None]).T @ design).ravel()]})

    return products


def _moments(rows: DataFrame, features: Sequence[str], target: str, scope: str, weight: str | None) -> dict[object, np.ndarray]:
    """X'WX of (1, features, target) per scope value; tasks add it up and (features + 2)^2 numbers per scope reach the driver."""
    kind = rows.schema[scope].dataType.simpleString()
    prepared = rows.select(
        scope, F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.col(target).cast("double").alias("y"),
        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"),
    )
    parts = prepared.mapInPandas(_products(len(features), scope), f"{scope} {kind}, m array<double>").select(scope, F.posexplode("m").alias("cell", "v"))
    summed = parts.groupBy(scope, "cell").agg(F.sum("v").alias("v")).groupBy(scope).agg(F.array_sort(F.collect_list(F.struct("cell", "v"))).alias("m"))
    return {r[scope]: np.array([c["v"] for c in r["m"]]).reshape(len(features) + 2, -1) for r in summed.orderBy(scope).collect()}


def ridge_many(rows: DataFrame, subsets: Mapping[str, Sequence[str]], target: str, alphas: Sequence[float], scope: str = "fold", weight: str | None = "sample_weight") -> tuple[DataFrame, list[str]]:
    """Weighted ridge with a free intercept for every experiment (a named feature subset), scope value and alpha.

    One pass over the rows serves all of them: every subset's normal equations are a part of one product matrix.
    Returns (experiment, scope, candidate_id, alpha, intercept, coefficients) and the features the coefficients belong to; those
    outside an experiment's subset are 0, so `ridge_predict` scores all experiments at once.
    """
    features = sorted({f for names in subsets.values() for f in names})
    fits = []
    for key, m in _moments(rows, features, target, scope, weight).items():
        total, mean_x, mean_y = m[0, 0], m[0, 1:-1] / m[0, 0], m[0, -1] / m[0, 0]
        xx = m[1:-1, 1:-1] - total * np.outer(mean_x, mean_x)
        xy = m[1:-1, -1] - total * mean_x * mean_y
        for name, chosen in subsets.items():
            at = [features.index(f) for f in chosen]
            for i, alpha in enumerate(alphas):
                beta = np.zeros(len(features))
                beta[at] = np.linalg.solve(xx[np.ix_(at, at)] + alpha * np.eye(len(at)), xy[at])
                fits.append((name, key, i, float(alpha), float(mean_y - mean_x @ beta), beta.tolist()))
    kind = rows.schema[scope].dataType.simpleString()
    return parameter_table(rows.sparkSession, fits, f"experiment string, {scope} {kind}, candidate_id int, alpha double, intercept double, coefficients array<double>"), features


def ridge_fits(rows: DataFrame, features: Sequence[str], target: str, alphas: Sequence[float], scope: str = "fold", weight: str | None = "sample_weight") -> DataFrame:
    """`ridge_many` of a single subset: scope, candidate_id, alpha, intercept, coefficients in the order of `features`."""
    fits, order = ridge_many(rows, {"": features}, target, alphas, scope, weight)
    return fits.drop("experiment").withColumn("coefficients", F.array(*[F.get("coefficients", F.lit(order.index(f))) for f in features]))


def ridge_predict(rows: DataFrame, fits: DataFrame, features: Sequence[str], scope: str = "fold") -> DataFrame:
    """Raw predictions of every fitted candidate of the row's scope."""
    terms = [F.col(f).cast("double") * F.get("coefficients", F.lit(i)) for i, f in enumerate(features)]
    value = sum(terms, F.col("intercept"))
    return rows.join(fits, scope).withColumn("prediction_raw_minutes", value).drop("coefficients", "intercept")


def coefficient_table(fits: DataFrame, features: Sequence[str], scope: str = "fold") -> DataFrame:
    """Long coefficients with sign and magnitude."""
    names = F.array(*[F.lit(f) for f in features])
    long = fits.select(scope, "candidate_id", "alpha", F.inline(F.arrays_zip(names.alias("feature"), F.col("coefficients").alias("coefficient"))))
    return long.withColumns({"sign": F.signum("coefficient").cast("int"), "absolute_coefficient": F.abs("coefficient")})


def tree_predictions(
    train: DataFrame, score: DataFrame, features: Sequence[str], target: str, family: str, parameters: Mapping[str, object], weight: str = "sample_weight", seed: int = 42
) -> DataFrame:
    """Fit a weighted forest or boosted trees and add raw predictions to `score`."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="_x")
    common = {"featuresCol": "_x", "labelCol": target, "weightCol": weight, "predictionCol": "prediction_raw_minutes", "seed": seed}
    kinds = {"forest": RandomForestRegressor, "boosting": GBTRegressor}
    model = kinds[family](**common, **parameters).fit(assembler.transform(train))
    return model.transform(assembler.transform(score)).drop("_x")


def rank_candidates(records: DataFrame, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Rank the (small) candidate table by the listed columns and flag the winner of every group."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return records.withColumn("selection_rank", place).withColumn("selected", F.col("selection_rank") == 1)


def validation_records(scored: DataFrame, by: Sequence[str], truth: str = "rul_minutes", predicted: str = "prediction_non_negative_minutes") -> DataFrame:
    """Macro MAE and RMSE of candidates on validation rows; any other subset is an error."""
    guarded = scored.withColumn(
        "_e", F.when(F.col("subset") == "validation", F.col(predicted) - F.col(truth)).otherwise(F.raise_error(F.lit("only validation rows may rank candidates")).cast("double"))
    )
    units = guarded.groupBy(*by, "unit_id").agg(F.avg(F.abs("_e")).alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"))
    return units.groupBy(*by).agg(F.avg("mae").alias("validation_macro_mae"), F.avg("rmse").alias("validation_macro_rmse"))


def permuted_inputs(rows: DataFrame, features: Sequence[str], key: str, repeats: int, scope: str = "fold", seed: int = 42, split: bool | None = None) -> DataFrame:
    """Rows repeated per (feature, repeat) with that feature's values permuted inside the scope.

    The permutation pairs the row order with a seeded order of MD5 hashes by an equi-join on position. Only keys and values are repeated
    before it. Hashes are even whatever the keys, so equal ranges of them, counted once, carry the positions of a large scope over.
    """
    values = F.array(*[F.col(f).cast("double") for f in features])
    kept = [c for c in rows.columns if c not in features and c != "sequence_index"]
    base = settled(rows.select(*kept, values.alias("_x")))
    copies = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(i).alias("_slot"), F.lit(r).alias("repeat")) for i, f in enumerate(features) for r in range(repeats)])
    many = base.select(scope, key, "_x", F.inline(copies)).select(scope, "feature", "_slot", "repeat", key, F.get("_x", F.col("_slot")).alias("_v"))
    groups = [scope, "feature", "_slot", "repeat"]
    digest = F.md5(F.concat_ws(":", F.lit(seed), "feature", "repeat", key))
    ranges = _hash_ranges(base, scope, split)
    if ranges == 1:
        donors = index_units(many.withColumn("_h", digest), groups, ["_h", key], split=False)
    else:
        spots = [*groups, "_range"]
        start = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
        dealt = many.withColumn("_range", F.floor(start * ranges / 2**32))
        earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        carried = dealt.groupBy(*spots).agg(F.count(F.lit(1)).alias("_n")).select(*spots, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_skipped"))
        # the hash is worked out again behind the shuffle instead of being sent
        placed = index_units(dealt.repartition(*spots).withColumn("_h", digest), spots, ["_h", key], split=False).drop("_h")
        donors = same_keys(placed, F.broadcast(carried), spots).withColumn("sequence_index", F.col("sequence_index") + F.col("_skipped"))
    swapped = [F.when(F.col("_slot") == i, F.col("_v")).otherwise(F.get("_x", F.lit(i))).alias(f) for i, f in enumerate(features)]
    joined = index_units(base, [scope], [key], split).join(donors.select(*groups, "sequence_index", "_v"), [scope, "sequence_index"])
    return joined.select(*kept, "feature", "repeat", *swapped)


def _hash_ranges(rows: DataFrame, scope: str, split: bool | None) -> int:
    """Into how many hash ranges of about `RANGE_ROWS` rows the largest scope falls; one for tiny sources."""
    if split is None and fits_one_task(rows, TINY) or split is False:
        return 1
    largest = rows.groupBy(scope).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    return max(1, -(-largest // RANGE_ROWS))


def importance_summary(coefficients: DataFrame, permutation: DataFrame) -> DataFrame:
    """Mean magnitudes of both importance views per feature, 0 where one lacks it."""
    a = coefficients.groupBy("feature").agg(F.avg("absolute_coefficient").alias("ridge_mean_absolute_coefficient"), F.countDistinct("fold").alias("ridge_fold_count"))
    b = permutation.groupBy("feature").agg(F.avg("importance_mean_macro_mae_increase").alias("permutation_mean_macro_mae_increase"), F.countDistinct("fold").alias("permutation_fold_count"))
    return a.join(b, "feature", "full_outer").na.fill(0)
