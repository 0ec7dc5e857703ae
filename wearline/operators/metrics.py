"""Regression metrics of remaining-life predictions: per row group, unit, fold, model and region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.operators.manifest import life_position, life_stage
from wearline.operators.scale import percentiles, trailing

TRUTH, RAW, PREDICTED = "rul_minutes", "prediction_raw_minutes", "prediction_non_negative_minutes"
MODEL = ["experiment", "model"]
UNIT_KEYS = [*MODEL, "fold", "condition_id", "unit_id"]


def regression(truth: str = TRUTH, predicted: str = PREDICTED) -> dict[str, Column]:
    """MAE, RMSE, R2 (NULL for fewer than two rows or a constant truth) and signed error."""
    error = F.col(predicted) - F.col(truth)
    spread = F.count(F.lit(1)) * F.var_pop(truth)
    return {
        "mae": F.avg(F.abs(error)),
        "rmse": F.sqrt(F.avg(error * error)),
        "r2": F.when(F.max(truth) > F.min(truth), 1 - F.try_divide(F.sum(error * error), spread)),
        "signed_error": F.avg(error),
    }


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in columns.items()]


def with_violations(predictions: DataFrame, series: Sequence[str], predicted: str = PREDICTED) -> DataFrame:
    """Add `_rise`: how much the predicted remaining life grew since the unit's previous row (NULL on the first)."""
    return trailing(predictions, series, 1, {"_rise": lambda w: F.col(predicted) - F.lag(predicted).over(w)})


def violations() -> dict[str, Column]:
    up = F.col("_rise") > 0
    return {
        "monotonicity_violation_count": F.count_if(up),
        "monotonicity_violation_magnitude": F.coalesce(F.sum(F.when(up, F.col("_rise"))), F.lit(0.0)),
        "monotonicity_violation_rate": F.coalesce(F.try_divide(F.count_if(up).cast("double"), F.count("_rise").cast("double")), F.lit(0.0)),
    }


def unit_metrics(predictions: DataFrame) -> DataFrame:
    """Metrics of every unit with life-normalised errors, negative raw counts and monotonicity violations."""
    grouped = with_violations(predictions, UNIT_KEYS).groupBy(*UNIT_KEYS).agg(
        *_named(regression()), F.max(TRUTH).alias("_life"), F.count_if(F.col(RAW) < 0).alias("negative_raw_prediction_count"),
        F.count(F.lit(1)).alias("acquisition_count"), *_named(violations()),
    )
    return grouped.withColumns(
        {"normalized_mae": F.try_divide(F.col("mae"), F.col("_life")), "normalized_rmse": F.try_divide(F.col("rmse"), F.col("_life"))}
    ).drop("_life")


def grouped_metrics(predictions: DataFrame, by: Sequence[str]) -> DataFrame:
    return predictions.groupBy(*by).agg(
        *_named(regression()), F.count(F.lit(1)).alias("acquisition_count"), F.countDistinct("unit_id").alias("unit_count"),
        F.count_if(F.col(RAW) < 0).alias("negative_raw_prediction_count"),
    )


def grouping_sets(predictions: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """The same metrics for several groupings in one scan; columns outside a grouping are NULL."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    return predictions.groupingSets([[F.col(c) for c in s] for s in sets], *every).agg(
        *_named(regression()), F.count(F.lit(1)).alias("acquisition_count")
    )


def fold_metrics(units: DataFrame) -> DataFrame:
    """Unweighted means over units per model and fold."""
    return units.groupBy(*MODEL, "fold").agg(
        F.avg("mae").alias("macro_mae"), F.avg("rmse").alias("macro_rmse"), F.avg("r2").alias("macro_r2"),
        F.avg("normalized_mae").alias("macro_normalized_mae"), F.count(F.lit(1)).alias("test_unit_count"),
    )


def condition_metrics(predictions: DataFrame, units: DataFrame) -> DataFrame:
    """Row-weighted metrics per condition next to the unit means."""
    macro = units.groupBy(*MODEL, "condition_id").agg(F.avg("mae").alias("macro_mae"), F.avg("rmse").alias("macro_rmse"))
    return grouped_metrics(predictions, [*MODEL, "condition_id"]).join(macro, [*MODEL, "condition_id"], "left")


def model_comparison(predictions: DataFrame, units: DataFrame, folds: DataFrame, split: bool | None = None) -> DataFrame:
    """Global, unit-level and fold-level summary of every model, best macro MAE first."""
    rename = {c: f"global_{c}" for c in ("mae", "rmse", "r2", "signed_error")}
    mae = F.col("mae")
    macro = percentiles(
        units, MODEL, {"median_unit_mae": (mae, 0.5), "unit_mae_q1": (mae, 0.25), "unit_mae_q3": (mae, 0.75)},
        {
            "macro_mae": F.avg("mae"), "macro_rmse": F.avg("rmse"), "macro_normalized_mae": F.avg("normalized_mae"),
            "monotonicity_violation_rate": F.avg("monotonicity_violation_rate"),
        },
        split,
    )
    by_fold = folds.groupBy(*MODEL).agg(
        F.avg("macro_mae").alias("fold_macro_mae_mean"), F.stddev_samp("macro_mae").alias("fold_macro_mae_std"),
        F.avg("macro_rmse").alias("fold_macro_rmse_mean"), F.stddev_samp("macro_rmse").alias("fold_macro_rmse_std"),
    )
    return grouped_metrics(predictions, MODEL).withColumnsRenamed(rename).join(macro, MODEL).join(by_fold, MODEL).orderBy("macro_mae", *MODEL)


#: Regions of a prediction: no onset, before it, after it. Fixed values.
REGIONS = ("estimated onset not detected", "before estimated onset", "after estimated onset")


def annotate_posthoc(predictions: DataFrame, onsets: DataFrame) -> DataFrame:
    """Add the life stage and the region relative to the unit's retrospective onset."""
    joined = predictions.join(onsets.select("fold", "unit_id", "onset_status", "onset_index"), ["fold", "unit_id"], "left")
    region = (
        F.when(F.coalesce(F.col("onset_status"), F.lit("")) != "detected", REGIONS[0])
        .when(F.col("sequence_index") < F.col("onset_index"), REGIONS[1])
        .otherwise(REGIONS[2])
    )
    return joined.withColumns(
        {"estimated_onset_region": region, "life_stage": life_stage(life_position(F.col("sequence_index"), F.col("total_acquisitions")))}
    ).drop("onset_status", "onset_index")


def support_matched(baselines: DataFrame, candidates: DataFrame, keys: Sequence[str] = ("fold", "unit_id", "acquisition_number")) -> DataFrame:
    """Baseline metrics restricted to the keys each candidate experiment predicted."""
    held = candidates.select(F.col("experiment").alias("candidate_experiment"), *keys).distinct()
    matched = baselines.join(held, list(keys))
    by = ["candidate_experiment", *MODEL]
    per_unit = matched.groupBy(*by, "fold", "unit_id").agg(*_named(regression()))
    macro = per_unit.groupBy(*by).agg(F.avg("mae").alias("macro_mae"), F.avg("rmse").alias("macro_rmse"))
    return grouped_metrics(matched, by).join(macro, by)


def onset_coverage_issues(onsets: DataFrame, folds: DataFrame) -> DataFrame:
    """Test units without exactly one onset row in their fold."""
    tested = folds.where("subset = 'test'").select("fold", "unit_id")
    counted = onsets.groupBy("fold", "unit_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = F.coalesce(F.col("_n"), F.lit(0))
    return tested.join(counted, ["fold", "unit_id"], "left").where(rows != 1).select("fold", "unit_id", rows.alias("onset_rows"))


def input_column_issues(table: DataFrame, columns: Sequence[str], roles: DataFrame) -> DataFrame:
    """Model inputs that hold values in `table` although their role is target, identifier or future-derived, or that have no role."""
    counted = table.agg(*[F.count(c).alias(c) for c in columns])
    names = counted.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("rows")) for c in columns])))
    joined = names.where("rows > 0").join(roles, "column", "left")
    bad = F.col("role").isNull() | F.col("role").isin("target", "identifier", "future_derived")
    return joined.where(bad).select("column", F.coalesce("role", F.lit("unregistered")).alias("role"), "rows")
