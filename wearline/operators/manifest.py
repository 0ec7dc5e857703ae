"""Manifest, target and simple projections of acquisition tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.operators.scale import with_totals

#: Left-closed life-stage boundaries. Fixed values.
LIFE_STAGES = (0.33, 0.66)

MANIFEST_TYPES = {
    "condition_id": "bigint",
    "unit_id": "bigint",
    "file_path": "string",
    "file_name": "string",
    "acquisition_number": "bigint",
    "sequence_index": "bigint",
    "elapsed_minutes": "double",
    "total_acquisitions": "bigint",
    "rul_minutes": "double",
    "rotation_rpm": "double",
    "radial_load_kn": "double",
    "sampling_frequency_hz": "double",
    "sample_count": "bigint",
    "channel_count": "int",
    "file_size_bytes": "bigint",
}


def remaining_life(total: Column, index: Column, interval: float) -> Column:
    """Remaining minutes of acquisition `index` out of `total`; bad arguments raise at run time."""
    if interval <= 0:
        raise ValueError("the acquisition interval must be positive")
    valid = (total > 0) & (index >= 0) & (index < total)
    return F.when(valid, (total - 1 - index) * F.lit(float(interval))).otherwise(
        F.raise_error(F.lit("sequence index outside its trajectory")).cast("double")
    )


def add_life_targets(df: DataFrame, unit: Sequence[str], interval: float, split: bool | None = None) -> DataFrame:
    """Add `total_acquisitions`, `elapsed_minutes` and `rul_minutes` to an indexed table."""
    counted = with_totals(df, unit, {"total_acquisitions": F.count(F.lit(1))}, split)
    return counted.withColumns(
        {
            "elapsed_minutes": F.col("sequence_index") * F.lit(float(interval)),
            "rul_minutes": remaining_life(F.col("total_acquisitions"), F.col("sequence_index"), interval),
        }
    )


def build_manifest(
    acquisitions: DataFrame, inspections: DataFrame, conditions: DataFrame, interval: float
) -> DataFrame:
    """Typed manifest: acquisitions with their inspection (0 where absent) and condition context.

    `acquisitions` carries the unit, path and `sequence_index`; `inspections` is keyed by `file_path`;
    `conditions` by `condition_id`.
    """
    measured = acquisitions.join(
        inspections.select("file_path", "sample_count", "channel_count", "file_size_bytes"), "file_path", "left"
    ).fillna(0, ["sample_count", "channel_count", "file_size_bytes"])
    full = add_life_targets(measured, ["condition_id", "unit_id"], interval).join(conditions, "condition_id")
    return full.select(*[F.col(name).cast(kind).alias(name) for name, kind in MANIFEST_TYPES.items()])


def unit_summary(manifest: DataFrame, context: Sequence[str] = ()) -> DataFrame:
    """One row per unit: context, acquisition count, last elapsed time, remaining life at both ends."""
    return manifest.groupBy("condition_id", "unit_id").agg(
        *[F.min_by(c, "sequence_index").alias(c) for c in context],
        F.count(F.lit(1)).alias("total_acquisitions"),
        F.max("elapsed_minutes").alias("duration_minutes"),
        F.max("rul_minutes").alias("initial_rul_minutes"),
        F.min("rul_minutes").alias("final_rul_minutes"),
    )


def life_position(index: Column, total: Column) -> Column:
    """Normalised life t/(N-1), 0 for a single acquisition."""
    return F.coalesce(F.try_divide(index.cast("double"), (total - 1).cast("double")), F.lit(0.0))


def life_stage(position: Column, bounds: Sequence[float] = LIFE_STAGES) -> Column:
    return F.when(position < bounds[0], "early").when(position < bounds[1], "intermediate").otherwise("late")


def keep_units(df: DataFrame, units: DataFrame, keys: Sequence[str] = ("unit_id",)) -> DataFrame:
    """Rows whose unit is listed."""
    return df.join(units.select(*keys).distinct(), list(keys), "left_semi")


def label_subset(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Each row once per fold with its subset; a unit without a subset is an error."""
    plan = folds.groupBy("unit_id").agg(F.collect_list(F.struct("fold", "subset")).alias("_plan"))
    found = df.join(plan, "unit_id", "left").withColumn(
        "_plan", F.coalesce("_plan", F.raise_error(F.lit("unit missing from the fold plan")).cast("array<struct<fold:int,subset:string>>"))
    )
    return found.select(*df.columns, F.inline("_plan"))


def feature_columns(df: DataFrame, prefixes: Sequence[str] = ("horizontal_", "vertical_")) -> list[str]:
    return [c for c in df.columns if c.startswith(tuple(prefixes))]


def drop_future(df: DataFrame, forbidden: Sequence[str]) -> DataFrame:
    """Drop future-derived columns; absent ones are ignored."""
    return df.drop(*forbidden)


def prediction_diagnostics(df: DataFrame, raw: str = "prediction_raw_minutes", truth: str = "rul_minutes") -> DataFrame:
    """Keep the raw prediction; add the non-negative one and its error, absolute and squared error."""
    clipped = df.withColumn("prediction_non_negative_minutes", F.greatest(F.col(raw), F.lit(0.0)))
    error = F.col("prediction_non_negative_minutes") - F.col(truth)
    return clipped.withColumns(
        {
            "raw_prediction_negative": F.col(raw) < 0,
            "error_minutes": error,
            "absolute_error_minutes": F.abs(error),
            "squared_error_minutes2": error * error,
        }
    )


def composite_key(*parts: str) -> Column:
    return F.concat_ws("|", *[F.col(p).cast("string") for p in parts])


def pivot_values(df: DataFrame, index: Sequence[str], column: str, values: Sequence[str], value: str) -> DataFrame:
    """Wide form: one column per listed value, the mean of `value` inside each cell."""
    return df.groupBy(*index).pivot(column, list(values)).agg(F.avg(value))


def frequency_top(df: DataFrame, column: str, n: int = 15) -> DataFrame:
    """The `n` most frequent values, ties by name."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)


def with_literals(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})
