"""Trailing windows of acquisitions as model inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.operators.scale import rows_back, trailing


def build_sequences(df: DataFrame, unit: Sequence[str], features: Sequence[str], length: int) -> DataFrame:
    """One row per acquisition that has `length` rows of history: `steps` holds the trailing feature structs.

    A gap in `sequence_index` is an error. The window is bounded by `length`, so the arrays are too.
    """
    packed = F.struct(*[F.col(f).cast("double").alias(f) for f in features])
    windows = {
        "steps": lambda w: F.collect_list(packed).over(rows_back(w, length)),
        "_before": lambda w: F.lag("sequence_index").over(w),
    }
    rows = trailing(df, unit, max(length - 1, 1), windows)
    broken = F.col("_before").isNotNull() & (F.col("sequence_index") - F.col("_before") != 1)
    checked = F.when(broken, F.raise_error(F.lit("the trajectory has a gap")).cast("boolean")).otherwise(F.size("steps") == length)
    return rows.where(checked).drop("_before")


def flat_features(steps: str, features: Sequence[str], length: int) -> list:
    """The window as `length * features` columns, oldest step first."""
    return [F.col(steps)[k][f].alias(f"{f}_lag{length - 1 - k}") for k in range(length) for f in features]


def coverage(df: DataFrame, keys: Sequence[str], length: int) -> DataFrame:
    """How many rows of each unit can carry a window of `length`."""
    n = F.col("original_acquisitions")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("original_acquisitions")).select(
        *keys, F.lit(length).alias("sequence_length"), "original_acquisitions",
        F.greatest(n - length + 1, F.lit(0).cast("bigint")).alias("eligible_sequences"),
        F.least(F.lit(length - 1).cast("bigint"), n).alias("dropped_prefix"),
        (F.greatest(n - length + 1, F.lit(0).cast("bigint")) / n).alias("coverage_proportion"),
    )


def occluded(df: DataFrame, features: Sequence[str], steps: str = "steps") -> DataFrame:
    """Rows repeated per feature with that (scaled) feature set to 0 at every step, plus the intact row."""
    names = F.array(F.lit("none"), *[F.lit(f) for f in features])
    many = df.withColumn("occluded", F.explode(names))
    return many.withColumn(
        steps,
        F.transform(steps, lambda s: F.struct(*[F.when(F.col("occluded") == f, 0.0).otherwise(s[f]).alias(f) for f in features])),
    )
