"""Unit-level fold plans, weights and deterministic resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.operators.scale import running, settled, with_totals

UNIT = ["condition_id", "unit_id"]


def rotate_folds(rows: DataFrame, k: int = 5, split: bool | None = None) -> DataFrame:
    """Rotating plan per condition: position p tests in fold p, validates in the fold before, else trains.

    Units, never rows, are split. More than `k` units per condition share positions round-robin.
    """
    units = rows.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("acquisitions"))
    placed = running(units, ["condition_id"], ["unit_id"], {"_nth": ("sum", F.lit(1).cast("bigint"))}, split)
    turn = F.pmod(F.col("_nth") - 1 - F.col("fold"), F.lit(k))
    return (
        placed.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        .withColumn("subset", F.when(turn == 0, "test").when(turn == 1, "validation").otherwise("train"))
        .select("fold", "subset", *UNIT, "acquisitions")
    )


def fold_issues(folds: DataFrame) -> DataFrame:
    """Broken plan rules: overlap, a unit not once in test and validation, a subset missing a condition."""
    per_unit = folds.groupBy(*UNIT).agg(
        F.count_if(F.col("subset") == "test").alias("tests"),
        F.count_if(F.col("subset") == "validation").alias("validations"),
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("fold").alias("folds"),
    )
    unit_codes = F.array_compact(
        F.array(
            F.when(F.col("rows") != F.col("folds"), F.lit("subsets_overlap")),
            F.when(F.col("tests") != 1, F.lit("not_tested_once")),
            F.when(F.col("validations") != 1, F.lit("not_validated_once")),
        )
    )
    unit_issues = per_unit.select(F.concat_ws("/", *UNIT).alias("path"), F.explode(unit_codes).alias("code"))
    conditions = folds.agg(F.countDistinct("condition_id").alias("all"))
    seen = folds.groupBy("fold", "subset").agg(F.countDistinct("condition_id").alias("n"))
    subset_issues = seen.join(conditions, seen["n"] < conditions["all"]).select(F.concat_ws("/", "fold", "subset").alias("path"), F.lit("condition_missing").alias("code"))
    return unit_issues.unionByName(subset_issues)


def fold_manifest(folds: DataFrame) -> DataFrame:
    """Units and acquisitions per fold, subset and condition."""
    return folds.groupBy("fold", "subset", "condition_id").agg(F.count(F.lit(1)).alias("units"), F.sum("acquisitions").alias("acquisitions"))


def unit_weights(df: DataFrame, scope: Sequence[str], unit: str = "unit_id", split: bool | None = None) -> DataFrame:
    """The weight of every unit's rows: equal total per unit and mean 1 inside each scope."""
    per_unit = settled(df.groupBy(*scope, unit).agg(F.count(F.lit(1)).alias("_rows")))
    sized = with_totals(per_unit, scope, {"_all": F.sum("_rows"), "_units": F.count(F.lit(1))}, split)
    weight = F.col("_all") / (F.col("_units") * F.col("_rows"))
    return sized.select(*scope, unit, weight.alias("sample_weight"))


def balanced_weights(df: DataFrame, scope: Sequence[str], unit: str = "unit_id", split: bool | None = None) -> DataFrame:
    """Inverse unit-frequency weights: equal total per unit and mean 1 inside each scope."""
    return df.join(unit_weights(df, scope, unit, split), [*scope, unit])


def effective_sample_size(df: DataFrame, scope: Sequence[str], weight: str = "sample_weight") -> DataFrame:
    return df.groupBy(*scope).agg((F.sum(weight) * F.sum(weight) / F.sum(F.col(weight) * F.col(weight))).alias("effective_sample_size"))


def equal_counts(df: DataFrame, scope: Sequence[str], unit: str, key: str, seed: int = 42, split: bool | None = None) -> DataFrame:
    """Every unit of a scope reduced to the smallest unit's row count, by a seeded order of MD5 hashes."""
    least = df.groupBy(*scope, unit).agg(F.count(F.lit(1)).alias("_n"))
    least = (least.groupBy(*scope) if scope else least.groupBy(F.lit(0).alias("_all"))).agg(F.min("_n").alias("_least"))
    hashed = df.withColumn("_draw", F.md5(F.concat_ws(":", F.lit(seed), F.col(key))))
    drawn = running(hashed, [*scope, unit], ["_draw", key], {"_nth": ("sum", F.lit(1).cast("bigint"))}, split)
    joined = drawn.join(least, list(scope)) if scope else drawn.withColumn("_all", F.lit(0)).join(least, "_all")
    return joined.where("_nth <= _least").select(*df.columns)


def even_picks(df: DataFrame, unit: Sequence[str], most: int = 100) -> DataFrame:
    """At most `most` rows per unit at evenly spaced indexes, rounded half to even.

    Each row decides for itself: it is picked when some spot rounds to its index. Needs
    `sequence_index` and `total_acquisitions`.
    """
    n, i = F.col("total_acquisitions"), F.col("sequence_index")
    m = F.least(n, F.lit(most))
    step = (n - 1) / F.greatest(m - 1, F.lit(1))
    near = F.floor(F.coalesce(F.try_divide(i.cast("double"), step), F.lit(0.0)))
    hit = F.lit(False)
    for shift in (-1, 0, 1):
        spot = near + shift
        hit = hit | ((spot >= 0) & (spot < m) & (F.bround((spot * (n - 1)).cast("double") / F.greatest(m - 1, F.lit(1))) == i))
    return df.where(hit)
