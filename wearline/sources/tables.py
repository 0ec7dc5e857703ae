"""Mapping of stored tables onto the run-to-failure model: units, conditions, order, channels, signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.operators.manifest import add_life_targets
from wearline.operators.scale import groups_small, index_units

UNIT = ["condition_id", "unit_id"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Event rows as acquisitions: user = unit, value and props.k = the two channels."""
    return table(spark, folder, "events").select(
        (F.col("user_id") % 3 + 1).cast("bigint").alias("condition_id"),
        F.col("user_id").alias("unit_id"),
        F.col("event_id").alias("acquisition_number"),
        "ts",
        "event_type",
        F.col("value").alias("horizontal"),
        F.get_json_object("props", "$.k").cast("double").alias("vertical"),
    )


def readings(spark: SparkSession, folder: str, split: bool | None = None) -> DataFrame:
    """Ordered trajectories with elapsed and remaining minutes (one nominal minute per acquisition)."""
    raw = raw_readings(spark, folder)
    split = not groups_small(raw, UNIT) if split is None else split  # units are counted once for both steps
    ordered = index_units(raw, UNIT, ["ts", "acquisition_number"], split)
    return add_life_targets(ordered, UNIT, interval=1.0, split=split)


def halves(vector: str) -> list[Column]:
    """The two channels of a vector: its first half and the rest."""
    half = F.floor(F.size(vector) / 2).cast("int")
    return [F.slice(vector, F.lit(1), half).alias("horizontal"), F.slice(vector, half + 1, F.size(vector) - half).alias("vertical")]


def signals(spark: SparkSession, folder: str) -> DataFrame:
    """Vector rows as raw two-channel acquisitions: label = unit, halves of the vector = channels."""
    raw = table(spark, folder, "embeddings").select(
        (F.col("label") % 3 + 1).cast("bigint").alias("condition_id"),
        F.col("label").cast("bigint").alias("unit_id"),
        F.col("vec_id").alias("acquisition_number"),
        F.col("embedding").alias("signal"),
        *halves("embedding"),
    )
    return add_life_targets(index_units(raw, UNIT, ["acquisition_number"]), UNIT, interval=1.0)
