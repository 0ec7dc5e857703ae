"""Manifest, target, projection and filter queries (survey rows C)."""

from pyspark.sql import functions as F

from wearline.functions.rounding import r6
from wearline.operators import folds as fo
from wearline.operators import manifest as m
from wearline.operators.scale import unpivot
from wearline.plans.catalog import VIEWS, register
from wearline.sources.tables import UNIT, raw_readings, readings, table

VIEWS["v_manifest"] = """
SELECT condition_id, unit_id, acquisition_number, sequence_index, elapsed_minutes, total_acquisitions, rul_minutes,
       1950.0 + 150 * condition_id AS rotation_rpm, 13.0 - condition_id AS radial_load_kn FROM v_readings
"""


def context(df):
    """Operating context of the three regimes: 2100/2250/2400 rpm at 12/11/10 kN."""
    return df.withColumns({"rotation_rpm": 1950.0 + 150 * F.col("condition_id"), "radial_load_kn": 13.0 - F.col("condition_id")})


@register("c1_remaining_life", "SELECT unit_id, sequence_index, rul_minutes FROM v_readings")
def remaining_life(spark, sf):
    return readings(spark, sf).select("unit_id", "sequence_index", "rul_minutes")


@register(
    "c2_build_manifest",
    """SELECT CAST(condition_id AS BIGINT) AS condition_id, unit_id, concat_ws('/', condition_id, unit_id, acquisition_number) AS file_path,
       acquisition_number || '.csv' AS file_name, acquisition_number, sequence_index, elapsed_minutes, total_acquisitions, rul_minutes,
       CAST(1950.0 + 150 * condition_id AS DOUBLE) AS rotation_rpm, CAST(13.0 - condition_id AS DOUBLE) AS radial_load_kn, CAST(25600 AS DOUBLE) AS sampling_frequency_hz,
       coalesce(CASE WHEN event_type <> 'error' THEN CAST(vertical AS BIGINT) END, 0) AS sample_count,
       CASE WHEN event_type <> 'error' THEN 2 ELSE 0 END AS channel_count, coalesce(CASE WHEN event_type <> 'error' THEN CAST(vertical AS BIGINT) * 8 END, 0) AS file_size_bytes
       FROM v_readings""",
)
def build_manifest(spark, sf):
    path = F.concat_ws("/", "condition_id", "unit_id", "acquisition_number").alias("file_path")
    rows = readings(spark, sf)
    acquisitions = rows.select(*UNIT, path, F.concat(F.col("acquisition_number").cast("string"), F.lit(".csv")).alias("file_name"), "acquisition_number", "sequence_index")
    samples = F.col("vertical").cast("bigint")
    inspections = raw_readings(spark, sf).where("event_type <> 'error'").select(
        path, samples.alias("sample_count"), F.lit(2).alias("channel_count"), (samples * 8).alias("file_size_bytes")
    )
    conditions = context(spark.range(1, 4).withColumnRenamed("id", "condition_id")).withColumn("sampling_frequency_hz", F.lit(25600.0))
    return m.build_manifest(acquisitions, inspections, conditions, 1.0)


@register(
    "c3_unit_summary",
    """SELECT condition_id, unit_id, CAST(any_value(rotation_rpm) AS DOUBLE) AS rotation_rpm, CAST(any_value(radial_load_kn) AS DOUBLE) AS radial_load_kn, count(*) AS total_acquisitions,
       max(elapsed_minutes) AS duration_minutes, max(rul_minutes) AS initial_rul_minutes, min(rul_minutes) AS final_rul_minutes FROM v_manifest GROUP BY 1, 2""",
)
def unit_summary(spark, sf):
    return m.unit_summary(context(readings(spark, sf)), ["rotation_rpm", "radial_load_kn"])


_POSITION = "CASE WHEN total_acquisitions > 1 THEN CAST(sequence_index AS DOUBLE) / (total_acquisitions - 1) ELSE 0 END"


@register("c4_life_position", f"SELECT unit_id, sequence_index, round({_POSITION}, 6) AS life_position FROM v_readings")
def life_position(spark, sf):
    position = m.life_position(F.col("sequence_index"), F.col("total_acquisitions"))
    return readings(spark, sf).select("unit_id", "sequence_index", r6(position).alias("life_position"))


@register(
    "c5_life_stage",
    f"""SELECT condition_id, stage, count(*) AS n FROM (SELECT condition_id, CASE WHEN {_POSITION} < 0.33 THEN 'early' WHEN {_POSITION} < 0.66 THEN 'intermediate' ELSE 'late' END AS stage FROM v_readings) GROUP BY ALL""",
)
def life_stage(spark, sf):
    stage = m.life_stage(m.life_position(F.col("sequence_index"), F.col("total_acquisitions")))
    return readings(spark, sf).groupBy("condition_id", stage.alias("stage")).agg(F.count("*").alias("n"))


@register(
    "c6_keep_units",
    "SELECT unit_id, acquisition_number FROM v_readings WHERE unit_id IN (SELECT unit_id FROM v_folds WHERE fold = 0 AND subset = 'train')",
)
def keep_units(spark, sf):
    rows = raw_readings(spark, sf)
    return m.keep_units(rows, fo.rotate_folds(rows, 5).where("fold = 0 AND subset = 'train'")).select("unit_id", "acquisition_number")


@register("c7_label_subset", "SELECT fold, subset, r.unit_id, r.acquisition_number FROM v_readings r JOIN v_folds f USING (unit_id)")
def label_subset(spark, sf):
    rows = raw_readings(spark, sf)
    return m.label_subset(rows, fo.rotate_folds(rows, 5)).select("fold", "subset", "unit_id", "acquisition_number")


@register("c8_feature_columns", "SELECT unit_id, horizontal AS horizontal_level, vertical AS vertical_level FROM v_readings")
def feature_columns(spark, sf):
    rows = readings(spark, sf).withColumnsRenamed({"horizontal": "horizontal_level", "vertical": "vertical_level"})
    safe = m.drop_future(rows, ["rul_minutes", "total_acquisitions", "not_there"])
    return safe.select("unit_id", *m.feature_columns(safe))


@register(
    "c9_prediction_diagnostics",
    """SELECT unit_id, sequence_index, raw AS prediction_raw_minutes, greatest(raw, 0) AS prediction_non_negative_minutes, raw < 0 AS raw_prediction_negative,
       greatest(raw, 0) - rul_minutes AS error_minutes, abs(greatest(raw, 0) - rul_minutes) AS absolute_error_minutes, (greatest(raw, 0) - rul_minutes) ** 2 AS squared_error_minutes2
       FROM (SELECT *, 50.0::DOUBLE - sequence_index AS raw FROM v_readings)""",
)
def prediction_diagnostics(spark, sf):
    rows = readings(spark, sf).select("unit_id", "sequence_index", "rul_minutes", (50.0 - F.col("sequence_index")).alias("prediction_raw_minutes"))
    return m.prediction_diagnostics(rows).drop("rul_minutes")


@register("c10_composite_key", "SELECT concat_ws('|', condition_id, unit_id, acquisition_number) AS row_key FROM v_readings")
def composite_key(spark, sf):
    return raw_readings(spark, sf).select(m.composite_key(*UNIT, "acquisition_number").alias("row_key"))


@register(
    "c11_wide_long",
    """SELECT unit_id, feature, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'error'), 6) AS error, round(avg(value) FILTER (event_type = 'view'), 6) AS view
       FROM (SELECT unit_id, event_type, 'horizontal' AS feature, horizontal AS value FROM v_readings UNION ALL SELECT unit_id, event_type, 'vertical', vertical FROM v_readings) GROUP BY 1, 2""",
)
def wide_long(spark, sf):
    long = unpivot(raw_readings(spark, sf), ["unit_id", "event_type"], ["horizontal", "vertical"])
    types = ["click", "error", "view"]
    wide = m.pivot_values(long, ["unit_id", "feature"], "event_type", types, "value")
    return wide.select("unit_id", "feature", *[r6(t).alias(t) for t in types])


@register("c12_frequency_top", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 15")
def frequency_top(spark, sf):
    return m.frequency_top(table(spark, sf, "part"), "p_brand")
