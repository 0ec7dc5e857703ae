"""Streaming queries (survey rows R) and file round trips (survey rows A)."""

from pyspark.sql import functions as F

from wearline.functions import signal as sg
from wearline.functions.rounding import r6
from wearline.operators import quality as q
from wearline.operators import signals as so
from wearline.plans.catalog import ORACLES, VIEWS, register
from wearline.plans.detection import BASELINE, EFFECT, GAP, PERSISTENCE, THRESHOLD, WINDOW, series
from wearline.plans.health import folds
from wearline.plans.rul import rounded
from wearline.plans.signals import BANDS, FS, OVERLAP, SEGMENT
from wearline.session import scratch
from wearline.sources import files, incremental
from wearline.sources.tables import UNIT, halves, raw_readings, readings, signals, table
from wearline.streaming import online


@register("r1_stream_features", ORACLES["e10_feature_rows"])
def stream_features(spark, sf):
    raw = online.table_stream(spark, sf, "embeddings", table(spark, sf, "embeddings").schema)
    rows = raw.select(F.col("vec_id").alias("acquisition_number"), *halves("embedding"))
    done = online.run_available(so.feature_rows(rows, ["acquisition_number"], ["horizontal", "vertical"], FS, SEGMENT, OVERLAP, BANDS), "features")
    names = [f"{c}_{n}" for c in ("horizontal", "vertical") for n in sg.feature_names(BANDS)]
    return rounded(done, ["acquisition_number"], names)


def replay(spark, sf, columns):
    """Readings written in hash order over several files, replayed one file per micro-batch."""
    out = scratch(spark, "replay")
    rows = series(spark, sf).select(*UNIT, "acquisition_number", "sequence_index", *columns)
    rows.repartition(4, "acquisition_number").write.parquet(out)
    return online.table_stream(spark, out, "part-", rows.schema)


VIEWS["v_live_alarm"] = """
SELECT unit_id, min(sequence_index) AS alarm, arg_min(hits, sequence_index) AS hits, arg_min(normalized, sequence_index) AS normalized FROM (
  SELECT *, count(*) FILTER (hit) OVER w AS hits, median(CASE WHEN hit THEN normalized END) OVER w AS level
  FROM (SELECT *, sequence_index >= 10 AND normalized > 1 AS hit FROM v_normal) WINDOW w AS (PARTITION BY unit_id ORDER BY sequence_index ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
WHERE sequence_index >= 10 AND hits >= 3 AND level >= 1 GROUP BY 1
"""


@register("r2_online_alarms", "SELECT unit_id, alarm AS alarm_confirmation_index, hits AS persistence_duration, round(normalized, 6) + 0.0 AS normalized FROM v_live_alarm")
def online_alarms(spark, sf):
    alarms = online.online_alarms(replay(spark, sf, ["combined"]), "combined", BASELINE, WINDOW, THRESHOLD, PERSISTENCE, GAP, EFFECT)
    return rounded(online.run_available(alarms, "alarms"), ["unit_id", "alarm_confirmation_index", "persistence_duration"], ["normalized"])


@register(
    "r3_online_trends",
    """SELECT unit_id, sequence_index, round(coalesce(horizontal - lag(horizontal) OVER o, 0), 6) + 0.0 AS first_difference, round(avg(horizontal) OVER w, 6) + 0.0 AS mean, round(median(horizontal) OVER w, 6) + 0.0 AS median, round(stddev_pop(horizontal) OVER w, 5) + 0.0 AS std,
       round(list_reduce(list(horizontal) OVER o, lambda s, x: s * (2.0::DOUBLE / 3) + x * (1.0::DOUBLE / 3)), 6) + 0.0 AS ewma, round(CASE WHEN sequence_index = 0 THEN 0 ELSE regr_slope(horizontal, sequence_index) OVER w END, 6) + 0.0 AS slope
       FROM v_readings WINDOW o AS (PARTITION BY unit_id ORDER BY sequence_index), w AS (PARTITION BY unit_id ORDER BY sequence_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def online_trends(spark, sf):
    trends = online.run_available(online.online_trends(replay(spark, sf, ["horizontal"]), "horizontal", 5), "trends")
    return rounded(trends, ["unit_id", "sequence_index"], ["first_difference", "mean", "median", "ewma", "slope"], [r6("std", 5).alias("std")])


@register("r4_deduplicated_stream", "SELECT unit_id, count(*) AS acquisitions, CAST(sum(acquisition_number) AS BIGINT) AS number_sum FROM v_readings GROUP BY 1")
def deduplicated_stream(spark, sf):
    """Every acquisition sent twice, in different micro-batches."""
    out = scratch(spark, "twice")
    rows = raw_readings(spark, sf).select("unit_id", "acquisition_number", F.col("ts").cast("timestamp").alias("ts"))
    for _ in range(2):
        rows.write.mode("append").parquet(out)
    stream = online.table_stream(spark, out, "part-", rows.schema)
    once = online.run_available(online.deduplicated(stream, ["unit_id", "acquisition_number"], "ts", "3650 days"), "once")
    return once.groupBy("unit_id").agg(F.count("*").alias("acquisitions"), F.sum("acquisition_number").alias("number_sum"))


_EPOCH = "CAST(floor(epoch({})) AS BIGINT)"


@register(
    "r5_tumbling_windows",
    f"SELECT unit_id, {_EPOCH.format('time_bucket(INTERVAL 6 HOUR, ts)')} AS window_start, count(*) AS n, round(avg(horizontal), 6) AS mean, max(horizontal) AS highest FROM v_readings GROUP BY 1, 2",
)
def tumbling_windows(spark, sf):
    rows = raw_readings(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = online.time_windows(rows, ["unit_id"], "ts", "horizontal", "6 hours")
    return out.select("unit_id", F.unix_timestamp("window_start").alias("window_start"), "n", r6("mean").alias("mean"), "highest")


@register(
    "r5_sliding_windows",
    f"""SELECT unit_id, {_EPOCH.format('time_bucket(INTERVAL 3 HOUR, ts)')} - 10800 * k AS window_start, count(*) AS n, round(avg(horizontal), 6) AS mean, max(horizontal) AS highest FROM v_readings, range(2) t(k) GROUP BY 1, 2""",
)
def sliding_windows(spark, sf):
    rows = raw_readings(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = online.time_windows(rows, ["unit_id"], "ts", "horizontal", "6 hours", "3 hours")
    return out.select("unit_id", F.unix_timestamp("window_start").alias("window_start"), "n", r6("mean").alias("mean"), "highest")


@register(
    "r5_sessions",
    f"""SELECT unit_id, {_EPOCH.format('min(ts)')} AS window_start, count(*) AS n, round(avg(horizontal), 6) AS mean FROM (SELECT *, sum(fresh) OVER (PARTITION BY unit_id ORDER BY sequence_index) AS s FROM (
          SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY unit_id ORDER BY sequence_index) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM v_readings)) GROUP BY unit_id, s""",
)
def session_windows(spark, sf):
    rows = raw_readings(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = online.sessions(rows, ["unit_id"], "ts", "horizontal", "4 hours")
    return out.select("unit_id", F.unix_timestamp("window_start").alias("window_start"), "n", r6("mean").alias("mean"))


def acquisition_files(spark, sf):
    """Signals written as headered two-channel CSV text below <condition>/<unit>/, one file per unit and task."""
    out = scratch(spark, "raw")
    pairs = signals(spark, sf).select(*UNIT, "acquisition_number", F.posexplode(F.arrays_zip("horizontal", "vertical")).alias("i", "z"))
    lines = pairs.select(*UNIT, F.col("z.horizontal").alias(files.CHANNELS[0]), F.col("z.vertical").alias(files.CHANNELS[1]))
    lines.repartition("unit_id").write.partitionBy(*UNIT).option("header", True).csv(out)
    return out


@register("a1_file_inventory", "SELECT condition_id, CAST(unit_id AS BIGINT) AS unit_id, true AS has_bytes FROM v_signals GROUP BY 1, 2")
def file_inventory(spark, sf):
    found = files.inventory(spark, acquisition_files(spark, sf))
    unit = lambda name: F.regexp_extract("path", f"{name}=([0-9]+)", 1).cast("bigint")
    return found.select(unit("condition_id").alias("condition_id"), unit("unit_id").alias("unit_id"), (F.col("length") > 0).alias("has_bytes"))


@register(
    "a3_csv_scan",
    """SELECT unit_id, count(*) AS samples, round(sum(h), 4) + 0.0 AS horizontal_sum, round(sum(v), 4) + 0.0 AS vertical_sum, CAST(0 AS BIGINT) AS corrupt
       FROM (SELECT unit_id, CAST(unnest(horizontal) AS DOUBLE) AS h, CAST(unnest(vertical) AS DOUBLE) AS v FROM v_signals) GROUP BY 1""",
)
def csv_scan(spark, sf):
    rows = files.samples(spark, acquisition_files(spark, sf)).withColumn("unit_id", F.regexp_extract("path", "unit_id=([0-9]+)", 1).cast("bigint"))
    h, v = (F.col(c).cast("double") for c in files.CHANNELS)
    return rows.groupBy("unit_id").agg(F.count("*").alias("samples"), r6(F.sum(h), 4).alias("horizontal_sum"), r6(F.sum(v), 4).alias("vertical_sum"), F.count("_corrupt").alias("corrupt"))


@register("a4_csv_inspection", "SELECT unit_id, CAST(2 AS INTEGER) AS channel_count, CAST(count(*) * 32 AS BIGINT) AS sample_count, CAST(0 AS INTEGER) AS nan_count, CAST(NULL AS VARCHAR) AS parse_error FROM v_signals GROUP BY 1")
def csv_inspection(spark, sf):
    found = files.inspect_files(spark, acquisition_files(spark, sf))
    return found.select(F.regexp_extract("path", "unit_id=([0-9]+)", 1).cast("bigint").alias("unit_id"), "channel_count", "sample_count", "nan_count", "parse_error")


@register("a7_json_manifest", "SELECT fold, subset, CAST(unit_id AS VARCHAR) AS unit_id FROM v_folds")
def json_manifest(spark, sf):
    """Fold plan written as JSON lines per fold and condition with nested unit lists, read back and exploded."""
    out = scratch(spark, "folds")
    lists = [F.collect_list(F.when(F.col("subset") == s, F.col("unit_id").cast("string"))).alias(s) for s in ("train", "validation", "test")]
    part = F.pmod(F.xxhash64("unit_id"), F.lit(64)).alias("_part")  # bounded lists however many units there are
    folds(spark, sf).groupBy("fold", "condition_id", part).agg(*lists).select(F.array(F.struct("fold", "train", "validation", "test")).alias("folds")).write.json(out)
    return files.folds_from_json(spark, out, multi_line=False)


@register("a8_gated_publish", "SELECT unit_id, count(*) AS n FROM v_readings GROUP BY 1")
def gated_publish(spark, sf):
    """A clean table is published; a table with errors leaves an empty result behind."""
    rows = readings(spark, sf).groupBy("unit_id").agg(F.count("*").alias("n"))
    clean = q.expect(rows, [("empty_unit", q.ERROR, F.col("n") < 1)])
    broken = q.expect(rows, [("short_unit", q.ERROR, F.col("n") < 1_000_000)])
    good, bad = scratch(spark, "good"), scratch(spark, "bad")
    if not incremental.publish(rows, clean, good) or incremental.publish(rows, broken, bad):
        raise AssertionError("the publishing gate decided wrongly")
    return spark.read.schema(rows.schema).parquet(good).unionByName(spark.read.schema(rows.schema).parquet(bad))


@register("a9_multi_format_sink", "SELECT kind, fold, count(*) AS n, CAST(sum(unit_id) AS BIGINT) AS unit_sum FROM v_folds, (VALUES ('parquet'), ('csv')) k(kind) GROUP BY 1, 2")
def multi_format_sink(spark, sf):
    out = scratch(spark, "sink")
    rows = folds(spark, sf)
    incremental.write_tables(rows, out, ["fold"])
    a = spark.read.schema(rows.schema).parquet(f"{out}/parquet").withColumn("kind", F.lit("parquet"))
    b = spark.read.schema(rows.schema).option("header", True).csv(f"{out}/csv").withColumn("kind", F.lit("csv"))
    return a.unionByName(b).groupBy("kind", "fold").agg(F.count("*").alias("n"), F.sum("unit_id").alias("unit_sum"))
