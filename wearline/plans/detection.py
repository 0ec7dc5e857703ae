"""Causal detector and trend queries (survey rows M7-M18)."""

from pyspark.sql import functions as F

from wearline.functions import signal as sg
from wearline.functions.rounding import r6
from wearline.operators import detect as de
from wearline.operators import folds as fo
from wearline.plans.catalog import VIEWS, register
from wearline.plans.health import chosen_onsets, folds
from wearline.plans.rul import rounded
from wearline.plans.signals import FS, OVERLAP, SEGMENT
from wearline.session import cut
from wearline.sources.tables import UNIT, readings, signals

BASELINE, WINDOW, THRESHOLD, PERSISTENCE, GAP, POST, EFFECT = 10, 3, 1.0, 3, 1, 10, 1.0


def series(spark, sf, how="maximum"):
    return readings(spark, sf).withColumn("combined", de.combine(F.col("horizontal"), F.col("vertical"), how))


def primary(spark, sf):
    """Trajectories and alarms of the flagship detector."""
    rows = de.trajectory(series(spark, sf), UNIT, "combined", BASELINE, WINDOW)
    return rows, de.persistent_alarm(rows, UNIT, [(THRESHOLD, PERSISTENCE)], GAP, POST, EFFECT)


VIEWS["v_series"] = "SELECT *, greatest(horizontal, vertical) AS combined FROM v_readings"
VIEWS["v_aggregated"] = """
SELECT *, median(combined) OVER (PARTITION BY unit_id ORDER BY sequence_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS aggregated FROM v_series
"""
VIEWS["v_normal"] = """
SELECT a.*, center, mad, (aggregated - center) / greatest(mad, 1e-12) AS normalized FROM v_aggregated a
JOIN (SELECT unit_id, median(aggregated) FILTER (sequence_index < 10) AS center, mad(aggregated) FILTER (sequence_index < 10) AS mad FROM v_aggregated GROUP BY 1) USING (unit_id)
"""
VIEWS["v_alarm"] = """
SELECT unit_id, min(sequence_index) FILTER (hit) AS first_crossing, min(sequence_index) FILTER (ok) AS alarm, arg_min(hits, sequence_index) FILTER (ok) AS duration FROM (
  SELECT *, sequence_index >= 10 AND hits >= 3 AND level >= 1 AND total_acquisitions - 1 - sequence_index >= 10 AS ok FROM (
    SELECT *, count(*) FILTER (hit) OVER w AS hits, median(CASE WHEN hit THEN normalized END) OVER w AS level
    FROM (SELECT *, sequence_index >= 10 AND normalized > 1 AS hit FROM v_normal) WINDOW w AS (PARTITION BY unit_id ORDER BY sequence_index ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))) GROUP BY 1
"""


@register(
    "m7_causal_aggregate",
    """SELECT unit_id, sequence_index, round(aggregated, 6) + 0.0 AS by_median, round(avg(combined) OVER (PARTITION BY unit_id ORDER BY sequence_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) + 0.0 AS by_mean,
       round(list_reduce(list(combined) OVER (PARTITION BY unit_id ORDER BY sequence_index), lambda a, x: a * 0.8::DOUBLE + x * 0.2::DOUBLE), 6) + 0.0 AS by_ewma FROM v_aggregated""",
)
def causal_aggregate(spark, sf):
    rows = series(spark, sf)
    for method, window in (("median", 3), ("mean", 3), ("ewma", 9)):
        rows = de.causal_aggregate(rows, UNIT, "combined", window, method, f"by_{method}")
    return rounded(rows, ["unit_id", "sequence_index"], ["by_median", "by_mean", "by_ewma"])


@register(
    "m8_robust_normalize",
    "SELECT unit_id, sequence_index, round(least(greatest(normalized, -1e6), 1e6), 6) + 0.0 AS normalized, round(center, 6) + 0.0 AS baseline_median, round(mad, 6) AS baseline_mad FROM v_normal",
)
def robust_normalize(spark, sf):
    rows = de.trajectory(series(spark, sf), UNIT, "combined", BASELINE, WINDOW)
    bounded = F.least(F.greatest("normalized", F.lit(-1e6)), F.lit(1e6))  # a flat baseline divides by epsilon
    return rounded(rows.withColumn("normalized", bounded), ["unit_id", "sequence_index"], ["normalized", "baseline_median", "baseline_mad"])


@register(
    "m9_persistent_alarm",
    """SELECT unit_id, first_crossing AS first_threshold_crossing_index, alarm AS alarm_confirmation_index, coalesce(duration, 0) AS persistence_duration, CASE WHEN alarm IS NULL THEN 'not_detected' ELSE 'detected' END AS detection_status FROM v_alarm""",
)
def persistent_alarm(spark, sf):
    return primary(spark, sf)[1].select("unit_id", "first_threshold_crossing_index", "alarm_confirmation_index", "persistence_duration", "detection_status")


_DETECTED = """SELECT unit_id, alarm AS alarm_confirmation_index, max(elapsed_minutes) FILTER (sequence_index = alarm) AS alarm_elapsed_minutes, max(rul_minutes) FILTER (sequence_index = alarm) AS rul_at_alarm,
       round(alarm / (any_value(total_acquisitions) - 1)::DOUBLE, 6) AS consumed_life_fraction, round(coalesce((any_value(total_acquisitions) - 1 - alarm) / (any_value(total_acquisitions) - 1)::DOUBLE, 0), 6) AS warning_fraction,
       round(any_value(center), 6) + 0.0 AS baseline_median, round(any_value(mad), 6) AS baseline_mad, round(median(normalized) FILTER (sequence_index >= alarm), 6) + 0.0 AS post_alarm_robust_effect
       FROM v_normal JOIN v_alarm USING (unit_id) GROUP BY unit_id, alarm"""


@register("m10_detections", _DETECTED)
def detections(spark, sf):
    rows, alarms = primary(spark, sf)
    out = de.detections(rows, alarms, UNIT)
    return rounded(out, ["unit_id", "alarm_confirmation_index", "alarm_elapsed_minutes", "rul_at_alarm"], ["consumed_life_fraction", "warning_fraction", "baseline_median", "baseline_mad", "post_alarm_robust_effect"])


@register(
    "m11_detection_trajectories",
    """SELECT unit_id, sequence_index, round(combined, 6) AS combined, round(aggregated, 6) AS aggregated, least(sequence_index + 1, 3) AS effective_window, sequence_index < 10 AS calibration_interval FROM v_normal""",
)
def detection_trajectories(spark, sf):
    rows = de.trajectory(series(spark, sf), UNIT, "combined", BASELINE, WINDOW)
    return rounded(rows, ["unit_id", "sequence_index"], ["combined", "aggregated"], ["effective_window", "calibration_interval"])


#: Families that compare spectra, and the vectors of the two channels each reads.
SPECTRA = {"uniform_spectral_skl": ("horizontal_uniform", "vertical_uniform"), "mechanically_informed_spectral_skl": ("horizontal_shaft", "vertical_shaft")}


def acquisitions(spark, sf):
    """Signals with the level and both spectral distributions of each channel."""
    rows, shaft_hz = signals(spark, sf), (F.col("condition_id") + 10).cast("double")
    for c in ("horizontal", "vertical"):
        squares = F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
        rows = rows.withColumns(
            {
                f"{c}_rms": F.sqrt(squares / F.size(c)),
                f"{c}_uniform": sg.binned_distribution(F.col(c), F.lit(FS / 2), FS, SEGMENT, OVERLAP, 8),
                f"{c}_shaft": sg.binned_distribution(F.col(c), shaft_hz * 2.0, FS, SEGMENT, OVERLAP, 8),
            }
        )
    return rows.drop("signal", "horizontal", "vertical")


def grid_detections(spark, sf):
    """All 270 detectors on every unit: three families, series and baselines computed once for all settings."""
    rows = cut(acquisitions(spark, sf))  # spectra are read for the references and for the divergences
    return de.detector_grid(de.detector_series(rows, UNIT, ("horizontal_rms", "vertical_rms"), SPECTRA), UNIT, list(SPECTRA))


VIEWS["v_references"] = """
SELECT unit_id, channel, kind, base, k, CAST(CAST(m / sum(m) OVER (PARTITION BY unit_id, channel, kind, base) AS FLOAT) AS DOUBLE) AS q FROM (
  SELECT unit_id, channel, kind, base, k, median(CAST(mass AS DOUBLE)) AS m FROM v_binned JOIN v_signals USING (acquisition_number), (VALUES (5), (10), (15)) t(base) WHERE channel <> 'signal' AND sequence_index < base GROUP BY ALL)
"""
VIEWS["v_divergences"] = """
SELECT acquisition_number, channel, kind, base, (sum(a * ln(a / b)) + sum(b * ln(b / a))) / 2 AS d FROM (
  SELECT acquisition_number, channel, kind, base, p / sum(p) OVER w AS a, q / sum(q) OVER w AS b FROM (
    SELECT acquisition_number, channel, kind, base, greatest(CAST(mass AS DOUBLE), 1e-12) AS p, greatest(q, 1e-12) AS q FROM v_binned JOIN v_signals USING (acquisition_number) JOIN v_references USING (unit_id, channel, kind, k))
  WINDOW w AS (PARTITION BY acquisition_number, channel, kind, base)) GROUP BY ALL
"""
VIEWS["v_watched"] = """
SELECT condition_id, unit_id, sequence_index, total_acquisitions, s.* FROM v_signals JOIN (
  SELECT acquisition_number, 0 AS f, 'rms' AS family, 1 AS a, base, max(rms) AS combined FROM v_time, (VALUES (5), (10), (15)) t(base) WHERE channel <> 'signal' GROUP BY acquisition_number, base
  UNION ALL SELECT acquisition_number, CASE kind WHEN 'uniform' THEN 1 ELSE 2 END, CASE kind WHEN 'uniform' THEN 'uniform_spectral_skl' ELSE 'mechanically_informed_spectral_skl' END, a, base, CASE a WHEN 0 THEN avg(d) ELSE max(d) END
  FROM v_divergences, (VALUES (0), (1)) t(a) GROUP BY acquisition_number, kind, a, base) s USING (acquisition_number)
"""
VIEWS["v_grid_agg"] = """
SELECT * EXCLUDE (m3, m5), CASE w WHEN 1 THEN combined WHEN 3 THEN m3 ELSE m5 END AS aggregated FROM (
  SELECT *, median(combined) OVER (PARTITION BY unit_id, family, a, base ORDER BY sequence_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m3,
         median(combined) OVER (PARTITION BY unit_id, family, a, base ORDER BY sequence_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m5 FROM v_watched), (VALUES (1), (3), (5)) t(w)
"""
VIEWS["v_grid_normal"] = """
SELECT g.*, (aggregated - center) / greatest(mad, 1e-12) AS x FROM v_grid_agg g
JOIN (SELECT unit_id, family, a, base, w, median(aggregated) FILTER (sequence_index < base) AS center, mad(aggregated) FILTER (sequence_index < base) AS mad FROM v_grid_agg GROUP BY ALL) USING (unit_id, family, a, base, w)
"""
VIEWS["v_grid_alarm"] = """
SELECT unit_id, condition_id, family, base AS b, w, thr, per, any_value(total_acquisitions) AS n, min(sequence_index) FILTER (ok) AS alarm,
       CAST(1 + CASE f WHEN 0 THEN 0 WHEN 1 THEN 54 ELSE 162 END + (((CASE f WHEN 0 THEN base // 5 - 1 ELSE (base // 5 - 1) * 2 + a END * 3 + (w - 1) // 2) * 3 + (thr - 4) // 2) * 2 + (per - 3) // 2) AS INTEGER) AS candidate_id
FROM (SELECT *, sequence_index >= base AND total_acquisitions - 1 - sequence_index >= 10 AND CASE per WHEN 3 THEN h3 >= 3 AND l3 >= 4 ELSE h5 >= 5 AND l5 >= 4 END AS ok FROM (
  SELECT *, count(*) FILTER (hit) OVER w3 AS h3, median(CASE WHEN hit THEN x END) OVER w3 AS l3, count(*) FILTER (hit) OVER w5 AS h5, median(CASE WHEN hit THEN x END) OVER w5 AS l5
  FROM (SELECT *, sequence_index >= base AND x > thr AS hit FROM v_grid_normal, (VALUES (4), (6), (8)) t(thr), (VALUES (3), (5)) p(per))
  WINDOW w3 AS (PARTITION BY unit_id, family, a, base, w, thr, per ORDER BY sequence_index ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), w5 AS (PARTITION BY unit_id, family, a, base, w, thr, per ORDER BY sequence_index ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)))
GROUP BY unit_id, condition_id, f, family, a, base, w, thr, per
"""
VIEWS["v_signal_folds"] = """
SELECT CAST(f.fold AS INTEGER) AS fold, unit_id, CASE WHEN (pos - f.fold + 5) % 5 = 0 THEN 'test' WHEN (pos - f.fold + 5) % 5 = 1 THEN 'validation' ELSE 'train' END AS subset
FROM (SELECT *, (row_number() OVER (PARTITION BY condition_id ORDER BY unit_id) - 1) % 5 AS pos FROM (SELECT DISTINCT condition_id, unit_id FROM v_signals)), range(5) f(fold)
"""
VIEWS["v_grid_rank"] = """
SELECT *, CAST(row_number() OVER (PARTITION BY fold ORDER BY score DESC, coverage DESC, w, candidate_id) AS INTEGER) AS overall_rank, CAST(row_number() OVER (PARTITION BY fold, family ORDER BY score DESC, coverage DESC, w, candidate_id) AS INTEGER) AS family_rank FROM (
  SELECT fold, family, w, candidate_id, avg((alarm IS NOT NULL)::INTEGER) AS coverage,
         round(avg((alarm IS NOT NULL)::INTEGER) - 0.4 * avg(coalesce(alarm / (v.n - 1)::DOUBLE < 0.1, false)::INTEGER) - 0.2 * avg(coalesce(alarm / (v.n - 1)::DOUBLE > 0.9, false)::INTEGER) - CASE WHEN w > 1 THEN 0.02 ELSE 0 END, 9) AS score
  FROM v_grid_alarm v JOIN v_signal_folds f USING (unit_id) WHERE subset = 'validation' GROUP BY 1, 2, 3, 4)
"""


@register("m12_detector_grid", "SELECT unit_id, candidate_id, alarm AS alarm_confirmation_index FROM v_grid_alarm")
def detector_grid(spark, sf):
    return grid_detections(spark, sf).select("unit_id", "candidate_id", "alarm_confirmation_index")


CANDIDATE = ["candidate_id", "detector_family", "baseline_acquisitions", "channel_aggregation", "causal_window", "threshold", "persistence"]


def ranked(spark, sf):
    results = cut(grid_detections(spark, sf))  # one row per unit and setting, read again by the frozen application
    plan = fo.rotate_folds(signals(spark, sf), 5).select("fold", "subset", "unit_id")
    return results.join(plan, "unit_id"), de.rank_detectors(results.join(plan, "unit_id"), CANDIDATE)


@register(
    "m13_rank_detectors",
    "SELECT fold, candidate_id, round(coverage, 6) AS validation_coverage, round(score, 6) + 0.0 AS selection_score, overall_rank, family_rank FROM v_grid_rank",
)
def rank_detectors(spark, sf):
    return rounded(ranked(spark, sf)[1], ["fold", "candidate_id"], ["validation_coverage", "selection_score"], ["overall_rank", "family_rank"])


@register(
    "m14_family_summary",
    """SELECT family AS detector_family, count(*) AS test_units, round(avg((alarm IS NOT NULL)::INTEGER), 6) AS coverage, round(avg(v.n - 1 - alarm), 6) AS mean_rul_at_alarm, round(avg(coalesce(1 - alarm / (v.n - 1)::DOUBLE, 0)), 6) AS mean_warning_fraction
       FROM v_grid_rank g JOIN v_grid_alarm v USING (candidate_id, family) JOIN v_signal_folds f ON f.unit_id = v.unit_id AND f.fold = g.fold WHERE family_rank = 1 AND subset = 'test' GROUP BY 1""",
)
def family_summary(spark, sf):
    results, ranks = ranked(spark, sf)
    frozen = results.join(ranks.where("family_rank = 1").select("fold", "candidate_id"), ["fold", "candidate_id"])
    return rounded(de.family_summary(frozen), ["detector_family", "test_units"], ["coverage", "mean_rul_at_alarm", "mean_warning_fraction"])


@register(
    "m15_causal_vs_retrospective",
    "SELECT fold, a.unit_id, alarm AS alarm_confirmation_index, CAST(hit_at AS BIGINT) AS onset_index, alarm - CAST(hit_at AS BIGINT) AS causal_minus_retrospective FROM v_alarm a JOIN v_onsets o ON o.unit_id = a.unit_id WHERE subset = 'test'",
)
def causal_vs_retrospective(spark, sf):
    tested = folds(spark, sf).where("subset = 'test'").select("fold", "unit_id")
    out = de.compare_onsets(primary(spark, sf)[1].join(tested, "unit_id"), chosen_onsets(spark, sf))
    return out.select("fold", "unit_id", "alarm_confirmation_index", "onset_index", "causal_minus_retrospective")


@register(
    "m16_alarm_sensitivity",
    "SELECT unit_id, median(alarm) AS median_alarm, quantile_cont(alarm, 0.25) AS alarm_q1, quantile_cont(alarm, 0.75) AS alarm_q3, quantile_cont(alarm, 0.75) - quantile_cont(alarm, 0.25) AS alarm_iqr, round(avg((alarm IS NOT NULL)::INTEGER), 6) AS detection_rate FROM v_grid_alarm GROUP BY 1",
)
def alarm_sensitivity(spark, sf):
    out = de.alarm_sensitivity(grid_detections(spark, sf), ["unit_id"])
    return out.withColumn("detection_rate", r6("detection_rate"))


_TREND_NAMES = [f"horizontal__w{k}_{s}" for k in de.TREND_WINDOWS for s in ("mean", "median", "std", "slope", "ewma")]


def _trend_sql():
    parts = ["round(horizontal - c, 6) + 0.0 AS baseline_difference", "round((horizontal - c) / greatest(m, 1e-12), 6) + 0.0 AS baseline_robust_ratio", "round(coalesce(horizontal - lag(horizontal) OVER o, 0), 6) + 0.0 AS first_difference"]
    for k in de.TREND_WINDOWS:
        a = 2.0 / (k + 1)
        parts += [
            f"round(avg(horizontal) OVER w{k}, 6) + 0.0 AS horizontal__w{k}_mean", f"round(median(horizontal) OVER w{k}, 6) + 0.0 AS horizontal__w{k}_median", f"round(stddev_pop(horizontal) OVER w{k}, 6) + 0.0 AS horizontal__w{k}_std",
            f"round(CASE WHEN sequence_index = 0 THEN 0 ELSE regr_slope(horizontal, sequence_index) OVER w{k} END, 6) + 0.0 AS horizontal__w{k}_slope",
            f"round(list_reduce(list(horizontal) OVER o, lambda s, x: s * {1 - a!r}::DOUBLE + x * {a!r}::DOUBLE), 6) + 0.0 AS horizontal__w{k}_ewma",
        ]
    windows = ", ".join(f"w{k} AS (PARTITION BY unit_id ORDER BY sequence_index ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in de.TREND_WINDOWS)
    return f"""SELECT unit_id, sequence_index, {', '.join(parts)} FROM v_readings JOIN (SELECT unit_id, median(horizontal) FILTER (sequence_index < 10) AS c, mad(horizontal) FILTER (sequence_index < 10) AS m FROM v_readings GROUP BY 1) USING (unit_id)
        WINDOW o AS (PARTITION BY unit_id ORDER BY sequence_index), {windows}"""


@register("m17_trend_features", _trend_sql())
def trend_features(spark, sf):
    rows = de.trend_features(readings(spark, sf), UNIT, "horizontal", BASELINE, de.TREND_WINDOWS)
    named = [r6(f"horizontal__{c}").alias(c) for c in ("baseline_difference", "baseline_robust_ratio", "first_difference")]
    return rows.select("unit_id", "sequence_index", *named, *[r6(c).alias(c) for c in _TREND_NAMES])


_ROLES = {
    "condition_id": "context", "unit_id": "identifier", "acquisition_number": "identifier", "ts": "context", "event_type": "context", "horizontal": "causal_feature", "vertical": "causal_feature",
    "sequence_index": "context", "total_acquisitions": "future_derived", "elapsed_minutes": "context", "rul_minutes": "target",
}


@register(
    "m18_column_roles",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{role}' AS role, {str(role in ('identifier', 'future_derived', 'target')).lower()} AS forbidden, count({c}) AS rows FROM v_readings""" for c, role in _ROLES.items()
    ),
)
def column_roles(spark, sf):
    return de.column_roles(readings(spark, sf)).select("column", "role", "forbidden", "rows")
