"""Causal degradation alarms and trailing trend features."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wearline.functions import signal as sg
from wearline.operators.scale import middle, percentiles, rolling_median, rows_back, trailing
from wearline.session import parameter_table

#: Reason of a unit without an alarm. Fixed value.
REJECTED = "persistence/effect/follow-up criteria not satisfied"
EPSILON = 1e-12
#: Detector grid. Fixed values.
BASELINES = (5, 10, 15)
WINDOWS = (1, 3, 5)
THRESHOLDS = (4.0, 6.0, 8.0)
PERSISTENCES = (3, 5)
AGGREGATIONS = ("mean", "maximum")
DIVERGENCES = ("symmetric_kl", "kl")
TREND_WINDOWS = (5, 10, 20)
MAXIMUM_GAP = 1
MINIMUM_POST = 10
MINIMUM_EFFECT = 4.0


def combine(a: Column, b: Column, how: str) -> Column:
    return F.greatest(a, b) if how == "maximum" else (a + b) / 2


def ewmas(df: DataFrame, unit: Sequence[str], value: str, spans: Mapping[str, int]) -> DataFrame:
    """Exponentially weighted means with s_0 = x_0 and s_t = a x_t + (1 - a) s_{t-1}, a = 2 / (span + 1); one column per span.

    A weight older than `reach` rows is below double precision, so a segment with that much history in front
    gives the recursion exactly; inside it the sum of growing weights is an ordinary running window. All spans share the segments.
    """
    plain = {n: F.col(value).cast("double") for n, k in spans.items() if k <= 1}
    rates = {n: -math.log1p(-2.0 / (k + 1)) for n, k in spans.items() if k > 1}
    df = df.withColumns(plain) if plain else df
    if not rates:
        return df
    reach = math.ceil(42 / min(rates.values()))
    segment = max(1, math.floor(500 / max(rates.values())))
    spot = F.col("sequence_index") - F.col("_segment") * segment

    def decayed(growth: float, alpha: float):
        weight = F.when(F.col("sequence_index") == 0, 1.0).otherwise(alpha) * F.exp(growth * spot)
        return lambda w: F.sum(weight * F.col(value)).over(w.rowsBetween(Window.unboundedPreceding, 0)) * F.exp(-growth * spot)

    return trailing(df, unit, reach, {n: decayed(g, 2.0 / (spans[n] + 1)) for n, g in rates.items()}, segment)


def ewma(df: DataFrame, unit: Sequence[str], value: str, span: int, name: str) -> DataFrame:
    return ewmas(df, unit, value, {name: span})


def causal_aggregate(df: DataFrame, unit: Sequence[str], value: str, window: int, method: str, name: str) -> DataFrame:
    """Trailing median or mean of `window` rows (fewer at the start), or the EWMA of that span."""
    if method == "ewma":
        return ewma(df, unit, value, window, name)
    make = {"median": lambda w: rolling_median(value, w, window), "mean": lambda w: F.avg(value).over(rows_back(w, window))}
    return trailing(df, unit, max(window - 1, 1), {name: make[method]})


def baseline_statistics(df: DataFrame, unit: Sequence[str], value: str, baselines: Sequence[int]) -> DataFrame:
    """Median and raw MAD of each unit's first rows, one row per unit and baseline length.

    Only the longest baseline's rows are read, a bounded number per unit.
    """
    i, v = F.col("sequence_index"), F.col("_v")
    early = df.where(i < max(baselines)).select(*unit, i, F.col(value).cast("double").alias("_v"))
    centers = percentiles(early, unit, {f"_c{b}": (F.when(i < b, v), 0.5) for b in baselines})
    spreads = percentiles(early.join(centers, list(unit)), unit, {f"_m{b}": (F.when(i < b, F.abs(v - F.col(f"_c{b}"))), 0.5) for b in baselines})
    listed = F.array(*[F.struct(F.lit(b).alias("baseline_acquisitions"), F.col(f"_c{b}").alias("baseline_median"), F.col(f"_m{b}").alias("baseline_mad")) for b in baselines])
    return centers.join(spreads, list(unit)).select(*unit, F.inline(listed))


def robust_normalize(df: DataFrame, unit: Sequence[str], value: str, baselines: Sequence[int], name: str = "normalized") -> DataFrame:
    """Rows repeated per baseline length, centred and scaled by that baseline."""
    joined = df.join(baseline_statistics(df, unit, value, baselines), list(unit))
    return joined.withColumn(name, (F.col(value) - F.col("baseline_median")) / F.greatest(F.col("baseline_mad"), F.lit(EPSILON)))


def trajectory(df: DataFrame, unit: Sequence[str], combined: str, baseline: int, window: int) -> DataFrame:
    """Aggregated and normalised series with the effective window and the calibration flag."""
    smooth = causal_aggregate(df, unit, combined, window, "median", "aggregated")
    return robust_normalize(smooth, unit, "aggregated", [baseline]).withColumns(
        {
            "effective_window": F.least(F.col("sequence_index") + 1, F.lit(window).cast("bigint")),
            "calibration_interval": F.col("sequence_index") < baseline,
            "causal_window": F.lit(window),
        }
    )


def own_baseline(df: DataFrame, keys: Sequence[str], value: str, name: str = "normalized") -> DataFrame:
    """Rows centred and scaled by the first `baseline_acquisitions` rows of their key, which holds one such number."""
    v = F.col(value).cast("double")
    early = df.where(F.col("sequence_index") < F.col("baseline_acquisitions")).select(*keys, v.alias("_v"))
    centers = percentiles(early, keys, {"baseline_median": (F.col("_v"), 0.5)})
    spreads = percentiles(early.join(centers, list(keys)), keys, {"baseline_mad": (F.abs(F.col("_v") - F.col("baseline_median")), 0.5)}, {"baseline_median": F.max("baseline_median")})
    return df.join(spreads, list(keys)).withColumn(name, (v - F.col("baseline_median")) / F.greatest(F.col("baseline_mad"), F.lit(EPSILON)))


def reference_vectors(df: DataFrame, unit: Sequence[str], vectors: Mapping[str, str], baselines: Sequence[int]) -> DataFrame:
    """Element-wise medians of each unit's first rows, renormalised: one row per unit with a column `<name>_<baseline>` per vector.

    Only the longest baseline's rows are read; all vectors and baselines share one pass.
    """
    i = F.col("sequence_index")
    listed = F.array(*[F.struct(F.lit(n).alias("name"), F.transform(c, lambda m: m.cast("double")).alias("vector")) for n, c in vectors.items()])
    early = df.where(i < max(baselines)).select(*unit, i, F.inline(listed)).select(*unit, i, "name", F.posexplode("vector").alias("bin", "mass"))
    keys = [*unit, "name"]
    middle = percentiles(early, [*keys, "bin"], {f"m{b}": (F.when(i < b, F.col("mass")), 0.5) for b in baselines})
    gathered = middle.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", *[f"m{b}" for b in baselines]))).alias("_v"))  # one element per bin

    def scaled(b: int) -> Column:
        masses = F.transform("_v", lambda z: z[f"m{b}"])
        return F.transform(masses, lambda m: (m / sg.array_sum(masses)).cast("float")).alias(f"r{b}")

    rows = gathered.select(*keys, *[scaled(b) for b in baselines])
    return rows.groupBy(*unit).agg(*[F.max(F.when(F.col("name") == n, F.col(f"r{b}"))).alias(f"{n}_{b}") for n in vectors for b in baselines])


def detector_series(
    df: DataFrame, unit: Sequence[str], levels: tuple[str, str], spectra: Mapping[str, tuple[str, str]], baselines: Sequence[int] = BASELINES, aggregations: Sequence[str] = AGGREGATIONS
) -> DataFrame:
    """The series detectors watch, one per (detector_family, channel_aggregation, baseline_acquisitions), in `combined`.

    Family `rms` takes the greater of two level columns. A family of `spectra` names the probability vectors of both channels; each
    acquisition diverges (symmetric) from its unit's own reference of every baseline, computed once and fed to all later settings.
    """
    vectors = {f"{family}_{c}": column for family, columns in spectra.items() for c, column in enumerate(columns)}
    joined = df.join(reference_vectors(df, unit, vectors, baselines), list(unit))
    staged = joined.withColumns({f"_{n}_{b}": sg.kl_divergence(F.col(c), F.col(f"{n}_{b}"), symmetric=True) for n, c in vectors.items() for b in baselines})
    entry = lambda family, how, b, value: F.struct(F.lit(family).alias("detector_family"), F.lit(how).alias("channel_aggregation"), F.lit(b).alias("baseline_acquisitions"), value.alias("combined"))
    listed = [entry("rms", "maximum", b, combine(F.col(levels[0]), F.col(levels[1]), "maximum")) for b in baselines]
    listed += [entry(f, how, b, combine(F.col(f"_{f}_0_{b}"), F.col(f"_{f}_1_{b}"), how)) for f in spectra for b in baselines for how in aggregations]
    return staged.select(*unit, "sequence_index", "total_acquisitions", "elapsed_minutes", "rul_minutes", F.inline(F.array(*listed)))


SERIES = ["detector_family", "channel_aggregation", "baseline_acquisitions"]


def grid_trajectories(series: DataFrame, unit: Sequence[str], windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Normalised series of `detector_series` for every trailing window; all windows share one pass."""
    keys = [*unit, *SERIES]
    smooth = trailing(series, keys, max(max(windows) - 1, 1), {f"_w{k}": lambda w, k=k: rolling_median("combined", w, k) for k in windows})
    levels = F.array(*[F.struct(F.lit(k).alias("causal_window"), F.col(f"_w{k}").alias("aggregated")) for k in windows])
    return own_baseline(smooth.select("*", F.inline(levels)).drop(*[f"_w{k}" for k in windows]), [*keys, "causal_window"], "aggregated")


def candidate_ids(spark: SparkSession, families: Sequence[str], baselines: Sequence[int] = BASELINES, aggregations: Sequence[str] = AGGREGATIONS, windows: Sequence[int] = WINDOWS, thresholds: Sequence[float] = THRESHOLDS, persistences: Sequence[int] = PERSISTENCES) -> DataFrame:
    """Every detector setting with its number from 1; `families` are those besides `rms`, which knows one aggregation."""
    names = [("rms", ("maximum",)), *[(f, aggregations) for f in families]]
    rows = [(f, b, a, w, float(t), p) for f, channels in names for b in baselines for a in channels for w in windows for t in thresholds for p in persistences]
    schema = "candidate_id int, detector_family string, baseline_acquisitions int, channel_aggregation string, causal_window int, threshold double, persistence int"
    return parameter_table(spark, [(i, *row) for i, row in enumerate(rows, 1)], schema)


def detector_grid(series: DataFrame, unit: Sequence[str], families: Sequence[str]) -> DataFrame:
    """Alarm of every unit under every setting, with the life it leaves and the setting's number."""
    keys = [*unit, *SERIES, "causal_window"]
    alarms = persistent_alarm(grid_trajectories(series, unit), keys, [(t, p) for t in THRESHOLDS for p in PERSISTENCES])
    ends = series.groupBy(*unit).agg(F.max("rul_minutes").alias("_last"))
    share = F.try_divide(F.col("alarm_confirmation_index").cast("double"), F.col("_last"))
    numbers = candidate_ids(series.sparkSession, families)
    return alarms.join(ends, list(unit)).join(numbers, [*SERIES, "causal_window", "threshold", "persistence"]).withColumns(
        {"consumed_life_fraction": share, "warning_fraction": F.coalesce(1 - share, F.lit(0.0)), "rul_at_alarm": F.col("_last") - F.col("alarm_confirmation_index")}
    ).drop("_last")


def persistent_alarm(
    df: DataFrame, keys: Sequence[str], settings: Sequence[tuple[float, int]], gap: int = MAXIMUM_GAP, minimum_post: int = MINIMUM_POST, effect: float = MINIMUM_EFFECT
) -> DataFrame:
    """First confirmed alarm per key and (threshold, persistence) setting, with the first crossing and its hits.

    `df` carries sequence_index, total_acquisitions, baseline_acquisitions and normalized. A row confirms when
    its trailing persistence + gap rows after the baseline hold enough crossings with a large enough median,
    and enough rows follow. All settings read the same few lagged values, so rows are not repeated per setting.
    """
    i, x = F.col("sequence_index"), F.col("normalized")
    reach = max(p for _, p in settings) + gap
    live = df.withColumn("_x", F.when(i >= F.col("baseline_acquisitions"), x))
    rows = trailing(live, keys, reach, {f"_x{j}": lambda w, j=j: F.lag("_x", j).over(w) for j in range(1, reach)})
    ready = (i >= F.col("baseline_acquisitions")) & (F.col("total_acquisitions") - 1 - i >= minimum_post)
    judged, aggregates, listed = {}, [], []
    for n, (threshold, persistence) in enumerate(settings):
        frame = [F.col("_x"), *[F.col(f"_x{j}") for j in range(1, persistence + gap)]]
        hits = sum((F.when(v > threshold, 1).otherwise(0) for v in frame), F.lit(0))
        level = middle([F.when(v > threshold, v) for v in frame])
        judged[f"_ok{n}"] = F.when(ready & (hits >= persistence) & (level >= effect), F.struct(i.alias("at"), hits.alias("hits")))
        aggregates += [F.min(F.when(F.col("_x") > threshold, i)).alias(f"_first{n}"), F.min(f"_ok{n}").alias(f"_ok{n}")]
        listed.append(
            F.struct(
                F.lit(float(threshold)).alias("threshold"), F.lit(int(persistence)).alias("persistence"), F.col(f"_first{n}").alias("first_threshold_crossing_index"),
                F.col(f"_ok{n}.at").alias("alarm_confirmation_index"), F.coalesce(F.col(f"_ok{n}.hits"), F.lit(0)).cast("bigint").alias("persistence_duration"),
            )
        )
    out = rows.withColumns(judged).groupBy(*keys).agg(*aggregates).select(*keys, F.inline(F.array(*listed)))
    found = F.col("alarm_confirmation_index").isNotNull()
    return out.withColumns(
        {
            "detection_status": F.when(found, "detected").otherwise("not_detected"),
            "rejection_reasons": F.when(found, "").otherwise(REJECTED),
        }
    )


def detections(df: DataFrame, alarms: DataFrame, keys: Sequence[str], split: bool | None = None) -> DataFrame:
    """One row per key: alarm times, consumed life, baseline statistics, effect after the alarm."""
    at = F.col("alarm_confirmation_index")
    i = F.col("sequence_index")
    joined = df.join(alarms.select(*keys, "alarm_confirmation_index"), list(keys))
    rows = percentiles(
        joined, keys, {"post_alarm_robust_effect": (F.when(i >= at, F.col("normalized")), 0.5)},
        {
            "alarm_elapsed_minutes": F.max(F.when(i == at, F.col("elapsed_minutes"))), "rul_at_alarm": F.max(F.when(i == at, F.col("rul_minutes"))),
            "total_acquisitions": F.max("total_acquisitions"), "baseline_median": F.max("baseline_median"), "baseline_mad": F.max("baseline_mad"),
        },
        split,
    )
    last = (F.col("total_acquisitions") - 1).cast("double")
    return alarms.join(rows, list(keys)).withColumns(
        {
            "consumed_life_fraction": F.try_divide(at.cast("double"), last),
            "warning_fraction": F.coalesce(F.try_divide(last - at, last), F.lit(0.0)),
        }
    )


def rank_detectors(results: DataFrame, candidate: Sequence[str]) -> DataFrame:
    """Score every detector on validation units only and rank per fold, overall and inside its family.

    Score: coverage - 0.4 * alarms in the first tenth of life - 0.2 * alarms in the last tenth - 0.02 for smoothing.
    """
    hit = F.col("detection_status") == "detected"
    share = lambda c: F.avg(c.cast("double"))
    scored = results.where("subset = 'validation'").groupBy("fold", *candidate).agg(
        share(hit).alias("validation_coverage"),
        F.avg("warning_fraction").alias("validation_warning_fraction"),
        share(hit & (F.col("consumed_life_fraction") < 0.10)).alias("immediate_post_calibration_rate"),
        share(hit & (F.col("consumed_life_fraction") > 0.90)).alias("final_only_alarm_rate"),
    )
    score = (
        F.col("validation_coverage") - 0.4 * F.col("immediate_post_calibration_rate") - 0.2 * F.col("final_only_alarm_rate")
        - F.when(F.col("causal_window") > 1, 0.02).otherwise(0.0)
    )
    rated = scored.withColumn("selection_score", F.round(score, 9))
    order = [F.desc("selection_score"), F.desc("validation_coverage"), "causal_window", "candidate_id"]
    return rated.withColumns(
        {
            "overall_rank": F.row_number().over(Window.partitionBy("fold").orderBy(*order)),
            "family_rank": F.row_number().over(Window.partitionBy("fold", "detector_family").orderBy(*order)),
        }
    )


def family_summary(results: DataFrame) -> DataFrame:
    """Test coverage and warning time of each family's frozen winner."""
    hit = F.col("detection_status") == "detected"
    return results.where("subset = 'test'").groupBy("detector_family").agg(
        F.count(F.lit(1)).alias("test_units"), F.avg(hit.cast("double")).alias("coverage"),
        F.avg(F.when(hit, F.col("rul_at_alarm"))).alias("mean_rul_at_alarm"), F.avg("warning_fraction").alias("mean_warning_fraction"),
    )


def compare_onsets(causal: DataFrame, retrospective: DataFrame) -> DataFrame:
    """Lag in acquisitions of the causal alarm behind the retrospective onset."""
    joined = causal.join(retrospective.select("fold", "unit_id", "onset_status", "onset_index"), ["fold", "unit_id"], "left")
    return joined.withColumn("causal_minus_retrospective", F.col("alarm_confirmation_index") - F.col("onset_index"))


def alarm_sensitivity(results: DataFrame, keys: Sequence[str], split: bool | None = None) -> DataFrame:
    """Spread of a unit's alarm over the detector grid and the share of settings that alarm."""
    at = F.col("alarm_confirmation_index").cast("double")
    out = percentiles(
        results, keys, {"median_alarm": (at, 0.5), "alarm_q1": (at, 0.25), "alarm_q3": (at, 0.75)},
        {"detection_rate": F.avg((F.col("detection_status") == "detected").cast("double"))}, split,
    )
    return out.withColumn("alarm_iqr", F.col("alarm_q3") - F.col("alarm_q1"))


def trend_features(df: DataFrame, unit: Sequence[str], feature: str, baseline: int, windows: Sequence[int], strict_causal: bool = False) -> DataFrame:
    """Baseline difference and ratio, first difference and trailing mean, median, std, EWMA and slope per window.

    With `strict_causal` the two baseline columns are NULL until the calibration rows have passed.
    """
    wanted = {f"{feature}__first_difference": lambda w: F.coalesce(F.col(feature) - F.lag(feature).over(w), F.lit(0.0))}
    for k in windows:
        prefix = f"{feature}__w{k}"
        wanted[f"{prefix}_mean"] = lambda w, k=k: F.avg(feature).over(rows_back(w, k))
        wanted[f"{prefix}_median"] = lambda w, k=k: rolling_median(feature, w, k)
        wanted[f"{prefix}_std"] = lambda w, k=k: F.coalesce(F.stddev_pop(feature).over(rows_back(w, k)), F.lit(0.0))
        wanted[f"{prefix}_slope"] = lambda w, k=k: F.coalesce(F.regr_slope(F.col(feature), F.col("sequence_index").cast("double")).over(rows_back(w, k)), F.lit(0.0))
    rows = trailing(df, unit, max(max(windows) - 1, 1), wanted)
    rows = ewmas(rows, unit, feature, {f"{feature}__w{k}_ewma": k for k in windows})
    joined = rows.join(baseline_statistics(df, unit, feature, [baseline]), list(unit))
    known = F.col("sequence_index") >= baseline - 1 if strict_causal else F.lit(True)
    off = F.col(feature) - F.col("baseline_median")
    return joined.withColumns(
        {
            f"{feature}__baseline_difference": F.when(known, off),
            f"{feature}__baseline_robust_ratio": F.when(known, off / F.greatest(F.col("baseline_mad"), F.lit(EPSILON))),
        }
    ).drop("baseline_median", "baseline_mad", "baseline_acquisitions")


#: Column roles of the model tables. Fixed values.
ROLE_NAMES = {
    "target": ("duration_minutes", "event_observed", "rul_minutes", "true_time_to_failure_minutes"),
    "identifier": ("unit_id", "landmark_id", "fold", "subset", "acquisition_number"),
    "context": ("condition_id", "elapsed_minutes", "rotation_rpm", "radial_load_kn", "time_since_causal_onset", "sequence_index", "ts", "event_type"),
    "future_derived": ("total_acquisitions", "life_position", "life_stage", "onset_index"),
}


def column_roles(df: DataFrame) -> DataFrame:
    """Registry of every column with its role and how many rows hold a value; whatever is not listed is a causal feature."""
    named = {c: role for role, columns in ROLE_NAMES.items() for c in columns}
    counted = df.agg(*[F.count(f"`{c}`").alias(c) for c in df.columns])
    cells = [
        F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(named.get(f.name, "causal_feature")).alias("role"), F.col(f"`{f.name}`").alias("rows"))
        for f in df.schema.fields
    ]
    return counted.select(F.inline(F.array(*cells))).withColumn("forbidden", F.col("role").isin("target", "identifier", "future_derived"))
