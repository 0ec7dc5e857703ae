"""Trajectory quality and ranking queries (survey rows F)."""

from pyspark.sql import functions as F

from wearline.functions.rounding import r6
from wearline.operators import folds as fo
from wearline.operators import trajectory as tr
from wearline.operators.scale import unpivot
from wearline.plans.catalog import VIEWS, register
from wearline.sources.tables import UNIT, raw_readings, readings

CHANNELS = ["horizontal", "vertical"]
GRID = 100


def long_readings(spark, sf):
    return unpivot(readings(spark, sf), [*UNIT, "sequence_index", "total_acquisitions"], CHANNELS)


def members(rows):
    """Scope membership; `rows` need no order, so the raw readings do."""
    return tr.scopes(rows.select(*UNIT).distinct(), fo.rotate_folds(rows, 5))


VIEWS["v_scores"] = """
SELECT condition_id, unit_id, feature, coalesce(abs(up - down) / nullif(up + down, 0)::DOUBLE, 0) AS monotonicity, CAST(sign(up - down) AS INTEGER) AS trend_sign, rho AS spearman, abs(rho) AS spearman_abs,
       step / iqr AS fluctuation, up + down AS valid_differences, still AS tie_differences
FROM (SELECT condition_id, unit_id, feature, count(*) FILTER (d > 0) AS up, count(*) FILTER (d < 0) AS down, count(*) FILTER (d = 0) AS still, median(abs(d)) AS step,
             quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, corr(rk, sequence_index) AS rho
      FROM (SELECT *, value - lag(value) OVER (PARTITION BY unit_id, feature ORDER BY sequence_index) AS d,
                   rank() OVER (PARTITION BY unit_id, feature ORDER BY value) + (count(*) OVER (PARTITION BY unit_id, feature, value) - 1) / 2.0 AS rk FROM v_long) GROUP BY 1, 2, 3)
"""
VIEWS["v_members"] = """
SELECT unit_id, 'all' AS scope FROM v_units UNION ALL SELECT unit_id, 'condition_' || condition_id FROM v_units
UNION ALL SELECT unit_id, 'fold_' || fold FROM v_folds WHERE subset = 'train'
"""
VIEWS["v_grid"] = f"""
SELECT condition_id, unit_id, feature, g AS grid, lo.value + (x - floor(x)) * (hi.value - lo.value) AS value
FROM (SELECT condition_id, unit_id, g, g * (n - 1) / {GRID - 1}::DOUBLE AS x FROM v_units, range({GRID}) t(g)) u
JOIN v_long lo USING (condition_id, unit_id) JOIN v_long hi USING (condition_id, unit_id, feature)
WHERE lo.sequence_index = CAST(floor(x) AS BIGINT) AND hi.sequence_index = CAST(ceil(x) AS BIGINT)
"""
VIEWS["v_trendability"] = """
SELECT scope, feature, median(r) AS trendability, count(*) AS trendability_valid_pairs FROM (
  SELECT s.scope, a.feature, abs(corr(a.value, b.value)) AS r FROM v_grid a JOIN v_grid b ON a.feature = b.feature AND a.grid = b.grid AND a.unit_id < b.unit_id
  JOIN v_members s ON s.unit_id = a.unit_id JOIN v_members t ON t.unit_id = b.unit_id AND t.scope = s.scope GROUP BY s.scope, a.feature, a.unit_id, b.unit_id) GROUP BY 1, 2
"""
VIEWS["v_ends"] = """
SELECT condition_id, unit_id, feature, median(value) FILTER (sequence_index < greatest(1, ceil(total_acquisitions * 0.1::DOUBLE))) AS initial_median,
       median(value) FILTER (sequence_index >= total_acquisitions - greatest(1, ceil(total_acquisitions * 0.1::DOUBLE))) AS final_median FROM v_long GROUP BY 1, 2, 3
"""
VIEWS["v_prognosability"] = """
SELECT scope, feature, exp(-median(abs(final_median - mid)) / median(abs(final_median - initial_median))) AS prognosability FROM (
  SELECT *, median(final_median) OVER (PARTITION BY scope, feature) AS mid FROM v_ends JOIN v_members USING (unit_id)) GROUP BY 1, 2
"""
VIEWS["v_scope_scores"] = """
SELECT scope, feature, median(monotonicity) AS monotonicity, median(spearman) AS spearman, median(spearman_abs) AS spearman_abs, median(fluctuation) AS fluctuation,
       least(greatest(1 - (quantile_cont(spearman_abs, 0.75) - quantile_cont(spearman_abs, 0.25)), 0), 1) AS stability, count(DISTINCT unit_id) AS unit_count
FROM v_scores JOIN v_members USING (unit_id) GROUP BY 1, 2
"""
VIEWS["v_scored"] = """
SELECT scope, feature, monotonicity, trendability, prognosability, spearman_abs, stability, 0.2::DOUBLE * (
         coalesce((monotonicity - min(monotonicity) OVER w) / nullif(max(monotonicity) OVER w - min(monotonicity) OVER w, 0), 0)
       + coalesce((trendability - min(trendability) OVER w) / nullif(max(trendability) OVER w - min(trendability) OVER w, 0), 0)
       + coalesce((prognosability - min(prognosability) OVER w) / nullif(max(prognosability) OVER w - min(prognosability) OVER w, 0), 0)
       + coalesce((spearman_abs - min(spearman_abs) OVER w) / nullif(max(spearman_abs) OVER w - min(spearman_abs) OVER w, 0), 0)
       + coalesce((stability - min(stability) OVER w) / nullif(max(stability) OVER w - min(stability) OVER w, 0), 0)) AS composite
FROM v_scope_scores JOIN v_trendability USING (scope, feature) JOIN v_prognosability USING (scope, feature) WINDOW w AS (PARTITION BY scope)
"""


@register(
    "f1_trajectory_scores",
    """SELECT unit_id, feature, round(monotonicity, 6) AS monotonicity, trend_sign, round(spearman, 6) + 0.0 AS spearman, round(fluctuation, 6) AS fluctuation, valid_differences, tie_differences,
       true AS finite, CAST(0 AS BIGINT) AS missing_count FROM v_scores""",
)
def trajectory_scores(spark, sf):
    s = tr.unit_scores(long_readings(spark, sf))
    return s.select("unit_id", "feature", r6("monotonicity").alias("monotonicity"), "trend_sign", r6("spearman").alias("spearman"), r6("fluctuation").alias("fluctuation"),
                    "valid_differences", "tie_differences", "finite", "missing_count")


@register("f5_resample", "SELECT unit_id, feature, CAST(grid AS INTEGER) AS grid, round(value, 6) + 0.0 AS value FROM v_grid")
def resample(spark, sf):
    return tr.resample(long_readings(spark, sf), GRID).select("unit_id", "feature", "grid", r6("value").alias("value"))


@register("f6_trendability", "SELECT scope, feature, round(trendability, 6) AS trendability, trendability_valid_pairs FROM v_trendability")
def trendability(spark, sf):
    long = long_readings(spark, sf)
    out = tr.trendability(tr.resample(long, GRID), members(raw_readings(spark, sf)))
    return out.select("scope", "feature", r6("trendability").alias("trendability"), "trendability_valid_pairs")


@register("f7_prognosability", "SELECT scope, feature, round(prognosability, 6) AS prognosability FROM v_prognosability")
def prognosability(spark, sf):
    ends = tr.endpoint_medians(long_readings(spark, sf))
    return tr.prognosability(ends, members(raw_readings(spark, sf))).select("scope", "feature", r6("prognosability").alias("prognosability"))


@register(
    "f8_scope_scores",
    """SELECT scope, feature, round(monotonicity, 6) AS monotonicity, round(spearman, 6) + 0.0 AS spearman, round(spearman_abs, 6) AS spearman_abs, round(fluctuation, 6) AS fluctuation,
       round(stability, 6) AS stability, unit_count FROM v_scope_scores""",
)
def scope_scores(spark, sf):
    s = tr.scope_scores(tr.unit_scores(long_readings(spark, sf)), members(raw_readings(spark, sf)))
    names = ["monotonicity", "spearman", "spearman_abs", "fluctuation", "stability"]
    return s.select("scope", "feature", *[r6(n).alias(n) for n in names], "unit_count")


def scored_scopes(spark, sf):
    long, who = long_readings(spark, sf), members(raw_readings(spark, sf))
    return (
        tr.scope_scores(tr.unit_scores(long), who)
        .join(tr.trendability(tr.resample(long, GRID), who), ["scope", "feature"])
        .join(tr.prognosability(tr.endpoint_medians(long), who), ["scope", "feature"])
    )


@register(
    "f9_rank_features",
    """SELECT scope, feature, round(composite, 6) AS composite_score, place AS rank, place <= 1 AS selected FROM (
       SELECT *, CAST(row_number() OVER (PARTITION BY scope ORDER BY round(composite, 12) DESC, feature) AS INTEGER) AS place FROM v_scored)""",
)
def rank_features(spark, sf):
    ranked = tr.rank_features(scored_scopes(spark, sf), dict.fromkeys(tr.METRICS, 0.2), 1)
    return ranked.select("scope", "feature", r6("composite_score").alias("composite_score"), "rank", "selected")


@register(
    "f10_name_issues",
    """SELECT 'condition_' || condition_id AS scope, event_type AS feature, unnest(CASE WHEN event_type = 'error' THEN ['duplicate_name', 'forbidden_name'] WHEN event_type = 'signup' THEN ['duplicate_name', 'unknown_name']
       ELSE ['duplicate_name'] END) AS code FROM v_readings GROUP BY 1, 2""",
)
def name_issues(spark, sf):
    chosen = readings(spark, sf).select(F.concat(F.lit("condition_"), F.col("condition_id").cast("string")).alias("scope"), F.col("event_type").alias("feature"))
    return tr.name_issues(chosen, ["click", "view", "purchase", "error"], ["error"])
