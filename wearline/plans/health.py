"""Fold, preprocessing, health-index and change-point queries (survey rows G and H)."""

from pyspark.sql import functions as F

from wearline.functions.rounding import r6
from wearline.operators import folds as fo
from wearline.operators import health as he
from wearline.operators import scaling as sc
from wearline.operators.scale import unpivot
from wearline.plans.catalog import VIEWS, register
from wearline.plans.trajectory import GRID, long_readings
from wearline.session import cut
from wearline.sources import incremental
from wearline.sources.tables import UNIT, raw_readings, readings

FEATURES = ["horizontal_energy", "horizontal_mean", "vertical_mean", "vertical_rms"]


def folds(spark, sf):
    return fo.rotate_folds(raw_readings(spark, sf), 5)


def engineered(spark, sf):
    """Four named features per reading in long form."""
    rows = readings(spark, sf).withColumns(
        {
            "horizontal_mean": F.col("horizontal"),
            "horizontal_energy": F.col("horizontal") * F.col("horizontal"),
            "vertical_mean": F.col("vertical"),
            "vertical_rms": F.sqrt("vertical"),
        }
    )
    return unpivot(rows, [*UNIT, "sequence_index", "total_acquisitions"], FEATURES)


@register("g1_rotate_folds", "SELECT fold, subset, condition_id, unit_id, n AS acquisitions FROM v_folds")
def rotate_folds(spark, sf):
    return folds(spark, sf)


@register(
    "g2_fold_issues",
    """SELECT condition_id || '/' || unit_id AS path, code FROM (SELECT condition_id, unit_id, unnest(['subsets_overlap', 'not_tested_once']) AS code FROM v_units WHERE unit_id % 2 = 0)""",
)
def fold_issues(spark, sf):
    # a deliberately broken plan: even units test a second time in fold 9 and repeat a row
    plan = folds(spark, sf)
    extra = plan.where("unit_id % 2 = 0 AND subset = 'test'").select(F.lit(9).alias("fold"), "subset", *UNIT, "acquisitions")
    extra = extra.unionByName(extra.withColumn("subset", F.lit("train"))).unionByName(
        plan.where("subset = 'test' AND unit_id % 2 = 1").withColumns({"fold": F.lit(9), "subset": F.lit("train")})
    ).unionByName(plan.where("subset = 'validation'").select(F.lit(8).alias("fold"), F.lit("train").alias("subset"), *UNIT, "acquisitions"))
    return fo.fold_issues(plan.unionByName(extra)).where("code <> 'condition_missing'")


@register(
    "g3_fold_manifest",
    "SELECT fold, subset, condition_id, count(*) AS units, CAST(sum(n) AS BIGINT) AS acquisitions FROM v_folds GROUP BY 1, 2, 3",
)
def fold_manifest(spark, sf):
    return fo.fold_manifest(folds(spark, sf))


@register(
    "g4_frozen_plan",
    """SELECT count(*) AS row_count, CAST(sum(CAST(('0x' || substr(sha256(concat_ws(chr(31), CAST(condition_id AS VARCHAR), CAST(fold AS VARCHAR), subset, CAST(unit_id AS VARCHAR))), 1, 12)) AS BIGINT)) AS VARCHAR) AS fingerprint FROM v_folds""",
)
def frozen_plan(spark, sf):
    return incremental.fingerprint(folds(spark, sf), ["fold", "subset", *UNIT])


VIEWS["v_balanced"] = f"""
SELECT f.fold, condition_id, unit_id, feature, g AS grid, CASE WHEN feature IN ('horizontal_energy', 'vertical_rms') THEN ln(1 + raw) ELSE raw END AS value FROM (
  SELECT u.condition_id, u.unit_id, lo.feature, g, lo.value + (x - floor(x)) * (hi.value - lo.value) AS raw
  FROM (SELECT condition_id, unit_id, g, g * (n - 1) / {GRID - 1}::DOUBLE AS x FROM v_units, range({GRID}) t(g)) u
  JOIN v_engineered lo ON lo.unit_id = u.unit_id AND lo.sequence_index = CAST(floor(x) AS BIGINT)
  JOIN v_engineered hi ON hi.unit_id = u.unit_id AND hi.feature = lo.feature AND hi.sequence_index = CAST(ceil(x) AS BIGINT))
JOIN v_folds f USING (condition_id, unit_id) WHERE f.subset = 'train'
"""
VIEWS["v_engineered"] = """
SELECT unit_id, sequence_index, unnest(['horizontal_mean', 'horizontal_energy', 'vertical_mean', 'vertical_rms']) AS feature,
       unnest([horizontal, horizontal * horizontal, vertical, sqrt(vertical)]) AS value FROM v_readings
"""
VIEWS["v_balanced"] = VIEWS.pop("v_balanced")
VIEWS["v_robust"] = """
SELECT fold, feature, median(value) AS center, CASE WHEN quantile_cont(value, 0.75) = quantile_cont(value, 0.25) THEN 1 ELSE quantile_cont(value, 0.75) - quantile_cont(value, 0.25) END AS scale
FROM v_balanced GROUP BY 1, 2
"""


def balanced(spark, sf):
    rows = sc.balanced_rows(engineered(spark, sf), folds(spark, sf), GRID)
    return rows.withColumn("value", sc.log_mask(F.col("feature"), F.col("value")))


@register("g5_balanced_rows", "SELECT fold, unit_id, feature, CAST(grid AS INTEGER) AS grid, round(value, 6) + 0.0 AS value FROM v_balanced")
def balanced_rows(spark, sf):
    return balanced(spark, sf).select("fold", "unit_id", "feature", "grid", r6("value").alias("value"))


@register(
    "g6_log_mask",
    "SELECT unit_id, sequence_index, feature, round(CASE WHEN feature IN ('horizontal_energy', 'vertical_rms') THEN ln(1 + value) ELSE value END, 6) + 0.0 AS value FROM v_engineered",
)
def log_mask(spark, sf):
    value = sc.log_mask(F.col("feature"), F.col("value"))
    return engineered(spark, sf).select("unit_id", "sequence_index", "feature", r6(value).alias("value"))


@register(
    "g7_yeo_johnson",
    """WITH one AS (SELECT feature, lam, var_pop(CASE WHEN lam = 0 THEN ln(1 + value) ELSE ((value + 1) ** lam - 1) / lam END) AS v, sum(ln(1 + value)) AS j, count(*) AS n
                   FROM v_long, (SELECT round(-3 + k * 0.1::DOUBLE, 9) AS lam FROM range(61) t(k)) GROUP BY 1, 2),
       top AS (SELECT feature, arg_max(lam, -n / 2.0 * ln(v) + (lam - 1) * j) AS lam FROM one GROUP BY 1),
       two AS (SELECT feature, lam, var_pop(CASE WHEN lam = 0 THEN ln(1 + value) ELSE ((value + 1) ** lam - 1) / lam END) AS v, sum(ln(1 + value)) AS j, count(*) AS n
                   FROM v_long JOIN (SELECT feature, round(lam - 0.1 + k * 0.2::DOUBLE / 60, 9) AS lam FROM top, range(61) t(k)) USING (feature) GROUP BY 1, 2)
       SELECT feature, round(arg_max(lam, -n / 2.0 * ln(v) + (lam - 1) * j), 4) AS lambda FROM two GROUP BY 1""",
)
def yeo_johnson(spark, sf):
    return sc.yeo_johnson_lambdas(long_readings(spark, sf)).select("feature", r6("lambda", 4).alias("lambda"))


@register("g8_robust_parameters", "SELECT fold, feature, round(center, 6) AS center, round(scale, 6) AS scale FROM v_robust")
def robust_parameters(spark, sf):
    return sc.robust_parameters(balanced(spark, sf), ["fold"]).select("fold", "feature", r6("center").alias("center"), r6("scale").alias("scale"))


@register("g9_fit_scope", "SELECT fold, unit_id FROM v_folds WHERE subset = 'validation'")
def fit_scope(spark, sf):
    plan = folds(spark, sf)
    return sc.fit_scope_issues(plan.where("subset IN ('train', 'validation')"), plan)


def scaled_balanced(spark, sf):
    """The scaled rows of every fold's training units, written once: a fit reads them several times."""
    rows = balanced(spark, sf)
    scaled = sc.apply_scale(rows, sc.robust_parameters(rows, ["fold"]), ["fold"])
    return cut(sc.wide_rows(scaled, ["fold", *UNIT, "grid"], FEATURES))


def fitted(spark, sf):
    return sc.fit_pca(scaled_balanced(spark, sf), FEATURES, 3)


VIEWS["v_xy"] = """
SELECT fold, unit_id, grid, max(z) FILTER (feature = 'horizontal_energy') AS a, max(z) FILTER (feature = 'horizontal_mean') AS b, max(z) FILTER (feature = 'vertical_mean') AS c, max(z) FILTER (feature = 'vertical_rms') AS d
FROM (SELECT fold, unit_id, grid, feature, (value - center) / scale AS z FROM v_balanced JOIN v_robust USING (fold, feature)) GROUP BY 1, 2, 3
"""


@register(
    "g10_pca_variance",
    "SELECT fold, round(var_samp(a) + var_samp(b) + var_samp(c) + var_samp(d), 6) AS total_variance, true AS ratios_descend, true AS ratios_bounded FROM v_xy GROUP BY fold",
)
def pca_variance(spark, sf):
    """Total variance recovered from the fitted components: first eigenvalue / its explained ratio."""
    rows = scaled_balanced(spark, sf)
    table = sc.fit_pca(rows, FEATURES, 3)
    first = sc.project(rows, table.where("component = 0")).groupBy("fold").agg(F.var_samp("score").alias("top"))
    ratios = table.groupBy("fold").agg(
        F.max(F.when(F.col("component") == 0, F.col("explained"))).alias("r0"),
        F.max(F.when(F.col("component") == 1, F.col("explained"))).alias("r1"),
        F.sum("explained").alias("all"),
    )
    return first.join(ratios, "fold").select(
        "fold", r6(F.col("top") / F.col("r0")).alias("total_variance"), (F.col("r0") >= F.col("r1")).alias("ratios_descend"), (F.col("all") <= 1 + 1e-9).alias("ratios_bounded")
    )


@register("g11_pca_orientation")
def pca_orientation(spark, sf):
    return fitted(spark, sf).where("component = 0").select("fold", "orientation", r6("explained").alias("explained"))


@register(
    "g12_apply_scale",
    """SELECT fold, unit_id, sequence_index, feature, round((CASE WHEN feature IN ('horizontal_energy', 'vertical_rms') THEN ln(1 + value) ELSE value END - center) / scale, 6) + 0.0 AS scaled
       FROM v_engineered JOIN v_robust USING (feature)""",
)
def apply_scale(spark, sf):
    rows = engineered(spark, sf)
    every = rows.withColumn("value", sc.log_mask(F.col("feature"), F.col("value")))
    scaled = sc.apply_scale(every, sc.robust_parameters(balanced(spark, sf), ["fold"]), ["fold"])
    return scaled.select("fold", "unit_id", "sequence_index", "feature", r6("scaled").alias("scaled"))


VIEWS["v_weights"] = """
SELECT fold, unit_id, n, sum(n) OVER w / (count(*) OVER w * n::DOUBLE) AS weight FROM v_folds WHERE subset = 'train' WINDOW w AS (PARTITION BY fold)
"""


@register(
    "g13_balanced_weights",
    "SELECT fold, r.unit_id, r.sequence_index, round(weight, 6) AS sample_weight FROM v_readings r JOIN v_weights USING (unit_id)",
)
def balanced_weights(spark, sf):
    return weighted(spark, sf).select("fold", "unit_id", "sequence_index", r6("sample_weight").alias("sample_weight"))


def weighted(spark, sf):
    training = readings(spark, sf).join(folds(spark, sf).where("subset = 'train'").select("fold", "unit_id"), "unit_id")
    return fo.balanced_weights(training, ["fold"])


@register("g14_effective_sample_size", "SELECT fold, round(sum(n * weight) ** 2 / sum(n * weight * weight), 4) AS effective_sample_size FROM v_weights GROUP BY 1")
def effective_sample_size(spark, sf):
    return fo.effective_sample_size(weighted(spark, sf), ["fold"]).select("fold", r6("effective_sample_size", 4).alias("effective_sample_size"))


@register(
    "g15_equal_counts",
    "SELECT fold, unit_id, CAST(min(n) OVER (PARTITION BY fold) AS BIGINT) AS kept FROM v_folds WHERE subset = 'train'",
)
def equal_counts(spark, sf):
    training = raw_readings(spark, sf).join(folds(spark, sf).where("subset = 'train'").select("fold", "unit_id"), "unit_id")
    return fo.equal_counts(training, ["fold"], "unit_id", "acquisition_number").groupBy("fold", "unit_id").agg(F.count("*").alias("kept"))


@register(
    "g16_even_picks",
    """SELECT DISTINCT r.unit_id, r.sequence_index FROM v_readings r JOIN (SELECT unit_id, CAST(round_even(j * (n - 1) / greatest(least(n, 100) - 1, 1)::DOUBLE, 0) AS BIGINT) AS sequence_index
       FROM v_units, range(100) t(j) WHERE j < least(n, 100)) p USING (unit_id, sequence_index)""",
)
def even_picks(spark, sf):
    return fo.even_picks(readings(spark, sf), ["unit_id"]).select("unit_id", "sequence_index")


@register(
    "g17_weighted_target",
    """SELECT fold, round(any_value(c), 6) AS center, round(sqrt(sum(weight * (rul_minutes - c) ** 2) / sum(weight)), 6) AS scale FROM (
       SELECT fold, weight, rul_minutes, sum(weight * rul_minutes) OVER (PARTITION BY fold) / sum(weight) OVER (PARTITION BY fold) AS c FROM v_readings JOIN v_weights USING (unit_id)) GROUP BY 1""",
)
def weighted_target(spark, sf):
    return sc.weighted_target(weighted(spark, sf), ["fold"], "rul_minutes").select("fold", r6("center").alias("center"), r6("scale").alias("scale"))


VIEWS["v_centered"] = """
SELECT *, horizontal - c AS centered FROM v_readings JOIN (
  SELECT unit_id, greatest(5, CAST(ceil(total_acquisitions * 0.1::DOUBLE) AS BIGINT)) AS b, median(horizontal) FILTER (sequence_index < greatest(5, ceil(total_acquisitions * 0.1::DOUBLE))) AS c
  FROM v_readings GROUP BY unit_id, total_acquisitions) USING (unit_id)
"""
VIEWS["v_smooth"] = """
SELECT *, median(centered) OVER (PARTITION BY unit_id ORDER BY sequence_index ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS smoothed FROM v_centered
"""


def health_rows(spark, sf, window=7):
    rows = he.centred(readings(spark, sf), UNIT, "horizontal")
    return he.smoothed(rows, UNIT, "centered", window)


@register("h1_baseline_centering", "SELECT unit_id, sequence_index, b AS baseline_acquisitions, round(centered, 6) + 0.0 AS centered FROM v_centered")
def baseline_centering(spark, sf):
    return he.centred(readings(spark, sf), UNIT, "horizontal").select("unit_id", "sequence_index", "baseline_acquisitions", r6("centered").alias("centered"))


@register(
    "h2_trailing_smooth",
    """SELECT unit_id, sequence_index, round(smoothed, 6) + 0.0 AS by_median, round(avg(centered) OVER (PARTITION BY unit_id ORDER BY sequence_index ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) + 0.0 AS by_mean FROM v_smooth""",
)
def trailing_smooth(spark, sf):
    rows = he.smoothed(health_rows(spark, sf), UNIT, "centered", 7, "mean", "by_mean")
    return rows.select("unit_id", "sequence_index", r6("smoothed").alias("by_median"), r6("by_mean").alias("by_mean"))


@register(
    "h3_robust_scale",
    """SELECT unit_id, round(CASE WHEN mad(smoothed) = 0 THEN greatest(stddev_pop(smoothed), 2.220446049250313e-16) ELSE 1.4826 * mad(smoothed) END, 9) AS robust_scale FROM v_smooth WHERE sequence_index < b GROUP BY 1""",
)
def robust_scale(spark, sf):
    value = F.when(F.col("sequence_index") < F.col("baseline_acquisitions"), F.col("smoothed"))
    return he.robust_scale(health_rows(spark, sf), UNIT, value).select("unit_id", r6("robust_scale", 9).alias("robust_scale"))


def _settings(rows):
    values = {"minimum_segment_size": 5, "persistence_window": 5, "minimum_effect_size": 0.25}
    return rows.withColumns({k: F.lit(v) for k, v in values.items()})


#: The settings of a series' segmentation; the grid shares them among persistence windows.
PARTITIONS = [(c, p, m) for c in he.GRID["cost_model"] for p in he.GRID["penalty"] for m in he.GRID["minimum_segment_size"]]

for _window in he.GRID["smoothing_window"]:
    VIEWS[f"v_smooth_{_window}"] = f"""
SELECT condition_id, unit_id, sequence_index, total_acquisitions AS n, b, {_window} AS w,
       median(centered) OVER (PARTITION BY unit_id ORDER BY sequence_index ROWS BETWEEN {_window - 1} PRECEDING AND CURRENT ROW) AS smoothed FROM v_centered
"""
VIEWS["v_smooths"] = " UNION ALL ".join(f"SELECT * FROM v_smooth_{w}" for w in he.GRID["smoothing_window"])
VIEWS["v_scales"] = """
SELECT unit_id, w, greatest(CASE WHEN mad(smoothed) = 0 THEN stddev_pop(smoothed) ELSE 1.4826 * mad(smoothed) END, 2.220446049250313e-16) AS scale FROM v_smooths WHERE sequence_index < b GROUP BY 1, 2
"""
# costs of the stretches between two multiples of 5 (or the end); `a` and `e` count cells
VIEWS["v_spans"] = """
SELECT unit_id, w, n, a, e, least(5 * e, n) - 5 * a AS size FROM (SELECT DISTINCT unit_id, w, n FROM v_smooths), range(n) t(a), range(1, n + 1) u(e) WHERE a < e AND 5 * (e - 1) < n
"""
VIEWS["v_kernels"] = """
SELECT i.unit_id, i.w, i.sequence_index // 5 AS c, j.sequence_index // 5 AS d, sum(CASE WHEN i.sequence_index = j.sequence_index THEN 1 ELSE exp(-least(greatest((i.smoothed - j.smoothed) ** 2 * gamma, 0.01), 100)) END) AS k
FROM v_smooths i JOIN v_smooths j USING (unit_id, w)
JOIN (SELECT i.unit_id, i.w, CASE WHEN median((i.smoothed - j.smoothed) ** 2) = 0 THEN 1 ELSE 1 / median((i.smoothed - j.smoothed) ** 2) END AS gamma FROM v_smooths i JOIN v_smooths j ON i.unit_id = j.unit_id AND i.w = j.w AND i.sequence_index < j.sequence_index GROUP BY 1, 2) USING (unit_id, w)
GROUP BY ALL
"""
VIEWS["v_costs"] = """
SELECT unit_id, w, cost_model, e, list(cost ORDER BY a) AS costs FROM (
  SELECT unit_id, w, 'rbf' AS cost_model, a, e, size - sum(k) / size AS cost FROM v_spans s JOIN v_kernels USING (unit_id, w) WHERE c >= a AND c < e AND d >= a AND d < e GROUP BY unit_id, w, a, e, size
  UNION ALL SELECT unit_id, w, 'l2', a, e, sum(smoothed * smoothed) - sum(smoothed) ** 2 / size FROM v_spans s JOIN v_smooths USING (unit_id, w) WHERE sequence_index >= 5 * a AND sequence_index < 5 * e GROUP BY unit_id, w, a, e, size)
GROUP BY ALL
"""
# optimal partitioning with pruning: best costs and predecessors of every end, and the starts still alive
VIEWS["v_partitions"] = """
SELECT unit_id, w, cost_model, penalty, least, n, 0 AS k, [0.0::DOUBLE] AS f, [NULL::BIGINT] AS prev, []::BIGINT[] AS live
FROM (SELECT DISTINCT unit_id, w, n FROM v_smooths), (VALUES ('rbf'), ('l2')) m(cost_model), (VALUES (1::DOUBLE), (3), (5), (8)) p(penalty), (VALUES (5), (10)) l(least)
UNION ALL
SELECT unit_id, w, cost_model, penalty, least, n, k + 1, list_append(f, list_min(vals)), list_append(prev, cand[list_position(vals, list_min(vals))]), list_filter(cand, lambda t: f[t + 1] + costs[t + 1] <= list_min(vals))
FROM (SELECT *, list_transform(cand, lambda t: f[t + 1] + costs[t + 1] + penalty) AS vals FROM (
  SELECT p.*, costs, CASE WHEN stop < least THEN []::BIGINT[] WHEN f[(stop - least) // 5 + 1] IS NOT NULL AND NOT list_contains(live, (stop - least) // 5) THEN list_append(live, (stop - least) // 5) ELSE live END AS cand
  FROM (SELECT *, least(5 * (k + 1), n) AS stop FROM v_partitions) p JOIN v_costs c ON c.unit_id = p.unit_id AND c.w = p.w AND c.cost_model = p.cost_model AND c.e = p.k + 1))
"""
VIEWS["v_boundaries"] = """
SELECT unit_id, w, cost_model, penalty, least, prev, prev[k + 1] AS cell FROM v_partitions WHERE k = (n + 4) // 5
UNION ALL SELECT unit_id, w, cost_model, penalty, least, prev, prev[cell + 1] FROM v_boundaries WHERE cell > 0
"""


@register(
    "h4_change_points",
    "SELECT condition_id, unit_id, cost_model, penalty, CAST(least AS INTEGER) AS minimum_segment_size, 5 * cell AS boundary FROM v_boundaries JOIN v_units USING (unit_id) WHERE w = 7 AND cell > 0",
)
def change_points(spark, sf):
    found = he.change_points(cut(health_rows(spark, sf)), UNIT, PARTITIONS)
    return found.select(*UNIT, "cost_model", "penalty", "minimum_segment_size", "boundary")


@register(
    "h5_onset_rule",
    """WITH sc AS (SELECT unit_id, CASE WHEN mad(smoothed) = 0 THEN greatest(stddev_pop(smoothed), 2.220446049250313e-16) ELSE 1.4826 * mad(smoothed) END AS scale FROM v_smooth WHERE sequence_index < b GROUP BY 1),
       c AS (SELECT unit_id, any_value(total_acquisitions) AS n, any_value(b) AS b, unnest([10, 20, 30, 40]) AS boundary FROM v_smooth GROUP BY 1),
       m AS (SELECT c.unit_id, c.n, c.b, c.boundary, median(smoothed) FILTER (sequence_index < c.boundary) AS pre, median(smoothed) FILTER (sequence_index >= c.boundary) AS post, list(smoothed) FILTER (sequence_index >= c.boundary) AS tail
             FROM c JOIN v_smooth s ON s.unit_id = c.unit_id AND s.sequence_index BETWEEN c.boundary - 5 AND c.boundary + 4 GROUP BY 1, 2, 3, 4),
       ok AS (SELECT m.unit_id, boundary, pre, post, (post - pre) / scale AS effect FROM m JOIN sc USING (unit_id)
              WHERE boundary >= b AND n - boundary >= 5 AND (post - pre) / scale >= 0.25 AND len(list_filter(tail, lambda x: x > pre)) / 5.0 >= 0.7),
       best AS (SELECT unit_id, min(boundary) AS onset_index, arg_min(pre, boundary) AS pre, arg_min(post, boundary) AS post, arg_min(effect, boundary) AS effect FROM ok GROUP BY 1)
       SELECT u.unit_id, CASE WHEN onset_index IS NULL THEN 'not_detected' ELSE 'detected' END AS onset_status, CAST(onset_index AS BIGINT) AS onset_index, CAST(u.n - 1 - onset_index AS DOUBLE) AS rul_at_onset,
              round(pre, 6) + 0.0 AS pre_change_median, round(post, 6) + 0.0 AS post_change_median, round(effect, 6) + 0.0 AS robust_effect_size
       FROM v_units u LEFT JOIN best USING (unit_id)""",
)
def onset_rule(spark, sf):
    rows = _settings(cut(health_rows(spark, sf)))
    fixed = rows.where("sequence_index = 0").select(*UNIT, F.explode(F.array(*[F.lit(b).cast("bigint") for b in (10, 20, 30, 40)])).alias("boundary"))
    found = he.onsets(rows, fixed, UNIT)
    return found.select("unit_id", "onset_status", "onset_index", "rul_at_onset", *[r6(c).alias(c) for c in ("pre_change_median", "post_change_median", "robust_effect_size")])


@register(
    "h6_parameter_grid",
    """SELECT row_number() OVER (ORDER BY u.unit_id, a.i, p.i, s.i, m.i, w.i) - 1 - 96 * u.unit_id AS parameter_id, u.unit_id, a.v AS cost_model, p.v::DOUBLE AS penalty, s.v AS smoothing_window, m.v AS minimum_segment_size, w.v AS persistence_window
       FROM v_units u, (VALUES (0, 'rbf'), (1, 'l2')) a(i, v), (VALUES (0, 1), (1, 3), (2, 5), (3, 8)) p(i, v), (VALUES (0, 5), (1, 7), (2, 11)) s(i, v), (VALUES (0, 5), (1, 10)) m(i, v), (VALUES (0, 5), (1, 10)) w(i, v)""",
)
def parameter_grid(spark, sf):
    units = raw_readings(spark, sf).select("unit_id").distinct()
    return he.with_parameters(units, he.parameter_grid(spark)).drop("jump", "minimum_effect_size")


def sensitivity_rows(spark, sf):
    """Onsets of every unit under the whole grid; a series (unit and smoothing window) is smoothed and segmented once for all its settings."""
    base = he.centred(readings(spark, sf), UNIT, "horizontal")
    windows = he.GRID["smoothing_window"]
    for window in windows:
        base = he.smoothed(base, UNIT, "centered", window, name=f"smooth_{window}")
    series = F.explode(F.array(*[F.struct(F.lit(w).alias("smoothing_window"), F.col(f"smooth_{w}").alias("smoothed")) for w in windows])).alias("s")
    rows = cut(base.select(*UNIT, "sequence_index", "total_acquisitions", "baseline_acquisitions", "elapsed_minutes", "rul_minutes", series).select("*", "s.*").drop("s"))
    found = he.change_points(rows, [*UNIT, "smoothing_window"], PARTITIONS)
    return he.onsets(rows, found, UNIT, settings=he.parameter_grid(spark))


def sensitivity(spark, sf):
    """The grid on training and validation units only."""
    plan = folds(spark, sf).where("subset <> 'test'").select("fold", "subset", "unit_id")
    return sensitivity_rows(spark, sf).join(plan, "unit_id")


VIEWS["v_grid"] = """
SELECT (((c * 4 + p) * 3 + v) * 2 + m) * 2 + s AS parameter_id, cost_model, penalty, w, least, persistence
FROM (VALUES (0, 'rbf'), (1, 'l2')) a(c, cost_model), (VALUES (0, 1::DOUBLE), (1, 3), (2, 5), (3, 8)) b(p, penalty), (VALUES (0, 5), (1, 7), (2, 11)) d(v, w), (VALUES (0, 5), (1, 10)) e(m, least), (VALUES (0, 5), (1, 10)) g(s, persistence)
"""
VIEWS["v_sides"] = """
SELECT c.unit_id, c.w, c.boundary, c.persistence, median(smoothed) FILTER (sequence_index < c.boundary) AS pre, median(smoothed) FILTER (sequence_index >= c.boundary) AS post, list(smoothed) FILTER (sequence_index >= c.boundary) AS tail
FROM (SELECT DISTINCT unit_id, w, 5 * cell AS boundary, persistence FROM v_boundaries, (VALUES (5), (10)) s(persistence) WHERE cell > 0) c
JOIN v_smooths s ON s.unit_id = c.unit_id AND s.w = c.w AND s.sequence_index BETWEEN c.boundary - c.persistence AND c.boundary + c.persistence - 1 GROUP BY ALL
"""
VIEWS["v_sensitivity"] = """
SELECT condition_id, unit_id, n, CAST(parameter_id AS BIGINT) AS parameter_id, onset IS NOT NULL AS hit, CAST(onset AS DOUBLE) AS hit_at, onset / (n - 1)::DOUBLE AS life, effect
FROM (SELECT DISTINCT condition_id, unit_id, n FROM v_smooths) CROSS JOIN v_grid LEFT JOIN (
  SELECT unit_id, parameter_id, min(boundary) AS onset, arg_min(effect, boundary) AS effect FROM (
    SELECT h.unit_id, parameter_id, boundary, pre, tail, (post - pre) / scale AS effect
    FROM (SELECT DISTINCT unit_id, w, n, b FROM v_smooths) h JOIN v_grid g USING (w)
    JOIN (SELECT *, 5 * cell AS boundary FROM v_boundaries WHERE cell > 0) c USING (unit_id, w, cost_model, penalty, least)
    JOIN v_sides USING (unit_id, w, boundary, persistence) JOIN v_scales USING (unit_id, w)
    WHERE n >= greatest(2 * least, b + persistence) AND boundary >= greatest(b, persistence) AND n - boundary >= persistence)
  WHERE effect >= 1 AND len(list_filter(tail, lambda x: x > pre)) / len(tail)::DOUBLE >= 0.7 GROUP BY 1, 2) USING (unit_id, parameter_id)
"""
VIEWS["v_stable"] = """
SELECT unit_id, m AS median_onset_minutes, iqr, life_iqr, rate, coalesce(avg(CAST(abs(hit_at - m) <= 10 AS INTEGER)) FILTER (hit), 0) AS agree, coalesce(avg(CAST(abs(life - lm) <= 0.05 AS INTEGER)) FILTER (hit), 0) AS life_agree FROM (
  SELECT *, median(hit_at) OVER w AS m, quantile_cont(hit_at, 0.75) OVER w - quantile_cont(hit_at, 0.25) OVER w AS iqr, quantile_cont(life, 0.75) OVER w - quantile_cont(life, 0.25) OVER w AS life_iqr, median(life) OVER w AS lm, avg(CAST(hit AS INTEGER)) OVER w AS rate
  FROM v_sensitivity WINDOW w AS (PARTITION BY unit_id)) GROUP BY 1, 2, 3, 4, 5
"""
VIEWS["v_choice"] = """
SELECT fold, parameter_id, score, row_number() OVER (PARTITION BY fold ORDER BY round(score, 12) DESC, parameter_id) AS place FROM (
  SELECT fold, parameter_id, 0.35 * avg(CAST(hit AS INTEGER)) + 0.25 * coalesce(avg(CAST(abs(hit_at - median_onset_minutes) <= 10 AS INTEGER)) FILTER (hit), 0) + 0.15 * coalesce(least(greatest(median(effect) FILTER (hit) / 5, 0), 1), 0)
         + 0.15 * count(DISTINCT CASE WHEN hit THEN s.condition_id END) / 3 + 0.10 * (1 - coalesce(avg(CAST(life >= 0.95 AS INTEGER)) FILTER (hit), 1)) AS score
  FROM v_sensitivity s JOIN v_stable USING (unit_id) JOIN v_folds f USING (unit_id) WHERE subset <> 'test' GROUP BY 1, 2)
"""


@register(
    "h7_sensitivity",
    "SELECT fold, subset, unit_id, parameter_id, CASE WHEN hit THEN 'detected' ELSE 'not_detected' END AS onset_status, CAST(hit_at AS BIGINT) AS onset_index FROM v_sensitivity JOIN v_folds USING (unit_id) WHERE subset <> 'test'",
)
def sensitivity_run(spark, sf):
    return sensitivity(spark, sf).select("fold", "subset", "unit_id", "parameter_id", "onset_status", "onset_index")


@register(
    "h8_stability",
    """SELECT fold, unit_id, round(median_onset_minutes, 6) AS median_onset_minutes, round(iqr, 6) AS onset_iqr_minutes, round(life_iqr, 6) AS normalized_onset_iqr, round(rate, 6) AS detection_proportion, round(agree, 6) AS agreement_within_minutes,
              round(life_agree, 6) AS agreement_within_life_fraction FROM v_stable JOIN v_folds USING (unit_id) WHERE subset <> 'test'""",
)
def stability(spark, sf):
    names = ["median_onset_minutes", "onset_iqr_minutes", "normalized_onset_iqr", "detection_proportion", "agreement_within_minutes", "agreement_within_life_fraction"]
    rows = he.stability(cut(sensitivity(spark, sf)), ["fold", *UNIT])
    return rows.select("fold", "unit_id", *[r6(n).alias(n) for n in names]).distinct()


def ranking(spark, sf, every):
    """Settings by fold, best first, from the outcomes on training and validation units."""
    plan = folds(spark, sf).where("subset <> 'test'").select("fold", "unit_id")
    return he.choose(he.stability(cut(every.join(plan, "unit_id")), ["fold", *UNIT]), 3)


@register("h9_choose_parameters", "SELECT fold, parameter_id, round(score, 6) AS selection_score, CAST(place AS INTEGER) AS configuration_rank FROM v_choice")
def choose_parameters(spark, sf):
    return ranking(spark, sf, sensitivity_rows(spark, sf)).select("fold", "parameter_id", r6("selection_score").alias("selection_score"), "configuration_rank")


def chosen_onsets(spark, sf):
    """The onset of every unit in every fold, under the setting chosen without the fold's test units."""
    every = cut(sensitivity_rows(spark, sf))  # one row per unit and setting, read twice below
    chosen = ranking(spark, sf, every).where("selected").select("fold", "parameter_id")
    return every.join(chosen, "parameter_id").join(folds(spark, sf).select("fold", "subset", "unit_id"), ["fold", "unit_id"])


VIEWS["v_onsets"] = """
SELECT fold, subset, f.condition_id, unit_id, f.n, parameter_id, hit, hit_at FROM v_choice JOIN v_sensitivity USING (parameter_id) JOIN v_folds f USING (fold, unit_id) WHERE place = 1
"""


@register("h10_apply_choice", "SELECT fold, subset, unit_id, parameter_id, CASE WHEN hit THEN 'detected' ELSE 'not_detected' END AS onset_status, CAST(hit_at AS BIGINT) AS onset_index FROM v_onsets")
def apply_choice(spark, sf):
    return chosen_onsets(spark, sf).select("fold", "subset", "unit_id", "parameter_id", "onset_status", "onset_index")
