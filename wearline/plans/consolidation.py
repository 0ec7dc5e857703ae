"""Consolidation and paired-statistics queries (survey rows L)."""

from pyspark.sql import functions as F

from wearline.functions.rounding import r6
from wearline.operators import metrics as me
from wearline.operators import stats as st
from wearline.plans.catalog import VIEWS, register
from wearline.plans.rul import predictions, rounded
from wearline.session import cut
from wearline.sources.tables import UNIT, readings, table

COUNTDOWN, MEDIAN = "condition_countdown", "median_baseline"

# the median model skips each unit's first four rows, so supports differ
VIEWS["v_harmony"] = """
SELECT experiment, fold, condition_id, unit_id, acquisition_number, sequence_index, rul_minutes, p, concat_ws('|', condition_id, unit_id, acquisition_number) AS canonical_key
FROM v_predictions WHERE experiment = 'condition_countdown' OR sequence_index >= 4
"""


def harmony(spark, sf, rows=None):
    rows = predictions(spark, sf) if rows is None else rows
    other = rows.where(F.col("experiment") == MEDIAN).where("sequence_index >= 4").withColumn("window_length", F.lit(5))
    return st.harmonise([rows.where(F.col("experiment") == COUNTDOWN), other], [COUNTDOWN, MEDIAN])


@register("l1_harmonise", "SELECT experiment, fold, canonical_key, p AS prediction, CASE WHEN experiment = 'median_baseline' THEN 5 END AS window_length FROM v_harmony")
def harmonise(spark, sf):
    return harmony(spark, sf).select("experiment", "fold", "canonical_key", F.col("prediction_non_negative_minutes").alias("prediction"), "window_length")


@register(
    "l1_harmony_issues",
    """SELECT experiment || ':' || canonical_key AS path, 'duplicate_key' AS code FROM (SELECT event_type AS experiment, concat_ws('|', condition_id, unit_id, sequence_index // 2) AS canonical_key FROM v_readings) GROUP BY 1 HAVING count(*) > 1
       UNION ALL SELECT concat_ws('|', condition_id, unit_id, sequence_index // 2), 'truth_mismatch' FROM v_readings GROUP BY condition_id, unit_id, sequence_index // 2 HAVING max(rul_minutes) > min(rul_minutes)
       UNION ALL SELECT CAST(unit_id AS VARCHAR), 'unit_in_several_folds' FROM v_readings GROUP BY unit_id HAVING count(DISTINCT sequence_index // 60) > 1""",
)
def harmony_issues(spark, sf):
    half = F.floor(F.col("sequence_index") / 2).alias("acquisition_number")
    rows = readings(spark, sf).select(
        F.col("event_type").alias("experiment"), F.floor(F.col("sequence_index") / 60).alias("fold"), *UNIT, half, "rul_minutes", F.col("horizontal").alias("prediction_non_negative_minutes")
    )
    return st.harmony_issues(st.harmonise([rows], ["click", "error", "purchase", "signup", "view"]))


@register(
    "l2_pairwise_support",
    "SELECT experiment, canonical_key FROM v_harmony WHERE canonical_key IN (SELECT canonical_key FROM v_harmony WHERE experiment = 'condition_countdown' INTERSECT SELECT canonical_key FROM v_harmony WHERE experiment = 'median_baseline')",
)
def pairwise_support(spark, sf):
    return st.pairwise_support(harmony(spark, sf), COUNTDOWN, MEDIAN).select("experiment", "canonical_key")


@register(
    "l3_strict_support",
    "SELECT experiment, count(*) AS n, count(DISTINCT unit_id) AS units FROM v_harmony WHERE canonical_key IN (SELECT canonical_key FROM v_harmony GROUP BY 1 HAVING count(DISTINCT experiment) = 2) GROUP BY 1",
)
def strict_support(spark, sf):
    return st.strict_support(harmony(spark, sf), [COUNTDOWN, MEDIAN]).groupBy("experiment").agg(F.count("*").alias("n"), F.countDistinct("unit_id").alias("units"))


@register(
    "l4_support_manifest",
    """SELECT unit_id, count(*) AS candidate_native_count, count(*) FILTER (sequence_index >= 4) AS reference_native_count, count(*) FILTER (sequence_index >= 4) AS matched_count,
       round(count(*) FILTER (sequence_index >= 4) / count(*)::DOUBLE, 6) AS candidate_retention, 1.0::DOUBLE AS reference_retention FROM v_harmony WHERE experiment = 'condition_countdown' GROUP BY 1""",
)
def support_manifest(spark, sf):
    out = st.support_manifest(harmony(spark, sf), COUNTDOWN, MEDIAN)
    return rounded(out, ["unit_id"], ["candidate_retention", "reference_retention"], ["candidate_native_count", "reference_native_count", "matched_count"])


VIEWS["v_delta"] = """
SELECT fold, condition_id, unit_id, c.mae - r.mae AS delta_mae, c.rmse - r.rmse AS delta_rmse, CASE WHEN c.mae - r.mae < -1e-9 THEN 'win' WHEN c.mae - r.mae > 1e-9 THEN 'loss' ELSE 'tie' END AS exact_status
FROM (SELECT * FROM v_unit_metrics WHERE experiment = 'condition_countdown') c JOIN (SELECT * FROM v_unit_metrics WHERE experiment = 'median_baseline') r USING (fold, condition_id, unit_id)
"""


def units(spark, sf, rows=None):
    """Unit metrics, one row per unit and model; written once because the tests read them several times."""
    return cut(me.unit_metrics(predictions(spark, sf) if rows is None else rows))


def differences(spark, sf):
    return cut(st.paired_differences(me.unit_metrics(predictions(spark, sf)), COUNTDOWN, MEDIAN))


@register(
    "l5_paired_differences",
    """SELECT fold, unit_id, round(delta_mae, 6) + 0.0 AS delta_mae, round(delta_rmse, 6) + 0.0 AS delta_rmse, exact_status,
       CASE WHEN delta_mae < -1 THEN 'practical win' WHEN delta_mae > 1 THEN 'practical loss' ELSE 'within practical tolerance' END AS practical_status FROM v_delta""",
)
def paired_differences(spark, sf):
    return rounded(differences(spark, sf), ["fold", "unit_id"], ["delta_mae", "delta_rmse"], ["exact_status", "practical_status"])


@register(
    "l6_difference_summary",
    """SELECT condition_id, round(avg(delta_mae), 6) + 0.0 AS mean_delta_mae, round(median(delta_mae), 6) + 0.0 AS median_delta_mae, round(stddev_samp(delta_mae), 6) AS std_delta_mae, round(quantile_cont(delta_mae, 0.75) - quantile_cont(delta_mae, 0.25), 6) AS iqr_delta_mae,
       round(min(delta_mae), 6) + 0.0 AS minimum_delta_mae, round(max(delta_mae), 6) + 0.0 AS maximum_delta_mae, count(*) FILTER (exact_status = 'win') AS wins, count(*) FILTER (exact_status = 'tie') AS ties, count(*) FILTER (exact_status = 'loss') AS losses FROM v_delta GROUP BY 1""",
)
def difference_summary(spark, sf):
    out = st.summarize_differences(differences(spark, sf), ["condition_id"])
    return rounded(out, ["condition_id"], ["mean_delta_mae", "median_delta_mae", "std_delta_mae", "iqr_delta_mae", "minimum_delta_mae", "maximum_delta_mae"], ["wins", "ties", "losses"])


VIEWS["v_draws"] = f"""
SELECT d.replicate, d.condition_id, p.unit_id
FROM (SELECT condition_id, replicate, ('0x' || substr(md5(concat_ws('|', 42, replicate, condition_id, slot)), 1, 12))::BIGINT % n AS pick
      FROM (SELECT condition_id, row_number() OVER (PARTITION BY condition_id ORDER BY unit_id) - 1 AS slot, count(*) OVER (PARTITION BY condition_id) AS n FROM (SELECT DISTINCT condition_id, unit_id FROM v_unit_metrics)),
           range({st.REPLICATES}) t(replicate)) d
JOIN (SELECT condition_id, unit_id, row_number() OVER (PARTITION BY condition_id ORDER BY unit_id) - 1 AS pick FROM (SELECT DISTINCT condition_id, unit_id FROM v_unit_metrics)) p USING (condition_id, pick)
"""


def _interval(column):
    return ", ".join(f"round(quantile_cont({column}, {p}), 6) + 0.0 AS {column}_ci_{side}" for side, p in (("lower", 0.025), ("upper", 0.975)))


@register(
    "l7_bootstrap_difference",
    f"""SELECT {_interval('mean')}, {_interval('median')}, {_interval('win')}, count(mean)::DOUBLE AS effective_replicates, 0.0::DOUBLE AS failed_replicates
        FROM (SELECT replicate, avg(delta_mae) AS mean, median(delta_mae) AS median, avg(CAST(delta_mae < 0 AS INTEGER)) AS win FROM v_draws JOIN v_delta USING (condition_id, unit_id) GROUP BY 1)""",
)
def bootstrap_difference(spark, sf):
    out = st.bootstrap_difference(differences(spark, sf))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@register(
    "l8_bootstrap_ranks",
    f"""WITH scores AS (SELECT replicate, experiment, round(avg(mae), 9) AS score FROM v_draws JOIN v_unit_metrics USING (condition_id, unit_id) GROUP BY 1, 2),
          firsts AS (SELECT experiment FROM (SELECT *, row_number() OVER (PARTITION BY replicate ORDER BY score, experiment) AS nth FROM scores) WHERE nth = 1)
        SELECT experiment, (SELECT count(*) FROM firsts f WHERE f.experiment = e.experiment) / {st.REPLICATES}::DOUBLE AS bootstrap_rank_first_probability FROM (SELECT DISTINCT experiment FROM v_unit_metrics) e""",
)
def bootstrap_ranks(spark, sf):
    return st.bootstrap_ranks(units(spark, sf).select("condition_id", "unit_id", "experiment", "mae"))


@register(
    "l9_bootstrap_metrics",
    f"""SELECT experiment, {_interval('mae')}, {_interval('rmse')}, 0.0::DOUBLE AS mae_failed_replicates, 0.0::DOUBLE AS rmse_failed_replicates
        FROM (SELECT experiment, replicate, avg(mae) AS mae, avg(rmse) AS rmse FROM v_draws JOIN v_unit_metrics USING (condition_id, unit_id) GROUP BY 1, 2) GROUP BY 1""",
)
def bootstrap_metrics(spark, sf):
    out = st.bootstrap_metrics(units(spark, sf), ["mae", "rmse"])
    return out.select("experiment", *[r6(c).alias(c) for c in out.columns[1:]])


VIEWS["v_signed"] = """
SELECT fold, delta_mae AS d, rank() OVER (PARTITION BY fold ORDER BY round(abs(delta_mae), 9)) + (count(*) OVER (PARTITION BY fold, round(abs(delta_mae), 9)) - 1) / 2.0 AS rk,
       count(*) OVER (PARTITION BY fold, round(abs(delta_mae), 9)) AS t FROM v_delta WHERE abs(delta_mae) > 1e-9
"""
VIEWS["v_rank_sums"] = """
SELECT fold, sum(CASE WHEN d > 0 THEN rk ELSE 0 END)::DOUBLE AS pos, sum(CASE WHEN d < 0 THEN rk ELSE 0 END)::DOUBLE AS neg, count(*) AS n, sum(t * t - 1)::DOUBLE AS ties FROM v_signed GROUP BY 1
"""


@register(
    "l10_wilcoxon",
    """WITH RECURSIVE sums(n, s, c) AS (SELECT 0, 0, 1.0::DOUBLE UNION ALL SELECT n + 1, s, sum(c) FROM (SELECT n, unnest([s, s + n + 1]) AS s, c FROM sums WHERE n < 50) GROUP BY n, s),
       z AS (SELECT *, least(pos, neg) AS w, abs(least(pos, neg) - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - ties / 48) / sqrt(2.0::DOUBLE) AS x FROM v_rank_sums),
       e AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * x) AS t FROM z),
       zeros AS (SELECT fold, count(*) AS paired_units, count(*) FILTER (abs(delta_mae) <= 1e-9) AS zero_differences FROM v_delta GROUP BY 1)
       SELECT fold, paired_units, zero_differences, w AS wilcoxon_statistic,
              CASE WHEN n > 50 OR ties > 0 OR zero_differences > 0 THEN round((0.254829592::DOUBLE * t - 0.284496736 * t ** 2 + 1.421413741 * t ** 3 - 1.453152027 * t ** 4 + 1.061405429 * t ** 5) * exp(-x * x), 4) ELSE round(least(1, 2 * (SELECT sum(c) FROM sums WHERE sums.n = e.n AND s <= e.w) / 2.0::DOUBLE ** n), 4) END AS wilcoxon_p_raw
       FROM e JOIN zeros USING (fold)""",
)
def wilcoxon(spark, sf):
    out = st.wilcoxon(differences(spark, sf), ["fold"])
    return out.select("fold", "paired_units", "zero_differences", "wilcoxon_statistic", r6("wilcoxon_p_raw", 4).alias("wilcoxon_p_raw"))


@register(
    "l11_sign_test",
    """WITH c AS (SELECT fold, count(*) FILTER (delta_mae < -1e-9) AS neg, count(*) FILTER (delta_mae > 1e-9) AS pos FROM v_delta GROUP BY 1),
       k AS (SELECT fold, neg, pos, unnest(range(least(neg, pos) + 1)) AS k FROM c)
       SELECT fold, neg AS negative, pos AS positive, round(CASE WHEN neg = pos THEN 1 ELSE least(1, 2 * sum(exp(lgamma(neg + pos + 1) - lgamma(k + 1) - lgamma(neg + pos - k + 1) - (neg + pos) * ln(2)))) END, 6) AS sign_test_p_raw FROM k GROUP BY 1, 2, 3""",
)
def sign_test(spark, sf):
    return st.sign_test(differences(spark, sf), ["fold"]).withColumn("sign_test_p_raw", r6("sign_test_p_raw"))


@register("l12_rank_biserial", "SELECT fold, round((pos - neg) / (pos + neg), 6) + 0.0 AS rank_biserial_effect FROM v_rank_sums")
def rank_biserial(spark, sf):
    return rounded(st.wilcoxon(differences(spark, sf), ["fold"]), ["fold"], ["rank_biserial_effect"])


VIEWS["v_p"] = "SELECT event_type AS family, unit_id, round(min(horizontal) / 100, 9) AS p FROM v_readings GROUP BY 1, 2"


@register(
    "l13_holm",
    """SELECT family, unit_id, round(max(least(1, (m - rk + 1) * p)) OVER (PARTITION BY family ORDER BY p, unit_id ROWS UNBOUNDED PRECEDING), 6) AS holm_p_adjusted, m AS family_hypothesis_count
       FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, unit_id) AS rk, count(*) OVER (PARTITION BY family) AS m FROM v_p)""",
)
def holm(spark, sf):
    tests = readings(spark, sf).groupBy(F.col("event_type").alias("family"), "unit_id").agg(F.round(F.min("horizontal") / 100, 9).alias("p"))
    return rounded(st.holm(tests, ["family"], "p", "unit_id"), ["family", "unit_id"], ["holm_p_adjusted"], ["family_hypothesis_count"])


@register(
    "l14_enriched_units",
    """SELECT u.experiment, u.fold, u.unit_id, round(u.mae, 6) + 0.0 AS mae, round(delta_mae, 6) + 0.0 AS delta_mae_vs_median, count_4 AS matched_count FROM v_unit_metrics u LEFT JOIN v_delta d USING (fold, unit_id)
       LEFT JOIN (SELECT unit_id, count(*) FILTER (sequence_index >= 4) AS count_4 FROM v_readings GROUP BY 1) USING (unit_id)""",
)
def enriched_units(spark, sf):
    rows = predictions(spark, sf)
    every = units(spark, sf, rows)
    out = st.enrich_units(every, {"median": st.paired_differences(every, COUNTDOWN, MEDIAN)}, st.support_manifest(harmony(spark, sf, rows), COUNTDOWN, MEDIAN))
    return rounded(out, ["experiment", "fold", "unit_id"], ["mae", "delta_mae_vs_median"], ["matched_count"])


def evidence(spark, sf):
    """Feature evidence from the readings: event type = source, life minute = feature."""
    rows = readings(spark, sf).groupBy(F.col("event_type").alias("source"), F.concat(F.lit("f"), F.col("sequence_index").cast("string")).alias("feature")).agg(F.round(F.sum("horizontal"), 2).alias("score"))
    return st.rank_evidence(rows, ["source"]).withColumn("selected", F.col("score") > 1000)


VIEWS["v_evidence"] = """
SELECT source, feature, score, score > 1000 AS selected, 1 - (rank() OVER (PARTITION BY source ORDER BY score DESC) + (count(*) OVER (PARTITION BY source, score) - 1) / 2.0::DOUBLE - 1) / (count(*) OVER (PARTITION BY source) - 1) AS normalized_rank
FROM (SELECT event_type AS source, 'f' || sequence_index AS feature, round(sum(horizontal), 2) AS score FROM v_readings GROUP BY 1, 2)
"""


@register("l15_feature_evidence", "SELECT source, feature, score, round(normalized_rank, 6) + 0.0 AS normalized_rank, selected FROM v_evidence")
def feature_evidence(spark, sf):
    return rounded(evidence(spark, sf), ["source", "feature", "score"], ["normalized_rank"], ["selected"])


@register(
    "l16_consensus",
    "SELECT feature, round(avg(normalized_rank), 6) AS mean_normalized_rank, round(median(normalized_rank), 6) AS median_normalized_rank, count(DISTINCT source) AS evidence_sources, count(*) FILTER (selected) AS selected_occurrences FROM v_evidence GROUP BY 1",
)
def consensus(spark, sf):
    return rounded(st.consensus(evidence(spark, sf)), ["feature"], ["mean_normalized_rank", "median_normalized_rank"], ["evidence_sources", "selected_occurrences"])


@register(
    "l17_source_agreement",
    """WITH r AS (SELECT source, feature, round(normalized_rank, 12) AS rk, row_number() OVER (PARTITION BY source ORDER BY round(normalized_rank, 12) DESC, feature) AS place FROM v_evidence),
       c AS (SELECT a.source AS source_a, b.source AS source_b, a.rk AS x, b.rk AS y FROM r a JOIN r b USING (feature) WHERE a.source < b.source),
       s AS (SELECT source_a, source_b, count(*) AS common_features, corr(rx, ry) AS rho FROM (SELECT *, rank() OVER (PARTITION BY source_a, source_b ORDER BY x) + (count(*) OVER (PARTITION BY source_a, source_b, x) - 1) / 2.0 AS rx,
             rank() OVER (PARTITION BY source_a, source_b ORDER BY y) + (count(*) OVER (PARTITION BY source_a, source_b, y) - 1) / 2.0 AS ry FROM c) GROUP BY 1, 2),
       t AS (SELECT a.source AS source_a, b.source AS source_b, k AS top_k, count(*) AS n FROM (VALUES (5), (10)) v(k), r a JOIN r b USING (feature) WHERE a.source < b.source AND a.place <= k AND b.place <= k GROUP BY 1, 2, 3)
       SELECT s.source_a, s.source_b, k AS top_k, common_features, round(rho, 6) + 0.0 AS spearman_rank_agreement, coalesce(n, 0) AS intersection, round(coalesce(n, 0) / (2.0::DOUBLE * k - coalesce(n, 0)), 6) AS jaccard
       FROM s CROSS JOIN (VALUES (5), (10)) v(k) LEFT JOIN t ON t.source_a = s.source_a AND t.source_b = s.source_b AND t.top_k = v.k""",
)
def source_agreement(spark, sf):
    return rounded(st.source_agreement(evidence(spark, sf)), ["source_a", "source_b", "top_k", "common_features"], ["spearman_rank_agreement", "jaccard"], ["intersection"])


@register(
    "l18_consolidated_costs",
    """SELECT o_orderpriority AS experiment, round(sum(o_totalprice), 2) AS training_seconds, CAST(count(*) AS DOUBLE) AS inference_seconds, round(avg(o_custkey), 6) AS input_feature_count, CAST(NULL AS DOUBLE) AS trainable_parameters, 'trainable parameters not applicable' AS missing_reason FROM orders GROUP BY 1
       UNION ALL SELECT c_mktsegment, round(sum(c_acctbal), 2), CAST(count(*) AS DOUBLE), NULL, round(avg(c_nationkey), 6), 'input feature count not recorded' FROM customer GROUP BY 1""",
)
def consolidated_costs(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("experiment"), F.col("o_totalprice").alias("training_seconds"), F.lit(1.0).alias("inference_seconds"), F.col("o_custkey").alias("input_feature_count"))
    b = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("experiment"), F.col("c_acctbal").alias("training_seconds"), F.lit(1.0).alias("inference_seconds"), F.col("c_nationkey").alias("trainable_parameters"))
    out = st.consolidate_costs(a, b)
    return out.select("experiment", r6("training_seconds", 2).alias("training_seconds"), "inference_seconds", r6("input_feature_count").alias("input_feature_count"), r6("trainable_parameters").alias("trainable_parameters"), "missing_reason")


_PARETO = """SELECT o_orderkey, NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_totalprice <= a.o_totalprice AND b.o_custkey <= a.o_custkey AND (b.o_totalprice < a.o_totalprice OR b.o_custkey < a.o_custkey)) AS pareto FROM orders a"""


def _pareto(split):
    def query(spark, sf):
        return st.pareto_front(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), "o_custkey", "o_totalprice", split).select("o_orderkey", "pareto")

    return query


register("l19_pareto_front", _PARETO)(_pareto(None))
register("l19_pareto_front_split", _PARETO)(_pareto(True))


