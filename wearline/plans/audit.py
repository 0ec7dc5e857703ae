"""Scans, incremental reads and data-quality queries (survey rows A and B)."""

from pyspark.sql import functions as F

from wearline.functions.rounding import r6
from wearline.operators import quality as q
from wearline.operators.scale import percentiles, unpivot
from wearline.plans import views  # noqa: F401
from wearline.plans.catalog import register
from wearline.sources import files, incremental
from wearline.sources.tables import UNIT, raw_readings, readings, table


@register(
    "a2_path_keys",
    """SELECT page_id, split_part(regexp_extract(url, '^https?://[^/]+/([^?]*)', 1), '/', 1) AS folder,
       CASE WHEN regexp_matches(stem, '^[1-9][0-9]{0,18}$') THEN TRY_CAST(stem AS BIGINT) END AS acquisition_number
       FROM (SELECT *, regexp_extract(url, '/([^/?]*)(\\?.*)?$', 1) AS stem FROM pages)""",
)
def path_keys(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id",
        F.split(F.regexp_extract("url", r"^https?://[^/]+/([^?]*)", 1), "/")[0].alias("folder"),
        files.file_number(F.regexp_extract("url", r"/([^/?]*)(\?.*)?$", 1)).alias("acquisition_number"),
    )


@register(
    "a5_ordered_scan",
    "SELECT condition_id, unit_id, sequence_index, acquisition_number FROM v_readings ORDER BY 1, 2, 3",
)
def ordered_scan(spark, sf):
    return readings(spark, sf).select(*UNIT, "sequence_index", "acquisition_number").orderBy(*UNIT, "sequence_index")


@register("a6_pruned_scan", "SELECT DISTINCT event_type AS experiment FROM events")
def pruned_scan(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("experiment")).distinct()


@register(
    "a10_resume",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def resume(spark, sf):
    manifest = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    done = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return incremental.still_to_do(manifest, done, ["o_orderkey"])


@register(
    "a11_augment",
    """SELECT event_type AS experiment, user_id AS unit_id, CASE WHEN event_type IN ('click', 'view') THEN 'prior' ELSE 'added' END AS origin,
       count(*) AS n FROM events GROUP BY ALL""",
)
def augment(spark, sf):
    results = table(spark, sf, "events").groupBy(F.col("event_type").alias("experiment"), F.col("user_id").alias("unit_id")).agg(F.count("*").alias("n"))
    prior = results.where("experiment IN ('click', 'view')").withColumn("origin", F.lit("prior"))
    return incremental.augment(prior, results.withColumn("origin", F.lit("added")))


@register(
    "a12_fingerprint",
    """SELECT count(*) AS row_count,
       CAST(sum(CAST(('0x' || substr(sha256(concat_ws(chr(31), CAST(doc_id AS VARCHAR), lang, CAST(n_chars AS VARCHAR), source, text)), 1, 12)) AS BIGINT)) AS VARCHAR) AS fingerprint
       FROM documents""",
)
def fingerprint(spark, sf):
    return incremental.fingerprint(table(spark, sf, "documents"))


@register(
    "a13_describe",
    """SELECT feature, count(value) AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS std, min(value) AS lowest,
       round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS highest
       FROM v_long GROUP BY feature""",
)
def describe(spark, sf):
    long = unpivot(raw_readings(spark, sf), ["unit_id"], ["horizontal", "vertical"])
    v = F.col("value")
    stats = {"n": F.count(v), "mean": F.avg(v), "std": F.stddev_samp(v), "lowest": F.min(v), "highest": F.max(v)}
    out = percentiles(long, ["feature"], {"q25": (v, 0.25), "q50": (v, 0.5), "q75": (v, 0.75)}, stats)
    return out.select("feature", "n", r6("mean").alias("mean"), r6("std").alias("std"), "lowest", *[r6(c).alias(c) for c in ("q25", "q50", "q75")], "highest")


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_linenumber").cast("bigint").alias("number"))


def _orders(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit_id"))


@register(
    "b1_unexpected_entries",
    "SELECT o_orderkey AS unit_id, 'unexpected_unit' AS code FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def unexpected_entries(spark, sf):
    return q.unexpected(_orders(spark, sf), _lines(spark, sf), ["unit_id"]).select("unit_id", F.lit("unexpected_unit").alias("code"))


@register(
    "b2_missing_units",
    "SELECT o_orderkey AS unit_id, 'missing_unit' AS code FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
)
def missing_units(spark, sf):
    return q.missing(_lines(spark, sf), _orders(spark, sf), ["unit_id"]).select("unit_id", F.lit("missing_unit").alias("code"))


@register(
    "b3_duplicate_numbers",
    """SELECT l_orderkey AS unit_id, CAST(l_linenumber AS BIGINT) AS number, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
)
def duplicate_numbers(spark, sf):
    return q.duplicate_numbers(_lines(spark, sf), ["unit_id"], "number")


@register(
    "b3_unique_numbers",
    "SELECT l_orderkey AS unit_id, CAST(l_linenumber AS BIGINT) AS number FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1",
)
def unique_numbers(spark, sf):
    return q.drop_duplicate_numbers(_lines(spark, sf), ["unit_id"], "number")


@register(
    "b4_number_gaps",
    """WITH seen AS (SELECT DISTINCT l_orderkey AS unit_id, l_linenumber AS number FROM lineitem),
       ends AS (SELECT unit_id, min(number) AS lo, max(number) AS hi FROM seen GROUP BY 1),
       holes AS (SELECT unit_id, n FROM (SELECT unit_id, unnest(range(lo, hi)) AS n FROM ends) h WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.unit_id = h.unit_id AND s.number = h.n))
       SELECT unit_id, count(*) AS missing_count, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS missing_numbers FROM holes GROUP BY 1""",
)
def number_gaps(spark, sf):
    gaps = q.number_gaps(_lines(spark, sf), ["unit_id"], "number")
    return gaps.withColumn("missing_numbers", F.concat_ws(",", F.col("missing_numbers").cast("array<string>")))


@register(
    "b5_wrong_start",
    "SELECT l_orderkey AS unit_id, CAST(min(l_linenumber) AS BIGINT) AS first_number FROM lineitem GROUP BY 1 HAVING min(l_linenumber) <> 1",
)
def wrong_start(spark, sf):
    return q.wrong_start(_lines(spark, sf), ["unit_id"], "number")


@register(
    "b6_count_mismatch",
    """SELECT o_orderkey AS unit_id, count(l_orderkey) AS observed_count, CAST(4 AS BIGINT) AS expected_count
       FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(l_orderkey) <> 4""",
)
def count_mismatch(spark, sf):
    expected = _orders(spark, sf).withColumn("expected_count", F.lit(4).cast("bigint"))
    return q.count_mismatch(_lines(spark, sf), expected, ["unit_id"])


@register(
    "b7_drop_aliases",
    "SELECT doc_id, sha256(text) AS target FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(*) = 1)",
)
def drop_aliases(spark, sf):
    resolved = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("target"))
    return q.drop_aliases(resolved, "target")


_INDEX_SQL = "SELECT condition_id, unit_id, acquisition_number, sequence_index FROM v_readings"


@register("b8_chronological_index", _INDEX_SQL)
def chronological_index(spark, sf):
    return readings(spark, sf).select(*UNIT, "acquisition_number", "sequence_index")


@register("b8_chronological_index_split", _INDEX_SQL)
def chronological_index_split(spark, sf):
    return readings(spark, sf, split=True).select(*UNIT, "acquisition_number", "sequence_index")


@register(
    "b9_inspection_issues",
    """WITH seen AS (SELECT doc_id, length(text) AS samples, CASE WHEN quality IS NULL THEN NULL ELSE lang END AS lang, quality, toxic, n_chars, octet_length(encode(text)) AS bytes
                     FROM documents LEFT JOIN labels USING (doc_id))
       SELECT doc_id, 'inspection_missing' AS code, 'error' AS severity FROM seen WHERE quality IS NULL
       UNION ALL SELECT doc_id, 'parse_error', 'error' FROM seen WHERE quality = 0
       UNION ALL SELECT doc_id, 'wrong_channel_names', 'error' FROM seen WHERE quality = 1 AND lang <> 'en'
       UNION ALL SELECT doc_id, 'wrong_sample_count', 'error' FROM seen WHERE quality = 1 AND bytes <> samples
       UNION ALL SELECT doc_id, 'nan_samples', 'error' FROM seen WHERE quality = 1 AND toxic > 0""",
)
def inspection_issues(spark, sf):
    docs = table(spark, sf, "documents")
    inspections = table(spark, sf, "labels").join(docs, "doc_id").select(
        "doc_id",
        F.when(F.col("quality") == 0, "unreadable").alias("parse_error"),
        F.array("lang").alias("header"),
        F.lit(1).alias("channel_count"),
        F.when(F.octet_length("text") == F.length("text"), 1).otherwise(0).alias("sample_count"),
        F.col("toxic").alias("nan_count"),
        F.lit(0).alias("infinite_count"),
    )
    found = q.inspection_issues(docs.select("doc_id"), inspections, q.inspection_rules(["en"], 1), "doc_id")
    return found.select("doc_id", "code", "severity")


@register(
    "b10_inventory_drift",
    """SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'vanished' WHEN d.n_chars <> octet_length(encode(d.text)) THEN 'changed' END AS code
       FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR d.n_chars <> octet_length(encode(d.text))""",
)
def inventory_drift(spark, sf):
    docs = table(spark, sf, "documents")
    before = docs.select("doc_id", F.col("n_chars").alias("length"))
    now = docs.join(table(spark, sf, "labels"), "doc_id", "left_semi").select("doc_id", F.octet_length("text").cast("bigint").alias("length"))
    return q.drift_issues(before, now, "doc_id", ["length"])


@register(
    "b11_manifest_invariants",
    """WITH m AS (SELECT l_orderkey AS unit_id, l_partkey AS number, l_linenumber - 1 AS i, concat_ws('/', l_orderkey, l_linenumber) AS path, l_suppkey % 5 AS total FROM lineitem),
       r AS (SELECT *, row_number() OVER w - 1 AS rn, lag(number) OVER w AS before, count(*) OVER (PARTITION BY unit_id) AS size FROM m WINDOW w AS (PARTITION BY unit_id ORDER BY i, number, path))
       SELECT unit_id, code, 'error' AS severity, count(*) AS violations FROM (
         SELECT unit_id, 'sequence_not_contiguous' AS code FROM r WHERE i <> rn
         UNION ALL SELECT unit_id, 'number_not_increasing' FROM r WHERE number <= before
         UNION ALL SELECT unit_id, 'rul_mismatch' FROM r WHERE 6 - i <> total - 1 - i
         UNION ALL SELECT unit_id, 'final_rul_not_zero' FROM r WHERE rn = size - 1 AND i <> 6
         UNION ALL SELECT unit_id, 'total_mismatch' FROM r WHERE total <> size
         UNION ALL SELECT unit_id, 'path_not_unique' FROM m WHERE (unit_id, path) IN (SELECT (unit_id, path) FROM m GROUP BY unit_id, path HAVING count(*) > 1)
       ) GROUP BY ALL""",
)
def manifest_invariants(spark, sf):
    index = (F.col("l_linenumber") - 1).cast("bigint")
    manifest = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("unit_id"),
        F.col("l_partkey").alias("acquisition_number"),
        index.alias("sequence_index"),
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("file_path"),
        (F.col("l_suppkey") % 5).alias("total_acquisitions"),
        index.cast("double").alias("elapsed_minutes"),
        (6.0 - index).alias("rul_minutes"),
    )
    return q.manifest_issues(manifest, ["unit_id"], 1.0)


_COPIES = """WITH m AS (SELECT doc_id, octet_length(encode(text)) AS size_bytes, text FROM documents),
       s AS (SELECT * FROM m WHERE size_bytes IN (SELECT size_bytes FROM m GROUP BY 1 HAVING count(*) > 1)),
       b AS (SELECT *, sha256(concat(size_bytes, left(text, 65536), '|tail|', right(text, 65536))) AS edge FROM s),
       c AS (SELECT *, sha256(text) AS digest FROM b WHERE edge IN (SELECT edge FROM b GROUP BY 1 HAVING count(*) > 1)),
       f AS (SELECT *, count(*) OVER (PARTITION BY digest) AS copies FROM c)"""


@register("b12_duplicate_content", _COPIES + " SELECT digest, CAST(size_bytes AS BIGINT) AS size_bytes, copies, doc_id FROM f WHERE copies > 1")
def duplicate_content(spark, sf):
    return q.duplicate_content(table(spark, sf, "documents"), "doc_id", "text")


@register(
    "b13_duplicate_counters",
    _COPIES + """ SELECT (SELECT count(DISTINCT size_bytes) FROM s) AS size_groups, (SELECT count(*) FROM s) AS boundary_hashed, (SELECT count(*) FROM c) AS fully_hashed,
       (SELECT count(DISTINCT digest) FROM f WHERE copies > 1) AS duplicate_groups, (SELECT count(*) FROM f WHERE copies > 1) AS duplicate_rows""",
)
def duplicate_counters(spark, sf):
    return q.duplicate_counters(table(spark, sf, "documents"), "doc_id", "text")


@register(
    "b14_audit_statistics",
    """SELECT count(*) AS expected_files, count(l.doc_id) AS observed_files, CAST(sum(n_chars) AS BIGINT) AS total_chars, CAST(sum(octet_length(encode(text))) AS BIGINT) AS total_bytes,
       count(*) FILTER (l.quality = 0) AS error_files, count(DISTINCT lang) AS header_count, string_agg(DISTINCT lang, ',' ORDER BY lang) AS headers
       FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def audit_statistics(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels").withColumn("seen", F.lit(1)), "doc_id", "left").agg(
        F.count("*").alias("expected_files"),
        F.count("seen").alias("observed_files"),
        F.sum("n_chars").alias("total_chars"),
        F.sum(F.octet_length("text")).alias("total_bytes"),
        F.count_if(F.coalesce(F.col("quality") == 0, F.lit(False))).alias("error_files"),
        F.countDistinct("lang").alias("header_count"),
        F.concat_ws(",", F.sort_array(F.collect_set("lang"))).alias("headers"),
    )


def _all_issues(spark, sf):
    gaps = q.missing(_lines(spark, sf), _orders(spark, sf), ["unit_id"]).select(
        F.col("unit_id").cast("string").alias("path"), F.lit("missing_unit").alias("code"), F.lit(q.ERROR).alias("severity")
    )
    copies = q.duplicate_numbers(_lines(spark, sf), ["unit_id"], "number").select(
        q.F.concat_ws("/", "unit_id", "number").alias("path"), F.lit("duplicate_number").alias("code"), F.lit(q.WARNING).alias("severity")
    )
    return gaps.unionByName(copies)


_ISSUES = """SELECT CAST(o_orderkey AS VARCHAR) AS path, 'missing_unit' AS code, 'error' AS severity FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
       UNION ALL SELECT concat_ws('/', l_orderkey, l_linenumber), 'duplicate_number', 'warning' FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""


@register(
    "b15_ordered_issues",
    f"SELECT *, CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS severity_rank FROM ({_ISSUES}) ORDER BY severity_rank, path, code",
)
def ordered_issues(spark, sf):
    return q.ordered_issues(_all_issues(spark, sf))


@register(
    "b15_issue_status",
    f"SELECT *, CASE WHEN errors = 0 THEN 'passed' ELSE 'failed' END AS status FROM (SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM ({_ISSUES}))",
)
def issue_status(spark, sf):
    return q.issue_status(_all_issues(spark, sf))


@register(
    "b16_feature_table_keys",
    """SELECT coalesce(o_orderkey, k) AS unit_id, CASE WHEN n IS NULL THEN 'missing_key' WHEN o_orderkey IS NULL THEN 'unexpected_key' ELSE 'duplicate_key' END AS code, coalesce(n, 0) AS observed
       FROM orders FULL JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) ON k = o_orderkey WHERE n IS NULL OR o_orderkey IS NULL OR n > 1""",
)
def feature_table_keys(spark, sf):
    return q.coverage_issues(_lines(spark, sf), _orders(spark, sf), ["unit_id"])


@register(
    "b16_feature_table_ranges",
    """SELECT 'negative:horizontal_energy' AS code, 'error' AS severity, count(*) AS violations FROM customer WHERE c_acctbal < 0
       UNION ALL SELECT 'entropy_range:vertical_spectral_entropy', 'error', count(*) FROM customer WHERE c_acctbal / 9000 < 0 OR c_acctbal / 9000 > 1
       UNION ALL SELECT 'frequency_range:vertical_centroid_hz', 'error', count(*) FROM customer WHERE c_acctbal < 0 OR c_acctbal > 5000""",
)
def feature_table_ranges(spark, sf):
    features = table(spark, sf, "customer").select(
        F.col("c_acctbal").alias("horizontal_energy"),
        (F.col("c_acctbal") / 9000).alias("vertical_spectral_entropy"),
        F.col("c_acctbal").alias("vertical_centroid_hz"),
    )
    return q.expect(features, q.feature_table_rules(features, F.lit(5000.0)))


@register(
    "b17_manifest_preconditions",
    """SELECT 'band_above_nyquist' AS code, 'error' AS severity, count(*) AS violations FROM part WHERE p_size / 2.0 < 12.8
       UNION ALL SELECT 'too_few_samples', 'error', count(*) FROM part WHERE p_size < 2""",
)
def manifest_preconditions(spark, sf):
    manifest = table(spark, sf, "part").select(F.col("p_partkey").alias("acquisition_number"), F.col("p_size").cast("double").alias("sampling_frequency_hz"))
    if q.schema_issues(manifest, {"acquisition_number": "bigint", "sampling_frequency_hz": "double"}):
        raise ValueError("the manifest lacks required columns")
    rate = F.col("sampling_frequency_hz")
    return q.expect(
        manifest,
        [("empty_key", q.ERROR, F.col("acquisition_number").isNull()), ("band_above_nyquist", q.ERROR, rate / 2 < 12.8), ("too_few_samples", q.ERROR, rate < 2)],
    )


@register(
    "b18_expectations",
    """SELECT c_mktsegment AS segment, code, severity, violations FROM (
         SELECT c_mktsegment, 'negative_balance' AS code, 'error' AS severity, count(*) FILTER (c_acctbal < 0) AS violations FROM customer GROUP BY 1
         UNION ALL SELECT c_mktsegment, 'no_order', 'warning', count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders)) FROM customer GROUP BY 1) WHERE violations > 0""",
)
def expectations(spark, sf):
    customers, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    active = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    checked = customers.join(active, "c_custkey", "left").withColumnRenamed("c_mktsegment", "segment")
    return q.expect(checked, [("negative_balance", q.ERROR, F.col("c_acctbal") < 0), ("no_order", q.WARNING, F.col("orders").isNull())], ["segment"])
