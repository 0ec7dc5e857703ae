"""Signal feature queries (survey rows D, E and M1-M6)."""

from pyspark.sql import functions as F

from wearline.functions import signal as sg
from wearline.functions.rounding import r6
from wearline.operators import signals as so
from wearline.plans.catalog import VIEWS, register
from wearline.sources.tables import UNIT, signals

FS, SEGMENT, OVERLAP = 64.0, 32, 16
BANDS = [("low", 0.0, 8.0), ("mid", 8.0, 20.0), ("high", 20.0, 32.0)]
KEYS = [*UNIT, "acquisition_number", "sequence_index"]

VIEWS["v_samples"] = """
SELECT acquisition_number, channel, CAST(unnest(x) AS DOUBLE) AS v, generate_subscripts(x, 1) - 1 AS i FROM (
  SELECT acquisition_number, 'signal' AS channel, signal AS x FROM v_signals
  UNION ALL SELECT acquisition_number, 'horizontal', horizontal FROM v_signals
  UNION ALL SELECT acquisition_number, 'vertical', vertical FROM v_signals)
"""
VIEWS["v_time"] = """
SELECT acquisition_number, channel, mean, sqrt(var) AS std, var AS variance, sqrt(sq / n) AS rms, lo AS minimum, hi AS maximum, top AS max_abs, hi - lo AS peak_to_peak,
       m3 / var ** 1.5 AS skewness, m4 / var ** 2 AS kurtosis, sq AS energy, top / sqrt(sq / n) AS crest_factor, sqrt(sq / n) / ma AS shape_factor, top / ma AS impulse_factor, top / (mr * mr) AS clearance_factor
FROM (SELECT acquisition_number, channel, any_value(m) AS mean, avg((v - m) ** 2) AS var, avg((v - m) ** 3) AS m3, avg((v - m) ** 4) AS m4, count(*) AS n,
             min(v) AS lo, max(v) AS hi, max(abs(v)) AS top, sum(v * v) AS sq, avg(abs(v)) AS ma, avg(sqrt(abs(v))) AS mr
      FROM (SELECT *, avg(v) OVER (PARTITION BY acquisition_number, channel) AS m FROM v_samples) GROUP BY 1, 2)
"""
VIEWS["v_psd"] = """
SELECT acquisition_number, channel, b, b * 2.0::DOUBLE AS f, avg(re * re + im * im) * CASE WHEN b IN (0, 16) THEN 1 ELSE 2 END / (64 * 12.0) AS p
FROM (SELECT acquisition_number, channel, k, b, sum(x * cos(2 * pi() * b * j / 32)) AS re, sum(x * sin(2 * pi() * b * j / 32)) AS im
      FROM (SELECT acquisition_number, channel, k, j, (v - avg(v) OVER (PARTITION BY acquisition_number, channel, k)) * (0.5 - 0.5 * cos(2 * pi() * j / 32)) AS x
            FROM (SELECT acquisition_number, channel, k, i - 16 * k AS j, v FROM v_samples, range(3) t(k) WHERE i >= 16 * k AND i < 16 * k + 32 AND (channel = 'signal' OR k = 0))),
           range(17) q(b) GROUP BY ALL) GROUP BY 1, 2, 3
"""
VIEWS["v_spectral"] = """
SELECT acquisition_number, channel, arg_max(f, p) AS dominant_frequency_hz, max(p) AS dominant_spectral_power, any_value(c) AS spectral_centroid_hz,
       sqrt(sum((f - c) ** 2 * p) / sum(p)) AS spectral_spread_hz, sqrt(sum(f * f * p) / sum(p)) AS rms_frequency_hz,
       -sum(p / t * ln(p / t)) / ln(17) AS spectral_entropy, sum((p + before) * 1.0) AS total_spectral_power,
       sum(p + before) FILTER (b BETWEEN 1 AND 4) AS band_power_low, sum(p + before) FILTER (b BETWEEN 5 AND 10) AS band_power_mid, sum(p + before) FILTER (b BETWEEN 11 AND 16) AS band_power_high
FROM (SELECT *, sum(f * p) OVER w / sum(p) OVER w AS c, sum(p) OVER w AS t, lag(p) OVER (PARTITION BY acquisition_number, channel ORDER BY b) AS before
      FROM v_psd WINDOW w AS (PARTITION BY acquisition_number, channel)) GROUP BY 1, 2
"""

_TIME = ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in sg.TIME_FEATURES)
_SPECTRAL_NAMES = [*sg.SPECTRAL_FEATURES, *[f"band_power_{b[0]}" for b in BANDS]]
_SPECTRAL = ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in _SPECTRAL_NAMES)


@register("d_time_features", f"SELECT acquisition_number, {_TIME} FROM v_time WHERE channel = 'signal'")
def time_features(spark, sf):
    rows = so.time_features(signals(spark, sf).select("acquisition_number", "signal"), "signal")
    return rows.select("acquisition_number", *[r6(n).alias(n) for n in sg.TIME_FEATURES])


@register(
    "d16_invalid_signals",
    "SELECT condition_id, unit_id, acquisition_number, 'invalid_signal' AS code FROM v_signals WHERE list_min(signal) < -0.35",
)
def invalid_signals(spark, sf):
    # a square root turns strong negative peaks into NaN samples
    broken = signals(spark, sf).withColumn("signal", F.transform("signal", lambda v: F.sqrt(v + F.lit(0.35).cast("double"))))
    return so.invalid_signals(broken, [*UNIT, "acquisition_number"], "signal")


@register("e1_welch_psd", "SELECT acquisition_number, CAST(b AS INTEGER) AS bin, f AS frequency_hz, round(p, 9) + 0.0 AS density FROM v_psd WHERE channel = 'signal'")
def welch_psd(spark, sf):
    psd = signals(spark, sf).select("acquisition_number", sg.welch_psd(F.col("signal"), FS, SEGMENT, OVERLAP).alias("p"))
    return psd.select("acquisition_number", F.posexplode("p").alias("bin", "density")).select(
        "acquisition_number", "bin", (F.col("bin") * FS / SEGMENT).alias("frequency_hz"), r6("density", 9).alias("density")
    )


@register("e2_spectral_features", f"SELECT acquisition_number, {_SPECTRAL} FROM v_spectral WHERE channel = 'signal'")
def spectral_features(spark, sf):
    rows = so.spectral_features(signals(spark, sf).select("acquisition_number", "signal"), "signal", FS, SEGMENT, OVERLAP, BANDS)
    return rows.select("acquisition_number", *[r6(n).alias(n) for n in _SPECTRAL_NAMES])


_WIDE = ", ".join(f"round({c[0]}{t}.{n}, 6) + 0.0 AS {c}_{n}" for c in ("horizontal", "vertical") for t, names in (("t", sg.TIME_FEATURES), ("s", _SPECTRAL_NAMES)) for n in names)


@register(
    "e10_feature_rows",
    f"""SELECT acquisition_number, {_WIDE} FROM (SELECT * FROM v_time WHERE channel = 'horizontal') ht JOIN (SELECT * FROM v_time WHERE channel = 'vertical') vt USING (acquisition_number)
        JOIN (SELECT * FROM v_spectral WHERE channel = 'horizontal') hs USING (acquisition_number) JOIN (SELECT * FROM v_spectral WHERE channel = 'vertical') vs USING (acquisition_number)""",
)
def feature_rows(spark, sf):
    rows = so.feature_rows(signals(spark, sf), ["acquisition_number"], ["horizontal", "vertical"], FS, SEGMENT, OVERLAP, BANDS)
    return rows.select("acquisition_number", *[r6(c).alias(c) for c in rows.columns[1:]])


VIEWS["v_binned"] = """
SELECT acquisition_number, kind, k, CAST((mass + 1e-12) / sum(mass + 1e-12) OVER (PARTITION BY acquisition_number, channel, kind) AS FLOAT) AS mass, channel
FROM (SELECT a.acquisition_number, a.channel, a.kind, bins.k, coalesce(sum(p.p + q.p) FILTER (p.f IS NOT NULL), 0) AS mass
      FROM (SELECT s.acquisition_number, channel, kind, CASE kind WHEN 'uniform' THEN 32.0 ELSE 2.0 * (10 + condition_id) END / 8 AS w FROM v_signals s,
            (VALUES ('uniform'), ('shaft')) t(kind), (VALUES ('signal'), ('horizontal'), ('vertical')) c(channel)) a, range(8) bins(k)
      LEFT JOIN v_psd p ON p.acquisition_number = a.acquisition_number AND p.channel = a.channel AND p.f >= bins.k * a.w AND (p.f < (bins.k + 1) * a.w OR bins.k = 7 AND p.f = 8 * a.w)
                AND p.f + 2 >= bins.k * a.w AND (p.f + 2 < (bins.k + 1) * a.w OR bins.k = 7 AND p.f + 2 = 8 * a.w)
      LEFT JOIN v_psd q ON q.acquisition_number = p.acquisition_number AND q.channel = p.channel AND q.b = p.b + 1 GROUP BY ALL)
"""


def _vectors(spark, sf, channel="signal"):
    shaft_hz = (F.col("condition_id") + 10).cast("double")
    return (
        signals(spark, sf)
        .withColumn("uniform", sg.binned_distribution(F.col(channel), F.lit(FS / 2), FS, SEGMENT, OVERLAP, 8))
        .withColumn("shaft", sg.binned_distribution(F.col(channel), shaft_hz * 2.0, FS, SEGMENT, OVERLAP, 8))
    )


def _listed(kind):
    def query(spark, sf):
        rows = _vectors(spark, sf).select("acquisition_number", F.posexplode(kind).alias("bin", "mass"))
        return rows.select("acquisition_number", "bin", r6("mass", 5).alias("mass"))

    return query


for _name, _kind in (("m1_binned_distribution", "uniform"), ("m2_shaft_distribution", "shaft")):
    register(
        _name,
        f"SELECT acquisition_number, CAST(k AS INTEGER) AS bin, round(CAST(mass AS DOUBLE), 5) + 0.0 AS mass FROM v_binned WHERE kind = '{_kind}' AND channel = 'signal'",
    )(_listed(_kind))


@register(
    "m3_distribution_check",
    """SELECT acquisition_number, lo >= 0 AND abs(total - 1) <= 1e-6 AS valid, total BETWEEN 0.999 AND 1.001 AS near_one
       FROM (SELECT acquisition_number, min(v) AS lo, sum(v) AS total FROM v_samples WHERE channel = 'signal' GROUP BY 1)""",
)
def distribution_check(spark, sf):
    raw = F.transform("signal", lambda v: v.cast("double"))
    return signals(spark, sf).select(
        "acquisition_number", sg.valid_distribution(F.col("signal")).alias("valid"), sg.array_sum(raw).between(0.999, 1.001).alias("near_one")
    )


_DIVERGENCE = """WITH ref AS (SELECT unit_id, channel, k, m / sum(m) OVER (PARTITION BY unit_id, channel) AS q FROM (
         SELECT unit_id, channel, k, median(CAST(mass AS DOUBLE)) AS m FROM v_binned JOIN v_signals USING (acquisition_number) WHERE kind = 'uniform' AND sequence_index < 10 GROUP BY 1, 2, 3)),
       d AS (SELECT acquisition_number, channel, sum(a * ln(a / b)) AS forward, (sum(a * ln(a / b)) + sum(b * ln(b / a))) / 2 AS sym FROM (
         SELECT acquisition_number, channel, p / sum(p) OVER w AS a, q / sum(q) OVER w AS b FROM (
           SELECT acquisition_number, v.channel, greatest(CAST(mass AS DOUBLE), 1e-12) AS p, greatest(CAST(CAST(q AS FLOAT) AS DOUBLE), 1e-12) AS q FROM v_binned v JOIN v_signals s USING (acquisition_number)
           JOIN ref r ON r.unit_id = s.unit_id AND r.k = v.k AND r.channel = v.channel WHERE kind = 'uniform') WINDOW w AS (PARTITION BY acquisition_number, channel)) GROUP BY 1, 2)"""


@register("m4_divergence", _DIVERGENCE + " SELECT acquisition_number, round(forward, 4) + 0.0 AS kl, round(sym, 4) + 0.0 AS symmetric_kl FROM d WHERE channel = 'signal'")
def divergence(spark, sf):
    rows = _vectors(spark, sf)
    joined = rows.join(so.reference_distribution(rows, UNIT, "uniform", 10), UNIT)
    p, q = F.col("uniform"), F.col("reference")
    return joined.select("acquisition_number", r6(sg.kl_divergence(p, q), 4).alias("kl"), r6(sg.kl_divergence(p, q, symmetric=True), 4).alias("symmetric_kl"))


@register(
    "m5_reference_distribution",
    """SELECT unit_id, CAST(k AS INTEGER) AS bin, round(CAST(CAST(m / sum(m) OVER (PARTITION BY unit_id) AS FLOAT) AS DOUBLE), 5) + 0.0 AS mass FROM (
         SELECT unit_id, k, median(CAST(mass AS DOUBLE)) AS m FROM v_binned JOIN v_signals USING (acquisition_number) WHERE kind = 'uniform' AND channel = 'signal' AND sequence_index < 10 GROUP BY 1, 2)""",
)
def reference_distribution(spark, sf):
    ref = so.reference_distribution(_vectors(spark, sf), UNIT, "uniform", 10)
    return ref.select("unit_id", F.posexplode("reference").alias("bin", "mass")).select("unit_id", "bin", r6("mass", 5).alias("mass"))


@register(
    "m6_channel_combine",
    _DIVERGENCE + """ SELECT h.acquisition_number, round(greatest(h.sym, v.sym), 4) + 0.0 AS maximum, round((h.sym + v.sym) / 2, 4) + 0.0 AS mean
       FROM (SELECT * FROM d WHERE channel = 'horizontal') h JOIN (SELECT * FROM d WHERE channel = 'vertical') v USING (acquisition_number)""",
)
def channel_combine(spark, sf):
    rows = signals(spark, sf)
    for c in ("horizontal", "vertical"):
        rows = rows.withColumn(f"{c}_p", sg.binned_distribution(F.col(c), F.lit(FS / 2), FS, SEGMENT, OVERLAP, 8))
    joined = rows
    for c in ("horizontal", "vertical"):
        joined = joined.join(so.reference_distribution(rows, UNIT, f"{c}_p", 10, f"{c}_q"), UNIT)
    h, v = (sg.kl_divergence(F.col(f"{c}_p"), F.col(f"{c}_q"), symmetric=True) for c in ("horizontal", "vertical"))
    return joined.select("acquisition_number", h.alias("h"), v.alias("v")).select(
        "acquisition_number", r6(F.greatest("h", "v"), 4).alias("maximum"), r6((F.col("h") + F.col("v")) / 2, 4).alias("mean")
    )
