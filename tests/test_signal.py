import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.functions import signal as sg
from wearline.operators import signals as so

BANDS = [("low", 0.0, 64.0), ("high", 64.0, 512.0)]


def both_ways(spark, values, fs=1024.0, nperseg=1024, overlap=512):
    df = spark.createDataFrame([(1, [float(v) for v in values])], "id int, signal array<double>")
    jvm = so.spectral_features(so.time_features(df, "signal"), "signal", fs, nperseg, overlap, BANDS).first().asDict()
    arrow = so.feature_rows(df, ["id"], ["signal"], fs, nperseg, overlap, BANDS).first().asDict()
    for name in sg.feature_names(BANDS):
        a, b = jvm[name], arrow[f"signal_{name}"]
        assert (a is None) == (b is None), name
        assert a is None or a == pytest.approx(b, rel=1e-9, abs=1e-12), name
    return jvm


def test_closed_form(spark):
    f = both_ways(spark, [-2, -1, 1, 2])
    want = {"mean": 0, "variance": 2.5, "rms": math.sqrt(2.5), "energy": 10, "peak_to_peak": 4, "crest_factor": 2 / math.sqrt(2.5), "shape_factor": math.sqrt(2.5) / 1.5, "impulse_factor": 2 / 1.5, "skewness": 0, "kurtosis": 1.36}
    for name, value in want.items():
        assert f[name] == pytest.approx(value), name


def test_undefined_values_are_null(spark):
    zeros = both_ways(spark, [0] * 64)
    assert zeros["energy"] == 0 and zeros["total_spectral_power"] == 0 and zeros["dominant_frequency_hz"] == 0
    assert all(zeros[n] is None for n in ("crest_factor", "shape_factor", "skewness", "kurtosis", "spectral_centroid_hz", "spectral_entropy"))
    flat = both_ways(spark, [3] * 16)
    assert flat["std"] == 0 and flat["rms"] == 3 and flat["crest_factor"] == 1 and flat["kurtosis"] is None
    impulse = both_ways(spark, [0] * 7 + [4] + [0] * 8)
    assert impulse["energy"] == 16 and impulse["impulse_factor"] == 16


def test_sinusoid(spark):
    t = np.arange(4096) / 1024
    f = both_ways(spark, np.sin(2 * np.pi * 128 * t))
    for name in ("dominant_frequency_hz", "spectral_centroid_hz", "rms_frequency_hz"):
        assert abs(f[name] - 128) <= 1
    assert f["total_spectral_power"] == pytest.approx(0.5, rel=0.02) and 0 <= f["spectral_entropy"] <= 1
    with pytest.raises(ValueError):
        sg.channel_features(F.col("signal"), 1024.0, 64, 32, [("too_high", 0.0, 600.0)])


def test_divergence(spark):
    df = spark.createDataFrame([([0.2, 0.8], [0.5, 0.5])], "p array<double>, q array<double>")
    p, q = F.col("p"), F.col("q")
    r = df.select(sg.kl_divergence(p, p).alias("same"), sg.kl_divergence(p, q).alias("a"), sg.kl_divergence(q, p).alias("b"), sg.kl_divergence(p, q, symmetric=True).alias("s"), sg.kl_divergence(q, p, symmetric=True).alias("t")).first()
    assert r["same"] == pytest.approx(0) and r["a"] != pytest.approx(r["b"]) and r["s"] == pytest.approx(r["t"]) == pytest.approx((r["a"] + r["b"]) / 2)
    checks = spark.createDataFrame([([0.5, 0.5],), ([1.0, 1.0],), ([-0.5, 1.5],), ([float("nan"), 1.0],)], "p array<double>")
    assert [x[0] for x in checks.select(sg.valid_distribution(F.col("p"))).collect()] == [True, False, False, False]
