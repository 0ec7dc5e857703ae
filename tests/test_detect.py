import numpy as np
import pandas as pd
import pytest

from wearline.operators import detect as de
from wearline.operators import sequences as sq


def frame(spark, values):
    n = len(values)
    return spark.createDataFrame(pd.DataFrame({"unit_id": 1, "sequence_index": np.arange(n), "total_acquisitions": n, "baseline_acquisitions": 3, "normalized": np.asarray(values, float)}))


def alarm(spark, values, post=2):
    return de.persistent_alarm(frame(spark, values), ["unit_id"], [(4.0, 3)], 0, post, 4.0).first()


def test_alarm_needs_persistence(spark):
    assert alarm(spark, [1, -1, 0, 2, 7, 6.5, 8, 1, 0, 2, 1])["alarm_confirmation_index"] == 6
    single = alarm(spark, [1, 0, -1, 2, 4.5, 1, 3, 2, 0, 1])
    assert single["detection_status"] == "not_detected" and single["first_threshold_crossing_index"] == 4


def test_alarm_ignores_the_future(spark):
    for tail in ([1, 2, 0, 3], [400, -9, 31, 60]):
        assert alarm(spark, [2, 1, 0, 3, 6, 9, 4.25, *tail])["alarm_confirmation_index"] == 6
    assert alarm(spark, [2, 1, 0, 3, 6, 9, 4.25, 1])["detection_status"] == "not_detected"


@pytest.mark.parametrize("span", [1, 2, 3, 9, 20])
def test_ewma_over_segments(spark, span):
    rng = np.random.default_rng(span)
    x = rng.normal(10, 3, 3000)
    got = de.ewma(frame(spark, x), ["unit_id"], "normalized", span, "s").orderBy("sequence_index").toPandas()["s"].to_numpy()
    assert np.allclose(got, pd.Series(x).ewm(span=span, adjust=False).mean().to_numpy(), rtol=1e-12)


def test_trailing_median_and_trends(spark):
    rows = de.causal_aggregate(frame(spark, [7, 3, 250, 8, 5]), ["unit_id"], "normalized", 3, "median", "m").orderBy("sequence_index").toPandas()
    assert list(rows["m"]) == [7, 5, 7, 8, 8]
    trend = de.trend_features(frame(spark, [10, 7, 4, 1, -2]).withColumnRenamed("normalized", "f"), ["unit_id"], "f", 3, (3,)).orderBy("sequence_index").toPandas()
    assert np.allclose(trend["f__w3_slope"], [0, -3, -3, -3, -3]) and list(trend["f__first_difference"]) == [0, -3, -3, -3, -3] and list(trend["f__baseline_difference"]) == [3, 0, -3, -6, -9]


def test_sequences(spark):
    rows = spark.createDataFrame([(u, i, float(10 * u + i)) for u in (0, 1) for i in range(5)], "unit_id int, sequence_index long, f double")
    out = sq.build_sequences(rows, ["unit_id"], ["f"], 3).orderBy("unit_id", "sequence_index").collect()
    assert len(out) == 6 and [s["f"] for s in out[0]["steps"]] == [0, 1, 2] and [s["f"] for s in out[3]["steps"]] == [10, 11, 12]
    with pytest.raises(Exception, match="gap"):
        sq.build_sequences(rows.where("sequence_index <> 2"), ["unit_id"], ["f"], 3).collect()
    cover = sq.coverage(rows, ["unit_id"], 3).first()
    assert cover["dropped_prefix"] == 2 and cover["eligible_sequences"] == 3
