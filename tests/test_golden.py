"""Published results that follow from the fifteen unit lifetimes alone."""

import pytest
from pyspark.sql import functions as F

from wearline.operators import folds as fo
from wearline.operators import manifest as mf
from wearline.operators import metrics as me
from wearline.operators import rul
from wearline.operators import stats as st

# Acquisitions per unit, five units in each of three conditions.
LIFETIMES = [[123, 161, 158, 122, 52], [491, 161, 533, 42, 339], [2538, 2496, 371, 1515, 114]]


@pytest.fixture(scope="module")
def predictions(spark):
    units = spark.createDataFrame([(c + 1, 10 * (c + 1) + u, n) for c, row in enumerate(LIFETIMES) for u, n in enumerate(row)], "condition_id long, unit_id long, n int")
    rows = mf.add_life_targets(units.select("condition_id", "unit_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("sequence_index")), ["unit_id"], 1.0)
    rows = rows.withColumn("acquisition_number", F.col("sequence_index") + 1)
    assert rows.count() == 9216
    plan = fo.rotate_folds(rows, 5).select("fold", "subset", "unit_id")
    joined = rows.join(plan, "unit_id")
    train = fo.balanced_weights(joined.where("subset = 'train'"), ["fold"])
    test = joined.where("subset = 'test'")
    a = rul.countdown(test, rul.countdown_lifetimes(train)).withColumns({"experiment": F.lit("countdown"), "model": F.lit("a")})
    b = test.join(rul.weighted_median(train, ["fold"], "rul_minutes"), "fold").withColumnRenamed("weighted_median", "prediction_raw_minutes").withColumns({"experiment": F.lit("median"), "model": F.lit("b")})
    return mf.prediction_diagnostics(a.unionByName(b)).cache()


def test_baselines_reproduce(predictions):
    units = me.unit_metrics(predictions)
    table = {r["experiment"]: r for r in me.model_comparison(predictions, units, me.fold_metrics(units)).collect()}
    want = {
        "countdown": (519.2983673835664, 537.1249798696583, 847.6421440972222, -306.90342881944446, 158.5121951219512),
        "median": (269.63163920075476, 316.612798180363, 783.1449652777778, -767.4494357638889, 96.08849557522124),
    }
    for name, values in want.items():
        r = table[name]
        assert (r["macro_mae"], r["macro_rmse"], r["global_mae"], r["global_signed_error"], r["median_unit_mae"]) == pytest.approx(values, rel=1e-9)


def test_paired_difference_reproduces(predictions):
    table = st.paired_differences(me.unit_metrics(predictions), "countdown", "median").withColumn("all", F.lit(1))
    row = st.summarize_differences(table, ["all"]).first()
    assert (row["mean_delta_mae"], row["median_delta_mae"], row["wins"]) == (pytest.approx(249.66672818281162), pytest.approx(24.5), 7)
