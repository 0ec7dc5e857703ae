"""Permutation donors by hash ranges, and subsets taken from rows that are written once."""

import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wearline.operators import rul
from wearline.operators.folds import balanced_weights, unit_weights
from wearline.plans import rul as plans


def test_hash_ranges_give_the_places_of_one_order(spark, monkeypatch):
    rows = [(f, i, i % 7, float(i), i / 3) for f in (0, 1) for i in range(f * 1000, f * 1000 + 300 - 50 * f)]
    df = spark.createDataFrame(rows, "fold int, number bigint, unit_id bigint, a double, b double").repartition(3)
    monkeypatch.setattr(rul, "RANGE_ROWS", 40)
    plain, ranged = (rul.permuted_inputs(df, ["a", "b"], "number", 2, split=split) for split in (False, True))
    assert "_range" in ranged._jdf.queryExecution().optimizedPlan().toString()
    assert ranged.columns == ["fold", "number", "unit_id", "feature", "repeat", "a", "b"]
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, ranged.collect()))
    got = {(r["fold"], r["feature"], r["repeat"], r["number"]): (r["a"], r["b"]) for r in ranged.collect()}
    for fold in (0, 1):
        held = [r for r in rows if r[0] == fold]
        for feature in "ab":
            for repeat in range(2):
                donors = sorted(held, key=lambda r: (hashlib.md5(f"42:{feature}:{repeat}:{r[1]}".encode()).hexdigest(), r[1]))  # noqa: B023
                for row, donor in zip(held, donors, strict=True):
                    assert got[fold, feature, repeat, row[1]] == ((donor[3], row[4]) if feature == "a" else (row[3], donor[4]))


def test_rows_are_repeated_by_key_and_value_only(spark):
    df = spark.createDataFrame([(0, i, i * 1.0, "wide") for i in range(9)], "fold int, number bigint, a double, note string")
    plan = rul.permuted_inputs(df, ["a"], "number", 3, split=False)._jdf.queryExecution().optimizedPlan().toString()
    repeated = [line for line in plan.splitlines() if "Generate" in line]
    assert len(repeated) == 1 and "note" not in repeated[0]  # before, a second one repeated whole rows


@pytest.fixture
def events(spark, tmp_path):
    sizes = [25, 3, 21, 9, 30, 1, 22, 24, 28, 5, 26, 23, 27, 29, 31]
    rows = [(u, k) for u, n in enumerate(sizes) for k in range(n)]
    frame = pd.DataFrame({"user_id": [u for u, _ in rows], "event_id": range(len(rows)), "value": [float(u * 3 + k * k % 11) for u, k in rows]})
    df = spark.createDataFrame(frame).withColumns(
        {"ts": F.timestamp_seconds("event_id"), "event_type": F.lit("view"), "props": F.format_string('{"k": %d}', F.col("event_id") % 13)}
    )
    df.write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_subsets_are_taken_from_rows_written_once(spark, events, monkeypatch):
    rows = plans.planned(spark, events)
    plan = plans.folds(spark, events)
    for subset in plans.SUBSETS:
        want = plans.readings(spark, events).join(plan.where(F.col("subset") == subset).select("fold", "subset", "unit_id"), "unit_id")
        got = plans.by_subset(spark, events, subset, rows)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.drop("event_type").collect())) == sorted(map(tuple, want.drop("event_type").collect()))
    calls = []
    monkeypatch.setattr(plans, "planned", lambda *a, _plan=plans.planned: calls.append(1) or _plan(*a))
    plans.countdown_lifetimes(spark, events)
    assert len(calls) == 1


def test_windows_are_weighted_as_their_rows_were(spark, events, monkeypatch):
    trains = []
    monkeypatch.setattr(plans.rul, "ridge_fits", lambda train, *a, _fit=rul.ridge_fits, **k: trains.append(train) or _fit(train, *a, **k))
    monkeypatch.setattr(plans, "LENGTHS", (5,))
    plans.sequence_candidates(spark, events, "validation")
    windows = plans.by_subset(spark, events, "train").where("sequence_index >= 4").select("fold", "unit_id", "sequence_index", "rul_minutes", "horizontal")
    want = balanced_weights(windows, ["fold"]).select("fold", "unit_id", "sequence_index", "rul_minutes", "horizontal", F.round("sample_weight", 12))
    got = trains[0].select("fold", "unit_id", "sequence_index", "rul_minutes", "horizontal_lag0", F.round("sample_weight", 12))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert unit_weights(windows, ["fold"]).count() == windows.select("fold", "unit_id").distinct().count()
    plan = trains[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Join")  # weights join the readings below the windows
