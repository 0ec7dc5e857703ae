"""Streaming forms of the trailing operators: features, alarms, trends, late and duplicate acquisitions.

Between micro-batches a unit's state is bounded: a few trailing values and at most `WAITING` acquisitions that wait for an earlier number.
A unit's rows may arrive in any order and in any micro-batch; they are handled in number order. An acquisition that is still
missing when `WAITING` later ones have come is given up: the unit goes on behind it, and should it come after all it is too late. The alarm
has no look-ahead, so it equals the batch alarm with `minimum_post = 0`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wearline.operators.detect import EPSILON
from wearline.session import scratch


#: Acquisitions of a unit that may wait for one that is missing.
WAITING = 10_000


def table_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A growing folder of Parquet files as a stream; only files of the named table are read."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def run_available(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process what the source holds now into a Parquet table with its own checkpoint, and read it back."""
    spark = stream.sparkSession
    out = scratch(spark, label)
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def deduplicated(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """Drop repeated acquisitions that arrive within the watermark delay, and forget older keys."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def time_windows(df: DataFrame, unit: Sequence[str], time: str, value: str, width: str, slide: str | None = None) -> DataFrame:
    """Tumbling or sliding event-time summaries per unit; works on batch and streaming tables."""
    return df.groupBy(*unit, F.window(time, width, slide).alias("_w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("highest")
    ).select(*unit, F.col("_w.start").alias("window_start"), "n", "mean", "highest")


def sessions(df: DataFrame, unit: Sequence[str], time: str, value: str, gap: str) -> DataFrame:
    """Activity sessions per unit, closed by `gap` without an acquisition."""
    return df.groupBy(*unit, F.session_window(time, gap).alias("_w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(
        *unit, F.col("_w.start").alias("window_start"), "n", "mean"
    )


class _InOrder:
    """Releases acquisitions by index; early ones wait, repeated ones and those given up are ignored."""

    def __init__(self, following: int, waiting: dict[int, float], limit: int = WAITING) -> None:
        self.following, self.waiting, self.limit = following, waiting, limit

    def release(self, batches: Iterator[pd.DataFrame], value: str) -> Iterator[tuple[int, float]]:
        for pdf in batches:
            for i, v in zip(pdf["sequence_index"].to_numpy(), pdf[value].to_numpy(float)):
                if i >= self.following:
                    self.waiting.setdefault(int(i), float(v))
            yield from self._consecutive()
        while len(self.waiting) > self.limit:  # a whole micro-batch is in: what is still missing is given up
            self.following = min(self.waiting)
            yield from self._consecutive()

    def _consecutive(self) -> Iterator[tuple[int, float]]:
        while self.following in self.waiting:
            yield self.following, self.waiting.pop(self.following)
            self.following += 1

    def state(self) -> tuple[int, list[int], list[float]]:
        return self.following, list(self.waiting), list(self.waiting.values())


_QUEUE = "following bigint, waiting array<bigint>, waiting_values array<double>"


def _alarm_step(value: str, baseline: int, window: int, threshold: float, persistence: int, gap: int, effect: float) -> Callable:
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, waiting, values, raw, early, center, spread, tail, done = state.get if state.exists else (0, [], [], [], [], None, None, [], False)
        queue = _InOrder(following, dict(zip(waiting, values)))
        raw, early, tail = list(raw), list(early), list(tail)
        found: list[tuple] = []
        for i, v in queue.release(batches, value):
            raw = [*raw, v][-window:]
            level = float(np.median(raw))
            if i < baseline:
                early.append(level)
            elif not done:
                if center is None:  # the baseline is complete: only its centre and spread stay
                    base = np.array(early or [level])
                    center = float(np.median(base))
                    spread, early = max(float(np.median(np.abs(base - center))), EPSILON), []
                tail = [*tail, (level - center) / spread][-(persistence + gap):]
                hits = [x for x in tail if x > threshold]
                if len(hits) >= persistence and float(np.median(hits)) >= effect:
                    done = True
                    found.append((*key, i, len(hits), tail[-1]))
        state.update((*queue.state(), raw, early, center, spread, tail, done))
        if found:
            yield pd.DataFrame(found, columns=["condition_id", "unit_id", "alarm_confirmation_index", "persistence_duration", "normalized"])

    return step


def online_alarms(
    stream: DataFrame, value: str, baseline: int, window: int, threshold: float, persistence: int, gap: int, effect: float
) -> DataFrame:
    """One row per unit at the moment its alarm is confirmed. The stream carries condition_id, unit_id and sequence_index."""
    return stream.groupBy("condition_id", "unit_id").applyInPandasWithState(
        _alarm_step(value, baseline, window, threshold, persistence, gap, effect),
        "condition_id bigint, unit_id bigint, alarm_confirmation_index bigint, persistence_duration bigint, normalized double",
        f"{_QUEUE}, raw array<double>, early array<double>, center double, spread double, tail array<double>, done boolean",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def _trend_step(value: str, window: int) -> Callable:
    alpha = 2.0 / (window + 1)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, waiting, values, tail, smooth = state.get if state.exists else (0, [], [], [], 0.0)
        queue = _InOrder(following, dict(zip(waiting, values)))
        tail = list(tail)
        rows: list[tuple] = []
        for i, v in queue.release(batches, value):
            change = v - tail[-1] if tail else 0.0
            tail = [*tail, v][-window:]
            smooth = v if i == 0 else alpha * v + (1 - alpha) * smooth
            x = np.arange(len(tail)) - (len(tail) - 1) / 2
            slope = float(x @ np.array(tail) / (x @ x)) if len(tail) > 1 else 0.0
            rows.append((*key, i, change, float(np.mean(tail)), float(np.median(tail)), float(np.std(tail)), smooth, slope))
        state.update((*queue.state(), tail, smooth))
        if rows:
            yield pd.DataFrame(rows, columns=["condition_id", "unit_id", "sequence_index", "first_difference", "mean", "median", "std", "ewma", "slope"])

    return step


def online_trends(stream: DataFrame, value: str, window: int) -> DataFrame:
    """Trailing statistics of every acquisition as soon as all earlier ones have arrived."""
    return stream.groupBy("condition_id", "unit_id").applyInPandasWithState(
        _trend_step(value, window),
        "condition_id bigint, unit_id bigint, sequence_index bigint, first_difference double, mean double, median double, std double, ewma double, slope double",
        f"{_QUEUE}, tail array<double>, smooth double",
        "append",
        GroupStateTimeout.NoTimeout,
    )
