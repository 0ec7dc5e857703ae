"""Group operators that stay correct and balanced when one group holds a large share of all rows.

Every operator here has one contract and two plans. While the sources are small enough for one task (`fits_one_task`) or the
largest group is (`task_rows`), the ordinary window or aggregate is the cheapest plan. Beyond it, groups are split:
running totals by range blocks with carried block totals, percentiles by counted values, trailing
frames by fixed-length index segments that repeat the few rows in front of them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearline.session import cut, fits_one_task, task_rows

SEGMENT_ROWS = 65_536
#: Bins per group in which large groups are counted before the values of a few bins are, and the most groups that takes place for.
BINS, BINNED_GROUPS = 1024, 10_000
#: Share of a task's bytes below which sources are small even if the rows made of them are many more.
TINY = 1 / 16


def groups_fit(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether no group of `keys` has more rows than a task holds."""
    most = task_rows(df.sparkSession)
    return most > 0 and (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0) <= most


def groups_small(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether the sources are small, or every group is."""
    return fits_one_task(df) or groups_fit(df, keys)


def settled(df: DataFrame) -> DataFrame:
    """The rows, written once unless their sources are tiny: for rows that are read again, be it to count their groups."""
    return df if fits_one_task(df, TINY) else cut(df)


def _is_small(df: DataFrame, keys: Sequence[str], split: bool | None) -> bool:
    """Whether the one-task plan serves: the sources are small, or every group is."""
    return groups_small(df, keys) if split is None else not split


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys equal each other; the key columns come from the left."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys] or [F.lit(True)]
    return left.join(renamed, reduce(lambda a, b: a & b, condition), how).drop(*[f"_right_{k}" for k in keys])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    totals: Mapping[str, tuple[str, Column]],
    split: bool | None = None,
    exclusive: bool = False,
) -> DataFrame:
    """Add running aggregates; `totals` maps a new column to (``sum``|``min``|``max``, expression).

    With `exclusive` the row itself is left out, so the first row of a group gets NULL; so does one with only NULLs so far.
    NULL keys form a group of their own.

    `order` must be unique inside a group. The split plan range-partitions on keys + order, so a hot
    group is spread over many blocks, and adds to each block the combined totals of its earlier blocks.
    """
    fold = {"sum": F.sum, "min": F.min, "max": F.max}
    join = {"sum": lambda a, b: F.coalesce(a + b, a, b), "min": F.least, "max": F.greatest}
    last = -1 if exclusive else 0
    if _is_small(df, keys, split):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
        return df.select("*", *[fold[kind](expr).over(w).alias(name) for name, (kind, expr) in totals.items()])

    blocks = cut(
        df.select("*", *[expr.alias(f"_v_{name}") for name, (_, expr) in totals.items()])
        .repartitionByRange(*[F.col(k) for k in keys], *order)
        .withColumn("_block", F.spark_partition_id())
    )
    block_keys = [*keys, "_block"]
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocks.groupBy(*block_keys)
        .agg(*[fold[kind](f"_v_{name}").alias(f"_b_{name}") for name, (kind, _) in totals.items()])
        .select(*block_keys, *[fold[kind](f"_b_{name}").over(earlier).alias(f"_c_{name}") for name, (kind, _) in totals.items()])
    )
    inside = Window.partitionBy(*block_keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    return same_keys(blocks, carried, block_keys).select(
        *df.columns,
        *[join[kind](F.col(f"_c_{name}"), fold[kind](f"_v_{name}").over(inside)).alias(name) for name, (kind, _) in totals.items()],
    )


def with_totals(
    df: DataFrame, keys: Sequence[str], totals: Mapping[str, Column], split: bool | None = None
) -> DataFrame:
    """Add whole-group aggregates to every row; the split plan pre-aggregates and joins back."""
    if _is_small(df, keys, split):
        w = Window.partitionBy(*keys)
        return df.select("*", *[agg.over(w).alias(name) for name, agg in totals.items()])
    spots = keys or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(0))
    grouped = rows.groupBy(*spots).agg(*[agg.alias(name) for name, agg in totals.items()])
    return same_keys(rows, grouped, spots, "left").select(*df.columns, *totals)


def _near_ranks(values: DataFrame, spots: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """The rows (`spots`, `_x`) whose values share a bin with a wanted percentile, with the number of rows `_skipped` below that `_bin`.

    Bins are equal steps between a group's least and largest value and rise with it, so the result is exact whatever the distribution; a
    group whose ends are not finite is one bin.
    """
    ends = values.groupBy(*spots).agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    share = F.try_divide(F.col("_x") - F.col("_low"), F.col("_high") - F.col("_low"))
    finite = F.abs(F.col("_high") - F.col("_low")) < float("inf")
    binned = same_keys(values, F.broadcast(ends), spots).select(
        *spots, "_x", F.coalesce(F.when(finite, F.floor(share * BINS)), F.lit(0).cast("bigint")).alias("_bin")
    )
    w = Window.partitionBy(*spots)
    counted = binned.groupBy(*spots, "_bin").agg(F.count(F.lit(1)).alias("_n")).select(
        *spots, "_bin", "_n", F.sum("_n").over(w.orderBy("_bin")).alias("_end"), F.sum("_n").over(w).alias("_size")
    )
    spot = lambda p: F.lit(p) * (F.col("_size") - 1)
    asked = any_of([(F.col("_end") > F.floor(spot(p))) & (F.col("_end") - F.col("_n") <= F.ceil(spot(p))) for p in probs])
    bins = counted.where(asked).select(*spots, "_bin", (F.col("_end") - F.col("_n")).alias("_skipped"), "_size")
    return same_keys(binned, F.broadcast(bins), [*spots, "_bin"])


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: Mapping[str, tuple[Column, float]],
    aggregates: Mapping[str, Column] | None = None,
    split: bool | None = None,
    grown: bool = False,
) -> DataFrame:
    """Exact interpolated percentiles per group, plus ordinary `aggregates` of the same rows.

    `grown` says that the rows may be far more than the sources have: beyond tiny sources they are written once and their groups counted. Large
    ones are then counted in bins, and only the values of the bins that hold a wanted percentile one by one.

    The split plan counts equal values first and reads each percentile off the running counts, so no
    task holds a group's values. A group with only NULLs keeps its row and gets NULL.
    """
    aggregates = aggregates or {}
    plain = [agg.alias(name) for name, agg in aggregates.items()]
    values: dict[str, tuple[Column, dict[str, float]]] = {}
    for name, (value, p) in wanted.items():  # a long expression's text may be shortened, so it is not a key
        text = str(value)
        values.setdefault(name if "more fields" in text or len(text) > 500 else text, (value, {}))[1][name] = p
    binned = grown and bool(split)
    if grown and split is None and not fits_one_task(df, TINY):
        df = cut(df)
        groups, largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.count("_n"), F.max("_n")).first()
        split = (largest or 0) > task_rows(df.sparkSession)
        binned = groups <= BINNED_GROUPS
    if _is_small(df, keys, split):
        # one buffer per value, whatever the number of its percentiles
        lists = [F.percentile(v, F.array(*[F.lit(float(p)) for p in probs.values()])).alias(f"_p{i}") for i, (v, probs) in enumerate(values.values())]
        picks = {n: F.get(f"_p{i}", F.lit(j)).alias(n) for i, (_, probs) in enumerate(values.values()) for j, n in enumerate(probs)}
        return df.groupBy(*keys).agg(*plain, *lists).select(*keys, *aggregates, *[picks[n] for n in wanted])
    spots = list(keys) or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(0))
    result = rows.groupBy(*spots).agg(*plain, F.count(F.lit(1)).alias("_rows"))
    for value, probs in values.values():
        known = rows.select(*spots, value.cast("double").alias("_x")).where("_x IS NOT NULL")
        if binned:
            inside = [*spots, "_bin", "_skipped", "_size"]
            counts = _near_ranks(known, spots, list(probs.values())).groupBy(*inside, "_x").agg(F.count(F.lit(1)).alias("_n"))
            placed = running(counts, inside, ["_x"], {"_upto": ("sum", F.col("_n"))}, split=True).withColumn("_upto", F.col("_upto") + F.col("_skipped"))
        else:
            counts = known.groupBy(*spots, "_x").agg(F.count(F.lit(1)).alias("_n"))
            ranked = running(counts, spots, ["_x"], {"_upto": ("sum", F.col("_n"))}, split=True)
            placed = same_keys(ranked, ranked.groupBy(*spots).agg(F.max("_upto").alias("_size")), spots)
        picks = []
        for name, p in probs.items():
            spot = F.lit(p) * (F.col("_size") - 1)
            picks += [
                F.min(F.when(F.col("_upto") > F.floor(spot), F.col("_x"))).alias(f"_lo_{name}"),
                F.min(F.when(F.col("_upto") > F.ceil(spot), F.col("_x"))).alias(f"_hi_{name}"),
                F.max(spot - F.floor(spot)).alias(f"_f_{name}"),
            ]
        picked = placed.groupBy(*spots).agg(*picks).select(
            *spots,
            *[((1 - F.col(f"_f_{n}")) * F.col(f"_lo_{n}") + F.col(f"_f_{n}") * F.col(f"_hi_{n}")).alias(n) for n in probs],
        )
        result = same_keys(result, picked, spots, "left")
    return result.select(*keys, *aggregates, *wanted)


def with_percentiles(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[Column, float]], split: bool | None = None) -> DataFrame:
    """Add exact interpolated percentiles of its group to every row; rows with a NULL among `keys` are dropped, as an equi-join would.

    Small groups take one window and no join, so nothing of the size of the groups is broadcast through the driver.
    """
    if not _is_small(df, keys, split):
        return df.join(percentiles(df, keys, wanted, split=True), list(keys))
    w = Window.partitionBy(*keys)
    known = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    return known.select("*", *[F.percentile(value, F.lit(float(p))).over(w).alias(name) for name, (value, p) in wanted.items()])


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, rank: str, split: bool | None = None) -> DataFrame:
    """Add the 1-based average rank of `value` inside its group (ties share their mean position; NULLs come first and tie).

    Beyond tiny sources groups are counted, as the bytes of a written table say little about its rows.
    """
    small = not split if split is not None else fits_one_task(df, TINY) or groups_fit(df, keys)
    if small:
        below = F.rank().over(Window.partitionBy(*keys).orderBy(value))
        ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
        return df.withColumn(rank, below + (ties - 1) / 2.0)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_ties"))
    upto = running(counts, keys, [value], {"_upto": ("sum", F.col("_ties"))}, split=True)
    ranks = upto.select(*keys, value, (F.col("_upto") - (F.col("_ties") - 1) / 2.0).alias(rank))
    return same_keys(df, ranks, [*keys, value]).select(*df.columns, rank)


def index_units(df: DataFrame, unit: Sequence[str], order: Sequence[str], split: bool | None = None) -> DataFrame:
    """Zero-based chronological `sequence_index` of every row inside its unit."""
    counted = running(df, unit, order, {"_nth": ("sum", F.lit(1).cast("bigint"))}, split)
    return counted.withColumn("sequence_index", F.col("_nth") - 1).drop("_nth")


def trailing(
    df: DataFrame,
    unit: Sequence[str],
    reach: int,
    columns: Mapping[str, Callable[[Window], Column]],
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Add window columns that look back at most `reach` rows of `sequence_index`.

    Units are cut into segments of `segment_rows` indexes and each segment repeats the `reach` rows in
    front of it, so the frames are exact while a long unit is spread over many tasks. Each entry of
    `columns` receives the ordered window and returns the column.
    """
    home = F.floor(F.col("sequence_index") / segment_rows)
    last = F.floor((F.col("sequence_index") + reach) / segment_rows)
    spread = df.withColumn("_home", home).withColumn("_segment", F.explode(F.sequence(home, last)))
    w = Window.partitionBy(*unit, "_segment").orderBy("sequence_index")
    return (
        spread.select("*", *[make(w).alias(name) for name, make in columns.items()])
        .where(F.col("_segment") == F.col("_home"))
        .select(*df.columns, *columns)
    )


def rows_back(w: Window, k: int) -> Window:
    """The trailing frame of `k` rows ending at the current one."""
    return w.rowsBetween(-(k - 1), 0)


#: Longest frame whose median is taken from single lagged values instead of a percentile per row.
LAG_FRAME = 32


def middle(values: Sequence[Column]) -> Column:
    """Median of the non-NULL ones among a few columns.

    NULLs stand behind all others as NaN, so that the array is one of plain doubles, which sort without boxing, and is sorted once for both middles.
    """
    ordered = F.sort_array(F.array(*[F.coalesce(v.cast("double"), F.lit(float("nan"))) for v in values]))
    n = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in values), F.lit(0))
    at = lambda spot: F.get(ordered, F.when(n > 0, spot.cast("int")))
    return (at((n - 1) / 2) + at(n / 2)) / 2


def rolling_median(value: str | Column, w: Window, k: int) -> Column:
    """Median of the trailing `k` rows: lagged values for short frames, an ordinary percentile for long ones."""
    x = F.col(value) if isinstance(value, str) else value
    if k > LAG_FRAME:
        return F.percentile(x, F.lit(0.5)).over(rows_back(w, k))
    return middle([x, *[F.lag(x, j).over(w) for j in range(1, k)]])


def unpivot(df: DataFrame, ids: Sequence[str], features: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Long form, one row per (id, feature), with DOUBLE values."""
    return df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(list(ids), list(features), name, value)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
