"""Health index, smoothing and retrospective change points."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wearline.operators.scale import percentiles, rolling_median, rows_back, same_keys, trailing, with_percentiles, with_totals
from wearline.session import cut

#: Change-point grid. Fixed values.
GRID = {
    "cost_model": ["rbf", "l2"],
    "penalty": [1.0, 3.0, 5.0, 8.0],
    "smoothing_window": [5, 7, 11],
    "minimum_segment_size": [5, 10],
    "persistence_window": [5, 10],
}
MINIMUM_EFFECT = 1.0
PERSISTENT_SHARE = 0.7
EPSILON = float(np.finfo(float).eps)
#: Cells (of `jump` rows) of a block; the kernel cost compares a series block by block, a tile for every pair of blocks.
TILE_CELLS = 128
#: Rows of one series that are packed for the windows of the boundaries among them, and rows whose series a task segments.
STRETCH, SEGMENTED_ROWS = 256, 100_000
#: Bits of a squared distance that one pass of the median search fixes.
DIGIT = 16


def smoothed(df: DataFrame, unit: Sequence[str], value: str, window: int, method: str = "median", name: str = "smoothed") -> DataFrame:
    """Trailing median or mean over an odd number of rows, shorter at the start."""
    if window <= 0 or window % 2 == 0:
        raise ValueError("the smoothing window must be a positive odd number")
    if method not in ("median", "mean"):
        raise ValueError("smoothing is by median or mean")

    def frame(w: Window) -> Column:
        return rolling_median(value, w, window) if method == "median" else F.avg(value).over(rows_back(w, window))

    return trailing(df, unit, window - 1, {name: frame})


def baseline_rows(total: Column, fraction: float, least: int) -> Column:
    return F.greatest(F.lit(least).cast("bigint"), F.ceil(total * F.lit(fraction)))


def centred(df: DataFrame, unit: Sequence[str], value: str, fraction: float = 0.1, least: int = 5, split: bool | None = None) -> DataFrame:
    """Subtract each unit's median over its first rows; a baseline covering the whole unit is an error."""
    b = baseline_rows(F.col("total_acquisitions"), fraction, least)
    checked = F.when(b < F.col("total_acquisitions"), b).otherwise(F.raise_error(F.lit("no rows left after the baseline")).cast("bigint"))
    base = df.withColumn("baseline_acquisitions", checked)
    first = F.when(F.col("sequence_index") < F.col("baseline_acquisitions"), F.col(value))
    middle = with_percentiles(base, unit, {"baseline_center": (first, 0.5)}, split)
    return middle.withColumn("centered", F.col(value) - F.col("baseline_center"))


def robust_scale(df: DataFrame, unit: Sequence[str], value: Column, split: bool | None = None) -> DataFrame:
    """1.4826 * MAD of the non-NULL values, the standard deviation if that is zero, at least epsilon."""
    rows = df.select(*unit, value.alias("_v"))
    spread = percentiles(
        with_percentiles(rows, unit, {"_mid": (F.col("_v"), 0.5)}, split), unit, {"_mad": (F.abs(F.col("_v") - F.col("_mid")), 0.5)}, {"_sd": F.stddev_pop("_v")}, split
    )
    mad = F.lit(1.4826) * F.col("_mad")
    return spread.select(*unit, F.greatest(F.when(mad == 0, F.col("_sd")).otherwise(mad), F.lit(EPSILON)).alias("robust_scale"))


def parameter_grid(spark, grid: dict[str, list] | None = None, jump: int = 5, effect: float = MINIMUM_EFFECT) -> DataFrame:
    """Every combination of the grid with a stable 0-based id; exploded in order, no join."""
    grid = grid or GRID
    rows = spark.range(1).select(F.lit(0).cast("bigint").alias("parameter_id"))
    for name, values in grid.items():
        options = F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(v).alias("v")) for i, v in enumerate(values)])
        rows = rows.withColumn("_o", F.explode(options)).withColumn("parameter_id", F.col("parameter_id") * len(values) + F.col("_o.i")).withColumn(name, F.col("_o.v")).drop("_o")
    return rows.withColumns({"jump": F.lit(jump), "minimum_effect_size": F.lit(effect)})


class _Segmenter:
    """Optimal partitioning with pruning (Killick et al. 2012) fed with one block of rows at a time.

    Only live candidates are kept, each with its best cost, running sums and path, so a unit of any length
    streams through in bounded memory under the l2 cost.
    """

    def __init__(self, penalty: float, least: int, jump: int) -> None:
        self.penalty, self.least, self.jump = penalty, least, jump
        self.seen = 0
        self.sums = (0.0, 0.0)
        # closed partitions by end: cost, sums at the end, path
        self.closed: dict[int, tuple[float, float, float, tuple | None]] = {0: (0.0, 0.0, 0.0, None)}
        self.live: list[int] = []

    def feed(self, count: int, total: float, square: float) -> None:
        if self.seen >= self.least and self.seen % self.jump == 0:
            self._close(self.seen)
        self.seen += count
        self.sums = (self.sums[0] + total, self.sums[1] + square)

    def _close(self, end: int) -> None:
        start = (end - self.least) // self.jump * self.jump
        if start in self.closed:
            self.live.append(start)
        best, table = None, []
        for t in self.live:
            cost, s1, s2, _ = self.closed[t]
            a, b, n = self.sums[0] - s1, self.sums[1] - s2, end - t
            value = cost + (b - a * a / n) + self.penalty
            table.append(value)
            if best is None or value < best[0]:
                best = (value, t)
        if best is None:
            return
        self.closed[end] = (best[0], *self.sums, (end, self.closed[best[1]][3]))
        kept = [t for t, value in zip(self.live, table) if value <= best[0] + self.penalty]
        # candidates not yet old enough to start a segment stay as well
        needed = set(kept)
        self.closed = {t: v for t, v in self.closed.items() if t in needed or t >= end - self.least - self.jump}
        self.live = kept

    def boundaries(self) -> list[int]:
        if self.seen >= self.least:
            self._close(self.seen)
        return [b for b in _path(self.closed.get(self.seen, (0, 0, 0, None))[3]) if b < self.seen]


class _KernelSegmenter:
    """The same partitioning under the kernel cost, for several (penalty, least) settings at once, fed with one cell of rows at a time.

    Kept are, per start that some setting may still use, the kernel sums inside the stretch from there to the last row.
    """

    def __init__(self, settings: Sequence[tuple[float, int]], jump: int) -> None:
        self.settings, self.jump = list(settings), jump
        self.seen = 0
        self.inside: dict[int, float] = {}
        self.best: list[dict[int, tuple[float, tuple | None]]] = [{0: (0.0, None)} for _ in self.settings]
        self.live: list[list[int]] = [[] for _ in self.settings]

    def oldest(self) -> int:
        """The first cell whose kernel sums are still of use."""
        return min(self.inside, default=0) // self.jump

    def feed(self, count: int, strip: np.ndarray, first: int, own: float) -> None:
        """`strip` holds the kernel sums of the new cell with the cells from `first` up to it, `own` those inside it."""
        if self.seen and self.seen % self.jump == 0:
            self._close(self.seen, last=False)
        self.inside[self.seen] = 0.0
        starts = sorted(self.inside)
        after = np.append(np.cumsum(strip[::-1])[::-1], 0.0)
        for t, more in zip(starts, after[np.array(starts) // self.jump - first].tolist()):
            self.inside[t] += 2 * more + own
        self.seen += count

    def _close(self, end: int, last: bool) -> None:
        for i, (penalty, least) in enumerate(self.settings):
            best, live = self.best[i], self.live[i]
            if end < least:
                continue
            start = (end - least) // self.jump * self.jump
            if start in best and start not in live:
                live.append(start)
            if not live:
                continue
            values = [best[t][0] + (end - t) - self.inside[t] / (end - t) + penalty for t in live]
            top = min(range(len(values)), key=values.__getitem__)
            best[end] = (values[top], (end, best[live[top]][1]))
            self.live[i] = [t for t, v in zip(live, values) if v <= values[top] + penalty]
        if not last:
            recent = end - max(least for _, least in self.settings) - self.jump
            needed = {t for live in self.live for t in live}
            self.inside = {t: v for t, v in self.inside.items() if t in needed or t > recent}
            for i, best in enumerate(self.best):
                own = set(self.live[i])
                self.best[i] = {t: v for t, v in best.items() if t in own or t > recent}

    def boundaries(self) -> list[list[int]]:
        """Per setting the boundaries found."""
        self._close(self.seen, last=True)
        return [[b for b in _path(best.get(self.seen, (0.0, None))[1]) if b < self.seen] for best in self.best]


def _path(node: tuple | None) -> list[int]:
    path = []
    while node is not None:
        path.append(node[0])
        node = node[1]
    return path[::-1]


def _series(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[bool, tuple, dict[str, list]]]:
    """Stretches of rows of one series (the first `width` columns): whether it starts here, its key, its columns.

    Input is sorted by series; one that spans several batches comes in several stretches.
    """
    current = None
    for batch in batches:
        columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        marks = list(zip(*list(columns.values())[:width], strict=True))
        start = 0
        for stop in range(1, len(marks) + 1):
            if stop < len(marks) and marks[stop] == marks[start]:
                continue
            yield marks[start] != current, marks[start], {n: v[start:stop] for n, v in columns.items()}
            current, start = marks[start], stop


def _found(schema: pa.Schema, settings: Sequence[tuple], rows: list[tuple]) -> pa.RecordBatch:
    """Rows (key, setting, boundary) as a batch."""
    table = [(*key, *settings[i], b) for key, i, b in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*table), schema, strict=True)], schema=schema)


def _level_partitions(batches: Iterator[pa.RecordBatch], width: int, settings: Sequence[tuple], jump: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Segments sorted block sums of every series under all settings; a series may span any number of batches."""
    current, machines = None, []

    def done() -> list[tuple]:
        return [(current, i, b) for i, m in enumerate(machines) for b in m.boundaries()]

    for fresh, key, part in _series(batches, width):
        if fresh:
            if rows := done():
                yield _found(schema, settings, rows)
            current, machines = key, [_Segmenter(penalty, least, jump) for _, penalty, least in settings]
        for machine in machines:
            for count, total, square in zip(part["_n"], part["_s1"], part["_s2"], strict=True):
                machine.feed(count, total, square)
    if rows := done():
        yield _found(schema, settings, rows)


def _cell_sums(a: np.ndarray, b: np.ndarray, gamma: float, jump: int, same: bool) -> np.ndarray:
    """Kernel sums between the cells of two blocks (rows: cells of `b`); a row's kernel with itself is 1."""
    kernel = np.exp(-np.clip((b[:, None] - a[None, :]) ** 2 * gamma, 1e-2, 1e2))
    if same:
        np.fill_diagonal(kernel, 1.0)
    return np.add.reduceat(np.add.reduceat(kernel, np.arange(0, len(b), jump), axis=0), np.arange(0, len(a), jump), axis=1)


def _gamma(middle: float) -> float:
    return 1.0 / middle if middle else 1.0


def _short_kernel_partitions(batches: Iterator[pa.RecordBatch], width: int, settings: Sequence[tuple], jump: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Segments series of a single block each."""
    for batch in batches:
        rows = []
        keys = list(zip(*[batch.column(i).to_pylist() for i in range(width)], strict=True))
        for key, values in zip(keys, batch.column(width).to_pylist(), strict=True):
            x = np.asarray(values, dtype=float)
            gaps = (x[:, None] - x[None, :])[np.triu_indices(len(x), 1)] ** 2
            sums = _cell_sums(x, x, _gamma(float(np.median(gaps)) if len(gaps) else 0.0), jump, True)
            machine = _KernelSegmenter([s[1:] for s in settings], jump)
            for c in range(len(sums)):
                first = min(machine.oldest(), c)
                machine.feed(min(jump, len(x) - c * jump), sums[c, first:c], first, float(sums[c, c]))
            rows += [(key, i, b) for i, found in enumerate(machine.boundaries()) for b in found]
        if rows:
            yield _found(schema, settings, rows)


def _tiled_kernel_partitions(batches: Iterator[pa.RecordBatch], width: int, settings: Sequence[tuple], jump: int, tile_cells: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Segments series from tiles sorted by series, later block, earlier block; tiles no start needs any more are dropped."""
    current, machine, held, first = None, None, [], 0

    def done() -> list[tuple]:
        return [(current, i, b) for i, found in enumerate(machine.boundaries()) for b in found] if machine else []

    for fresh, key, part in _series(batches, width):
        if fresh:
            if rows := done():
                yield _found(schema, settings, rows)
            current, machine, held, first = key, _KernelSegmenter([s[1:] for s in settings], jump), [], 0
        for later, earlier, count, data in zip(part["later"], part["earlier"], part["rows"], part["sums"], strict=True):
            cells = -(-count // jump)
            tile = np.frombuffer(data, dtype=float).reshape(cells, -1)
            if earlier < machine.oldest() // tile_cells and earlier < later:
                continue
            if not held:
                first = earlier * tile_cells
            held.append(tile)
            if earlier == later:
                row, before = np.concatenate(held, axis=1), later * tile_cells - first
                for c in range(cells):
                    machine.feed(min(jump, count - c * jump), row[c, : before + c], first, float(row[c, before + c]))
                held = []
    if rows := done():
        yield _found(schema, settings, rows)


def _digits(batches: Iterator[pa.RecordBatch], width: int, shift: int) -> Iterator[pa.RecordBatch]:
    """Counts of the `DIGIT` bits from `shift` on, over the squared distances of every tile that start with a prefix."""
    for batch in batches:
        rows = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        keys = list(rows.values())[:width]
        spots, prefixes, digits, counts = [], [], [], []
        for i in range(batch.num_rows):
            a, b = (np.asarray(rows[c][i].values.to_numpy(zero_copy_only=False), dtype=float) for c in ("a", "b"))
            gaps = (b[:, None] - a[None, :])[np.triu_indices(len(b), 1)] if rows["earlier"][i] == rows["later"][i] else (b[:, None] - a[None, :]).ravel()
            bits = (gaps * gaps).view(np.int64)
            for prefix in rows["_prefixes"][i].as_py():
                inside = bits if shift + DIGIT == 64 else bits[bits >> (shift + DIGIT) == prefix]
                digit, n = np.unique((inside >> shift) & ((1 << DIGIT) - 1), return_counts=True)
                spots.append(np.full(len(digit), i))
                prefixes.append(np.full(len(digit), prefix))
                digits.append(digit)
                counts.append(n)
        if spots:
            at = pa.array(np.concatenate(spots))
            yield pa.RecordBatch.from_arrays([*[k.take(at) for k in keys], *[pa.array(np.concatenate(c)) for c in (prefixes, digits, counts)]], names=[*batch.schema.names[:width], "_prefix", "_digit", "_n"])


def _doubles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column's bits as doubles."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(batch.column(batch.num_columns - 1).to_numpy().view(np.float64))], names=batch.schema.names)


def _ddl(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def _median_gaps(tiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The median squared distance of two rows of every series: keys, `middle`.

    Squared distances are not negative, so their bits order them: each pass counts, per series, the next `DIGIT` bits of the distances that agree
    so far and keeps the digit that holds the middle (the two middles of an even number). Tasks emit counts of digits, never distances.
    """
    n = F.col("rows")
    pairs = F.when(F.col("earlier") == F.col("later"), F.expr("rows * (rows - 1) div 2")).otherwise(n * F.col("rows_before"))
    total = F.sum(pairs).alias("_pairs")
    middles = F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.expr(f"(_pairs - {1 - i}) div 2").alias("rank")) for i in (0, 1)]))
    state = cut(tiles.groupBy(*keys).agg(total).select(*keys, middles.alias("m")).select(*keys, "m.*", F.lit(0).cast("bigint").alias("prefix")))
    for shift in range(64 - DIGIT, -1, -DIGIT):
        wanted = state.groupBy(*keys).agg(F.collect_set("prefix").alias("_prefixes"))
        spread = same_keys(tiles, wanted, keys).select(*keys, "a", "b", "earlier", "later", "_prefixes")
        counts = spread.mapInArrow(lambda batches, shift=shift: _digits(batches, len(keys), shift), f"{_ddl(tiles, keys)}, _prefix bigint, _digit bigint, _n bigint")
        digits = counts.groupBy(*keys, "_prefix", "_digit").agg(F.sum("_n").alias("_n"))  # at most 2**DIGIT rows per prefix
        upto = digits.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys, "_prefix").orderBy("_digit")))
        met = same_keys(state, upto, keys).where("_prefix = prefix AND _upto > rank AND _upto - _n <= rank")
        state = cut(met.select(*keys, "which", (F.col("rank") - (F.col("_upto") - F.col("_n"))).alias("rank"), (F.shiftleft("prefix", DIGIT) + F.col("_digit")).alias("prefix")))
    return state.select(*keys, "prefix").mapInArrow(_doubles, f"{_ddl(tiles, keys)}, gap double").groupBy(*keys).agg(F.avg("gap").alias("middle"))


def _tile_sums(batches: Iterator[pa.RecordBatch], width: int, jump: int) -> Iterator[pa.RecordBatch]:
    """Tiles (keys, later, earlier, rows, a, b, middle) to their cell sums."""
    for batch in batches:
        later, earlier, _, a, b, middle = (batch.column(width + i) for i in range(6))
        sums = []
        for i in range(batch.num_rows):
            left, right = (np.asarray(v[i].values.to_numpy(zero_copy_only=False), dtype=float) for v in (a, b))
            sums.append(_cell_sums(left, right, _gamma(middle[i].as_py()), jump, later[i] == earlier[i]).tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[: width + 3], pa.array(sums, pa.binary())], names=[*batch.schema.names[: width + 3], "sums"])


def _dealt(df: DataFrame, tasks: int, keys: Sequence[str]) -> DataFrame:
    """Rows of whole series, in that many tasks if they are more than one: adaptive execution would merge them by their few bytes."""
    return df.repartition(tasks, *keys) if tasks > 1 else df.repartition(*keys)


def change_points(rows: DataFrame, keys: Sequence[str], settings: Sequence[tuple[str, float, int]], value: str = "smoothed", jump: int = 5, tile_cells: int = TILE_CELLS) -> DataFrame:
    """Segment boundaries of every series (`keys`) under every (cost_model, penalty, minimum_segment_size) of `settings`.

    All settings share one pass over a series. The l2 cost only needs sums per cell of `jump` rows, so rows are pre-aggregated and a series' cells
    stream through one task in order with bounded state. The rbf cost compares all rows of a series with each other: series are packed into blocks
    of `tile_cells` cells; one block is compared inside its task, longer series by a tile per pair of blocks, spread over all tasks, of which
    only sums per pair of cells reach the segmenter. Work under rbf grows with the square of a series' length, memory does not.
    """
    keys, settings = list(keys), [(c, float(p), int(m)) for c, p, m in settings]
    ddl = f"{_ddl(rows, keys)}, cost_model string, penalty double, minimum_segment_size int, boundary bigint"
    schema = pa.schema([*[(k, to_arrow_type(rows.schema[k].dataType)) for k in keys], ("cost_model", pa.string()), ("penalty", pa.float64()), ("minimum_segment_size", pa.int32()), ("boundary", pa.int64())])
    width, x = len(keys), F.col(value)
    tasks = -(-rows.count() // SEGMENTED_ROWS)
    parts = []
    if level := [s for s in settings if s[0] == "l2"]:
        cells = rows.groupBy(*keys, F.floor(F.col("sequence_index") / jump).alias("_block")).agg(F.count(F.lit(1)).alias("_n"), F.sum(x).alias("_s1"), F.sum(x * x).alias("_s2"))
        ordered = _dealt(cells, tasks, keys).sortWithinPartitions(*keys, "_block")
        parts.append(ordered.mapInArrow(lambda batches: _level_partitions(batches, width, level, jump, schema), ddl))
    if kernel := [s for s in settings if s[0] == "rbf"]:
        packed = F.transform(F.array_sort(F.collect_list(F.struct("sequence_index", x.cast("double").alias("x")))), lambda r: r["x"])  # tile_cells * jump rows at most
        blocks = cut(rows.groupBy(*keys, F.floor(F.col("sequence_index") / (jump * tile_cells)).alias("later")).agg(packed.alias("b")))
        sized = same_keys(blocks, blocks.groupBy(*keys).agg(F.max("later").alias("_last")), keys)
        parts.append(_dealt(sized.where("_last = 0").select(*keys, "b"), tasks, keys).mapInArrow(lambda batches: _short_kernel_partitions(batches, width, kernel, jump, schema), ddl))
        if not blocks.where("later > 0").isEmpty():
            long = sized.where("_last > 0")
            earlier = long.select(*keys, F.col("later").alias("earlier"), F.col("b").alias("a"), F.size("b").cast("bigint").alias("rows_before"))
            pairs = long.select(*keys, "later", "b", F.size("b").cast("bigint").alias("rows"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("later"))).alias("earlier"))
            tiles = cut(same_keys(pairs, earlier, [*keys, "earlier"]))
            scaled = same_keys(tiles, _median_gaps(tiles, keys), keys).select(*keys, "later", "earlier", "rows", "a", "b", "middle")
            sums = scaled.mapInArrow(lambda batches: _tile_sums(batches, width, jump), f"{_ddl(rows, keys)}, later bigint, earlier bigint, rows bigint, sums binary")
            ordered = sums.repartition(*keys).sortWithinPartitions(*keys, "later", "earlier")
            parts.append(ordered.mapInArrow(lambda batches: _tiled_kernel_partitions(batches, width, kernel, jump, tile_cells, schema), ddl))
    return reduce(DataFrame.unionByName, parts)


#: Reasons against a boundary, before and after its windows are read. Fixed values.
EARLY = ("inside_initial_calibration_interval", "insufficient_pre_change_window", "insufficient_persistent_post_change_window")
LATE = ("minimum_effect_size", "persistence")


def _half(values: Column) -> Column:
    """Median of an array without NULLs, NULL if it is empty."""
    n = F.size(values)
    at = lambda spot: F.get(F.sort_array(values), F.when(n > 0, spot.cast("int")))
    return 0.5 * at((n - 1) / 2) + 0.5 * at(n / 2)


def _sides(rows: DataFrame, spots: DataFrame, series: Sequence[str], value: str, reach: int) -> DataFrame:
    """Per spot (series, boundary, persistence_window) the medians of the values on both sides, the later ones and the minutes at the boundary.

    Rows are packed by stretches of `STRETCH` indexes that repeat the `reach` rows on both sides, so a spot meets one packed row and no spot is
    repeated per row of its windows.
    """
    i, c, p = F.col("sequence_index"), F.col("boundary"), F.col("persistence_window")
    stretch = lambda at: F.floor(at / STRETCH)
    near = F.explode(F.sequence(F.greatest(stretch(i - F.lit(reach) + 1), F.lit(0).cast("bigint")), stretch(i + F.lit(reach)))).alias("_stretch")
    packed = rows.select(*series, near, F.struct(i.alias("i"), F.col(value).alias("v"), "elapsed_minutes", "rul_minutes").alias("_row")).groupBy(*series, "_stretch").agg(F.collect_list("_row").alias("_rows"))
    met = spots.withColumn("_stretch", stretch(c)).join(packed, [*series, "_stretch"])
    known = lambda later: F.transform(F.filter("_near", lambda r: ((r["i"] >= c) if later else (r["i"] < c)) & r["v"].isNotNull()), lambda r: r["v"])
    inside = met.select(*series, "boundary", "persistence_window", F.filter("_rows", lambda r: (r["i"] >= c - p) & (r["i"] < c + p)).alias("_near")).where(F.size("_near") > 0)
    halves = inside.select(*series, "boundary", "persistence_window", "_near", known(False).alias("_pre"), known(True).alias("_post"))
    here = lambda name: F.array_max(F.transform(F.filter("_near", lambda r: r["i"] == c), lambda r: r[name])).alias(name)
    return halves.select(
        *series, "boundary", "persistence_window", _half(F.col("_pre")).alias("pre_change_median"), _half(F.col("_post")).alias("post_change_median"), "_post", here("elapsed_minutes"), here("rul_minutes")
    )


def onsets(rows: DataFrame, boundaries: DataFrame, keys: Sequence[str], value: str = "smoothed", split: bool | None = None, settings: DataFrame | None = None) -> DataFrame:
    """First boundary that is a persistent upward shift, else `not_detected` with the reasons.

    `rows` carry baseline_acquisitions, total_acquisitions, persistence_window, minimum_segment_size and
    minimum_effect_size. Only rows inside a boundary's two windows are joined to it, by index equality.

    With `settings` (rows of `parameter_grid`) the result has a row per series and parameter_id: `rows` then carry the series (`keys`) once per
    smoothing_window, `boundaries` are those of `change_points`, and windows are read once per boundary and persistence, whatever setting found it.
    """
    keys = list(keys)
    boundaries = cut(boundaries)  # few rows, read three times below
    life = ["total_acquisitions", "baseline_acquisitions"]
    if settings is None:
        series, shared = keys, keys
        heads = rows.where("sequence_index = 0").select(*keys, *life, "persistence_window", "minimum_effect_size", "minimum_segment_size")
    else:
        series, shared = [*keys, "smoothing_window"], [*keys, "smoothing_window", "cost_model", "penalty", "minimum_segment_size"]
        heads = with_parameters(rows.where("sequence_index = 0").select(*keys, *life, F.col("smoothing_window").alias("_window")), settings).where("_window = smoothing_window").drop("_window", "jump")
        boundaries = boundaries.join(heads.select(*shared, "parameter_id"), shared)
        keys = [*keys, "parameter_id"]
        heads = cut(heads)
    n, b, p, c = (F.col(k) for k in ("total_acquisitions", "baseline_acquisitions", "persistence_window", "boundary"))
    too_short = n < F.greatest(2 * F.col("minimum_segment_size"), b + p)
    judged = boundaries.select(*keys, "boundary").join(heads.where(~too_short), keys).withColumn(
        "early_reasons",
        F.array_compact(
            F.array(
                F.when(c < b, F.lit(EARLY[0])),
                F.when(c < p, F.lit(EARLY[1])),
                F.when(n - c < p, F.lit(EARLY[2])),
            )
        ),
    )
    if settings is not None:
        judged = cut(judged)
    spot = [*series, "boundary", "persistence_window"]
    spots = judged.where(F.size("early_reasons") == 0).select(*spot).distinct()
    reach = heads.agg(F.max("persistence_window")).first()[0] or 0
    sides = _sides(rows, spots, series, value, reach)
    scale = robust_scale(rows.where("sequence_index < baseline_acquisitions"), series, F.col(value), split)
    share = F.size(F.filter("_post", lambda v: v > F.col("pre_change_median"))) / F.size("_post")
    effect = F.try_divide(F.col("post_change_median") - F.col("pre_change_median"), F.col("robust_scale"))
    scored = cut(judged.join(sides, spot, "left").join(scale, series).withColumn("robust_effect_size", effect).withColumn(
        "reasons",
        F.when(F.size("early_reasons") > 0, F.col("early_reasons"))
        .when(F.col("robust_effect_size") < F.col("minimum_effect_size"), F.array(F.lit(LATE[0])))
        .when(share < PERSISTENT_SHARE, F.array(F.lit(LATE[1])))
        .otherwise(F.array().cast("array<string>")),
    ).drop("_post"))
    accepted = scored.where(F.size("reasons") == 0).groupBy(*keys).agg(
        *[F.min_by(x, "boundary").alias(x) for x in ("elapsed_minutes", "rul_minutes", "pre_change_median", "post_change_median", "robust_effect_size")], F.min("boundary").alias("onset_index")
    )
    rejected = scored.where(F.size("reasons") > 0).select(*keys, "boundary", F.explode("reasons").alias("reason"))
    # a unit has few boundaries, at most one per minimum segment
    listed = rejected.join(accepted.select(*keys, "onset_index"), keys, "left").where("onset_index IS NULL OR boundary < onset_index").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rejections"), F.sort_array(F.collect_list(F.struct("boundary", "reason"))).alias("_listed")
    )
    detected = F.col("onset_index").isNotNull()
    any_boundary = boundaries.groupBy(*keys).agg(F.count(F.lit(1)).alias("_boundaries"))
    return (
        heads.join(accepted, keys, "left")
        .join(listed, keys, "left")
        .join(any_boundary, keys, "left")
        .select(
            *keys,
            F.when(detected, "detected").otherwise("not_detected").alias("onset_status"),
            "onset_index",
            F.col("elapsed_minutes").alias("onset_elapsed_minutes"),
            F.col("rul_minutes").alias("rul_at_onset"),
            F.try_divide(F.col("onset_index").cast("double"), (n - 1).cast("double")).alias("life_fraction_at_onset"),
            "pre_change_median", "post_change_median", "robust_effect_size",
            F.when(detected, p).otherwise(0).alias("persistence_duration"),
            F.coalesce("rejections", F.lit(0)).alias("rejections"),
            F.when(too_short, "trajectory_too_short")
            .when(F.col("_boundaries").isNull(), "no_internal_breakpoint")
            .otherwise(F.array_join(F.transform("_listed", lambda r: F.concat(F.lit("candidate_"), r["boundary"].cast("string"), F.lit(":"), r["reason"])), ";"))
            .alias("rejection_reasons"),
        )
    )


def stability(sensitivity: DataFrame, keys: Sequence[str], minutes: float = 10.0, life: float = 0.05, split: bool | None = None) -> DataFrame:
    """Spread and agreement of a unit's onsets over the whole parameter grid, joined to every row."""
    keys = list(keys)
    hit = F.col("onset_status") == "detected"
    at, share = F.when(hit, F.col("onset_elapsed_minutes")), F.when(hit, F.col("life_fraction_at_onset"))
    spread = with_percentiles(
        sensitivity, keys,
        {"median_onset_minutes": (at, 0.5), "_q25": (at, 0.25), "_q75": (at, 0.75), "_life": (share, 0.5), "_l25": (share, 0.25), "_l75": (share, 0.75)}, split,
    )

    def agreed(value: str, middle: str, most: float) -> Column:
        return F.avg(F.when(hit, (F.abs(F.col(value) - F.col(middle)) <= most).cast("double")))

    rated = {
        "detection_proportion": F.avg(hit.cast("double")),
        "agreement_within_minutes": agreed("onset_elapsed_minutes", "median_onset_minutes", minutes),
        "agreement_within_life_fraction": agreed("life_fraction_at_onset", "_life", life),
    }
    return with_totals(spread, keys, rated, split).select(
        *sensitivity.columns, "median_onset_minutes", (F.col("_q75") - F.col("_q25")).alias("onset_iqr_minutes"), (F.col("_l75") - F.col("_l25")).alias("normalized_onset_iqr"),
        "detection_proportion", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in rated if c.startswith("agreement")],
    )


def choose(sensitivity: DataFrame, conditions: int, minutes: float = 10.0, late: float = 0.95, split: bool | None = None) -> DataFrame:
    """Score each parameter setting per fold and flag the best; ties go to the smaller id.

    Score: 0.35 detection rate, 0.25 agreement with the unit's grid median, 0.15 clipped effect,
    0.15 condition coverage, 0.10 few detections at the very end of life.
    """
    hit = F.col("onset_status") == "detected"
    flag = lambda c: F.when(hit, c.cast("double"))
    rows = percentiles(
        sensitivity, ["fold", "parameter_id"], {"_effect": (F.when(hit, F.col("robust_effect_size")), 0.5)},
        {
            "detection_rate": F.avg(hit.cast("double")),
            "_conditions": F.countDistinct(F.when(hit, F.col("condition_id"))),
            "_agreement": F.avg(flag(F.abs(F.col("onset_elapsed_minutes") - F.col("median_onset_minutes")) <= minutes)),
            "_late": F.avg(flag(F.col("life_fraction_at_onset") >= late)),
        },
        split,
    ).select(
        "fold", "parameter_id", "detection_rate",
        F.coalesce("_agreement", F.lit(0.0)).alias("median_grid_agreement"),
        F.coalesce(F.least(F.greatest(F.col("_effect") / 5, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)).alias("median_clipped_effect"),
        (F.col("_conditions") / conditions).alias("condition_coverage"),
        F.coalesce("_late", F.lit(1.0)).alias("late_rate"),
    )
    score = (
        0.35 * F.col("detection_rate") + 0.25 * F.col("median_grid_agreement") + 0.15 * F.col("median_clipped_effect")
        + 0.15 * F.col("condition_coverage") + 0.10 * (1 - F.col("late_rate"))
    )
    scored = rows.withColumn("selection_score", F.round(score, 12))
    place = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("selection_score"), "parameter_id"))
    return scored.withColumn("configuration_rank", place).withColumn("selected", F.col("configuration_rank") == 1)


def with_parameters(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """Rows repeated for every parameter setting of the (small, fixed) grid."""
    packed = grid.agg(F.array_sort(F.collect_list(F.struct(*grid.columns))).alias("_grid")).first()["_grid"]
    settings = F.array(*[F.struct(*[F.lit(r[c]).cast(grid.schema[c].dataType).alias(c) for c in grid.columns]) for r in packed])
    return rows.select("*", F.inline(settings))


