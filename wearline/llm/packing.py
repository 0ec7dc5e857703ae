"""Best-fit packing with few-document patterns: every piece gets a sequence and a place in it.

1. Documents become token ids plus an end id; only longer ones than a sequence are cut, the first piece may be shorter.
2. The histogram of piece lengths (at most `capacity` numbers, whatever the corpus) goes to the driver.
3. Lengths are rounded up to classes. All patterns of up to four classes that fill a sequence are enumerated, and non-negative least
   squares fits how often each one is used. The counts are rounded down, and real lengths, longest first, take the classes' places;
   the last place takes the length that fills the sequence exactly, so that rounding up leaves no gap.
4. Residual pieces are packed best-fit decreasing. Equal bins are handled as one
   entry with a count, so this works on the histogram too and needs neither documents nor time in proportion to the corpus.
5. Each length then owns ranges of ranks that map to (sequence, offset). Pieces are ranked inside their length in the cluster: lengths with many
   pieces are split into blocks whose sizes are summed first.

Defined results: NULL text counts as empty (one piece with the end id); NULL ids and repeated rows are packed like others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wearline.llm.byte_tokens import default_path, encoder
from wearline.llm.common import arrow_map, cut, whole_text

CAPACITY = 2048
END_ID = 0
#: Widths of the length classes that are tried; the plan with the fewest sequences is used.
CLASS_WIDTHS = (32, 64)
#: Pieces of one length that one task ranks.
BLOCK_PIECES = 1_000
_PLACES = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, digests: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every piece of every text; with `digests` ids_crc32 in place of the ids."""
    path = path or default_path()
    schema = pa.schema([*_PLACES, ("ids_crc32", pa.int64()) if digests else ("ids", pa.binary())])
    end = np.uint32(end_id).astype("<u4").tobytes()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, packed in zip(batch.column(0).to_pylist(), encoder(path).encode(batch.column(1).to_pylist()), strict=True):
                packed += end
                total = len(packed) // 4
                first = total if total <= capacity else (total % capacity or capacity)
                bounds = [0, *range(first, total + 1, capacity)] if total > capacity else [0, total]
                rows += [(doc, i, a, b - a, crc32(packed[4 * a : 4 * b]) if digests else packed[4 * a : 4 * b]) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)

    return arrow_map(docs.select(F.col(id_col).cast("long"), whole_text(text_col)), cut_up, "doc_id long, piece int, start long, length long, " + ("ids_crc32 long" if digests else "ids binary"))


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, steps: int) -> np.ndarray:
    """Active-set least squares min |a x - b| with x >= 0; at most len(b) entries of x are positive."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    scale = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(steps):
        gain = a.T @ (b - a @ x)
        gain[used] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= scale:
            break
        used[best] = True
        while True:
            columns = np.flatnonzero(used)
            trial = np.linalg.lstsq(a[:, columns], b, rcond=None)[0]
            if (trial > 0).all():
                x[:] = 0
                x[columns] = trial
                break
            held, low = x[columns], trial <= 0
            reach = float(np.min(held[low] / (held[low] - trial[low]), initial=1.0))
            x[columns] = held + reach * (trial - held)
            gone = columns[x[columns] <= 1e-12 * scale + 1e-12]
            x[gone], used[gone] = 0, False
            if not len(gone):
                break
    return x


def class_patterns(classes: int, present: list[int]) -> list[tuple[int, ...]]:
    """Non-increasing tuples of one to four present classes that add up to `classes`."""
    there, found = set(present), []
    for c in present:
        if c == classes:
            found.append((c,))
    for c, d in product(present, present):
        if d > c:
            continue
        if c + d == classes:
            found.append((c, d))
        rest = classes - c - d
        if 0 < rest <= d and rest in there:
            found.append((c, d, rest))
        found += [(c, d, e, rest - e) for e in present if e <= d and 0 < rest - e <= e and rest - e in there]
    return found


class _Bins:
    """Open bins by free space; each entry is (lengths, how many such bins)."""

    def __init__(self, capacity: int):
        self.free: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
        self.capacity = capacity

    def add(self, lengths: tuple[int, ...], count: int) -> None:
        self.free[self.capacity - sum(lengths)].append((lengths, count))

    def best_fit(self, length: int, count: int) -> None:
        space = length
        while count:
            while space <= self.capacity and not self.free[space]:
                space += 1
            if space > self.capacity:
                fit = self.capacity // length
                if count >= fit:
                    self.add((length,) * fit, count // fit)
                if count % fit:
                    self.add((length,) * (count % fit), 1)
                return
            lengths, bins = self.free[space].pop()
            taken = min(bins, count)
            if bins > taken:
                self.free[space].append((lengths, bins - taken))
            self.add((*lengths, length), taken)
            count -= taken
            space = length  # the bin just filled may still be the tightest

    def groups(self) -> list[tuple[tuple[int, ...], int]]:
        return [entry for entries in self.free for entry in entries]


def _real_lengths(pattern: tuple[int, ...], lengths: np.ndarray, capacity: int, width: int) -> list[int]:
    """Lengths for the classes of a pattern, longest first, that fill a sequence exactly; [] if there are none left.

    The last place takes what is missing, of whatever class; the place before it tries its class's lengths in turn.
    """
    chosen: list[int] = []

    def stock(length: int) -> bool:
        return 0 < length <= capacity and lengths[length] > chosen.count(length)

    for c in pattern[:-2]:
        length = next((n for n in range(c * width, (c - 1) * width, -1) if stock(n)), 0)
        if not length:
            return []
        chosen.append(length)
    space = capacity - sum(chosen)
    if len(pattern) == 1:
        return [space] if stock(space) else []
    for length in range(pattern[-2] * width, (pattern[-2] - 1) * width, -1):
        if stock(length) and (stock(space - length) if space != 2 * length else lengths[length] > chosen.count(length) + 1):
            return [*chosen, length, space - length]
    return []


def plan(histogram: dict[int, int], capacity: int = CAPACITY, width: int = 32) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, number of sequences) that use up the histogram."""
    left = {length: count for length, count in histogram.items() if count}
    classes = capacity // width
    by_class: dict[int, list[int]] = {}
    for length in sorted(left, reverse=True):
        by_class.setdefault(-(-length // width), []).append(length)
    present = sorted((c for c in by_class if c <= classes), reverse=True)
    totals = {c: sum(left[n] for n in by_class[c]) for c in present}
    bins = _Bins(capacity)
    patterns = class_patterns(classes, present)
    if patterns:
        row = {c: i for i, c in enumerate(present)}
        a = np.zeros((len(present), len(patterns)))
        for j, pattern in enumerate(patterns):
            for c in pattern:
                a[row[c], j] += 1
        weight = np.sqrt(np.array(present, dtype=float))[:, None]  # long pieces matter more
        times = non_negative_least_squares(a * weight, np.array([totals[c] for c in present], dtype=float) * weight[:, 0], 4 * len(present))
        lengths = np.zeros(capacity + 1, dtype=np.int64)
        for length, count in left.items():
            lengths[length] = count
        for j in sorted(np.flatnonzero(times >= 1), key=lambda j: patterns[j], reverse=True):
            repeats = int(times[j] + 1e-9)
            while repeats:  # equal bins at once; a run ends where a length is used up
                chosen = _real_lengths(patterns[j], lengths, capacity, width)
                if not chosen:
                    break
                need = {n: chosen.count(n) for n in chosen}
                taken = min(repeats, *(int(lengths[n]) // k for n, k in need.items()))
                for n, k in need.items():
                    lengths[n] -= k * taken
                bins.add(tuple(chosen), taken)
                repeats -= taken
        left = {length: int(lengths[length]) for length in left}
    for length in sorted(left, reverse=True):
        if left[length]:
            bins.best_fit(length, left[length])
    return bins.groups()


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    plans = [plan(histogram, capacity, w) for w in CLASS_WIDTHS if capacity % w == 0] or [plan(histogram, capacity, 1)]
    return min(plans, key=lambda groups: sum(count for _, count in groups))


def ranges(groups: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first sequence, offset) of every place; ranks of a length are used in order."""
    used: dict[int, int] = {}
    found, sequence = [], 0
    for lengths, count in groups:
        offset = 0
        for length in lengths:
            found.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + count
            offset += length
        sequence += count
    return found


def placed(cut_pieces: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """The pieces (with a `length` of at most `capacity`) plus sequence_id and offset.

    `cut_pieces` is read several times: pass a written table.
    """
    counts = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    table = sorted(ranges(best_plan(counts, capacity)))
    starts = np.array([(r[0] << 44) + r[1] for r in table], dtype=np.int64)
    firsts, ranks, offsets = (np.array([r[i] for r in table], dtype=np.int64) for i in (2, 1, 3))

    split = [(length, 1 + n // block_pieces) for length, n in counts.items() if n > block_pieces]
    blocks = F.lit(1)
    if split:  # few lengths have that many pieces
        blocks = F.coalesce(F.create_map(*[F.lit(v) for pair in split for v in pair])[F.col("length")], blocks)
    order = [c for c in cut_pieces.columns if c != "ids"]
    rows = cut_pieces.withColumn("_block", F.pmod(F.xxhash64(*order), blocks).cast("int"))
    sizes = rows.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("length").alias("_length"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_block").orderBy(*order)
    ranked = rows.withColumn("_nth", F.row_number().over(inside)).join(sizes, (F.col("length") == F.col("_length")) & (F.col("_block") == F.col("_b")))
    ranked = ranked.select(*cut_pieces.columns, (F.col("_before") + F.col("_nth") - 1).alias("_rank"))

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy()
            key = (batch.column(batch.schema.get_field_index("length")).to_numpy() << 44) + rank
            spot = np.searchsorted(starts, key, side="right") - 1
            kept = [n for n in batch.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(n)) for n in kept], pa.array(firsts[spot] + rank - ranks[spot]), pa.array(offsets[spot])],
                names=[*kept, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_pieces.schema)
    return arrow_map(ranked, located, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id and offset of every piece."""
    return placed(cut(pieces(docs, id_col, text_col, path, capacity, end_id)), capacity)
