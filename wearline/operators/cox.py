"""Many ridge-penalised Cox models fitted side by side.

Rows are packed once into blocks, sorted by falling time, of a bounded number of rows. A Newton step of all models is two passes
over the blocks: the first sums each block's risk weights, so that every block knows what stands in the risk set before it; the second adds up
gradients and Hessians (Breslow ties). Rows are neither repeated per model nor shuffled again, and the driver holds a few hundred numbers per
block and model. Rows of one time may span blocks, so a time that many censored rows share is no hot spot.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wearline.session import cut

BLOCK_ROWS = 50_000
#: Newton steps and the largest change of a coefficient that counts as none.
STEPS, TOLERANCE = 100, 1e-9


class Spec(NamedTuple):
    """One model: the scope it is fitted on, its number there, positions of its covariates in a row's vector, and the penalty."""

    scope: tuple
    candidate: int
    columns: tuple[int, ...]
    alpha: float


class Fit(NamedTuple):
    spec: Spec
    beta: np.ndarray
    steps: int
    #: NULL if Newton's steps settled, else why not
    failure: str | None


def packed(rows: DataFrame, scope: Sequence[str], vector: str = "x", time: str = "duration_minutes", event: str = "event_observed", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The written blocks: scope, part (in order of falling time), rows, and times, events and vectors as binary."""
    picked = rows.select(*scope, F.col(time).cast("double").alias("_t"), F.col(event).cast("int").alias("_e"), F.col(vector).alias("_x"))
    late = F.col("_t").desc()
    ordered = picked.repartitionByRange(*scope, late, F.xxhash64("_x")).sortWithinPartitions(*scope, late)
    width = len(scope)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, key, held = TaskContext.get().partitionId(), 0, None, []

        def block() -> pa.RecordBatch:
            nonlocal made
            t, e, x = (np.concatenate(c) for c in zip(*held, strict=True))
            made += 1
            cells = [pa.array([k], s.type) for k, s in zip(key, schema)]
            return pa.RecordBatch.from_arrays(
                [*cells, pa.array([(task << 32) + made]), pa.array([len(t)]), *[pa.array([c.tobytes()], pa.binary()) for c in (t, e.astype(np.int8), x)]], schema=schema
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = list(zip(*[batch.column(i).to_pylist() for i in range(width)], strict=True))
            t, e = batch.column(width).to_numpy(zero_copy_only=False), batch.column(width + 1).to_numpy(zero_copy_only=False)
            x = np.stack([np.asarray(v, dtype=float) for v in batch.column(width + 2).to_pylist()])
            start = 0
            for stop in range(1, len(marks) + 1):
                if stop < len(marks) and marks[stop] == marks[start]:
                    continue
                if held and marks[start] != key:
                    yield block()
                    held = []
                key = marks[start]
                while start < stop:
                    end = min(stop, start + block_rows - sum(len(h[0]) for h in held))
                    held.append((t[start:end], e[start:end], x[start:end]))
                    start = end
                    if sum(len(h[0]) for h in held) >= block_rows:
                        yield block()
                        held = []
        if held:
            yield block()

    schema = pa.schema([*[(s, to_arrow_type(rows.schema[s].dataType)) for s in scope], ("part", pa.int64()), ("rows", pa.int64()), ("t", pa.binary()), ("e", pa.binary()), ("x", pa.binary())])
    ddl = ", ".join(f"`{s}` {rows.schema[s].dataType.simpleString()}" for s in scope)
    return cut(ordered.mapInArrow(pack, f"{ddl}, part long, rows long, t binary, e binary, x binary"))


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """(scope, part, times, events, vectors) of every block."""
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            part, n, t, e, x = row[width:]
            yield row[:width], part, np.frombuffer(t), np.frombuffer(e, dtype=np.int8).astype(float), np.frombuffer(x).reshape(n, -1)


def _sums(weight: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums of w, w x and w x x' as one vector."""
    return np.concatenate([[weight.sum()], weight @ x, ((x * weight[:, None]).T @ x).ravel()])


_TOTALS = "model int, part long, first double, last double, peak double, total array<double>, top array<double>"


def _totals(blocks: DataFrame, width: int, models: Mapping[tuple, list[tuple]]) -> dict[int, dict[int, tuple]]:
    """Per model and block (shift, sums of earlier blocks, sums of later rows that share the block's last time)."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for scope, part, t, _, x in _blocks(batches, width):
            rows = []
            for model, columns, beta in models.get(scope, ()):
                own = x[:, columns]
                eta = own @ beta
                weight, same = np.exp(eta - eta.max()), t == t[0]
                rows.append((model, part, t[0], t[-1], eta.max(), _sums(weight, own).tolist(), _sums(weight[same], own[same]).tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.int32()) for i, c in enumerate(zip(*rows, strict=True))], names=[f.split()[0] for f in _TOTALS.split(", ")])

    found: dict[int, list] = {}
    for r in blocks.mapInArrow(summed, _TOTALS).collect():  # a few hundred numbers per block and model
        found.setdefault(r["model"], []).append(r)
    carried: dict[int, dict[int, tuple]] = {}
    for model, rows in found.items():
        rows.sort(key=lambda r: r["part"])
        shift = max(r["peak"] for r in rows)
        totals, tops = ([np.exp(r["peak"] - shift) * np.array(r[c]) for r in rows] for c in ("total", "top"))
        before, after = np.zeros_like(totals[0]), [np.zeros_like(totals[0]) for _ in rows]
        for i in range(len(rows) - 2, -1, -1):  # a later block that lies within one time passes on what follows it
            if rows[i + 1]["first"] == rows[i]["last"]:
                after[i] = tops[i + 1] + (after[i + 1] if rows[i + 1]["last"] == rows[i + 1]["first"] else 0)
        carried[model] = {}
        for r, total, rest in zip(rows, totals, after, strict=True):
            carried[model][r["part"]] = (shift, before.copy(), rest)
            before += total
    return carried


def _risk_sets(t: np.ndarray, e: np.ndarray, x: np.ndarray, beta: np.ndarray, carry: tuple) -> tuple:
    """Per distinct time: events, sums of w and w x over the risk set; and per row its weight and the number of its time."""
    shift, before, after = carry
    p = x.shape[1]
    weight = np.exp(x @ beta - shift)
    last = np.flatnonzero(np.append(t[1:] != t[:-1], True))
    s0 = np.cumsum(weight)[last] + before[0]
    s1 = np.cumsum(weight[:, None] * x, axis=0)[last] + before[1 : 1 + p]
    s0[-1] += after[0]
    s1[-1] += after[1 : 1 + p]
    starts = np.concatenate([[0], last[:-1] + 1])
    return np.add.reduceat(e, starts), s0, s1, weight, np.repeat(np.arange(len(last)), np.diff(np.append(starts, len(t))))


def _derivatives(blocks: DataFrame, width: int, models: Mapping[tuple, list[tuple]], carried: Mapping[int, Mapping[int, tuple]]) -> dict[int, np.ndarray]:
    """Log likelihood, gradient and Hessian of every model as one vector."""

    def derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for scope, part, t, e, x in _blocks(batches, width):
            rows = []
            for model, columns, beta in models.get(scope, ()):
                own, (shift, before, after) = x[:, columns], carried[model][part]
                p = len(columns)
                d, s0, s1, weight, spot = _risk_sets(t, e, own, beta, (shift, before, after))
                mean, share = s1 / s0[:, None], d / s0
                # a row is in the risk set of its own and every later time of the block
                upto = np.cumsum(share[::-1])[::-1][spot]
                second = (own * (weight * upto)[:, None]).T @ own + before[1 + p :].reshape(p, p) * share.sum() + after[1 + p :].reshape(p, p) * share[-1]
                log = float(e @ (own @ beta - shift) - d @ np.log(s0))
                gradient = e @ own - d @ mean
                rows.append((model, np.concatenate([[log], gradient, (second - (mean * d[:, None]).T @ mean).ravel()]).tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows])], names=["model", "cells"])

    summed: dict[int, np.ndarray] = {}
    for r in blocks.mapInArrow(derived, "model int, cells array<double>").collect():
        cells = np.array(r["cells"])
        summed[r["model"]] = summed[r["model"]] + cells if r["model"] in summed else cells
    return summed


def _grouped(specs: Sequence[Spec], betas: Mapping[int, np.ndarray]) -> dict[tuple, list[tuple]]:
    models: dict[tuple, list[tuple]] = {}
    for i, beta in betas.items():
        models.setdefault(specs[i].scope, []).append((i, np.array(specs[i].columns), beta))
    return models


def fit_many(blocks: DataFrame, scope: Sequence[str], specs: Sequence[Spec], steps: int = STEPS, tolerance: float = TOLERANCE) -> list[Fit]:
    """All models; those that settled leave the later passes. One that does not settle, or has a singular Hessian, carries its failure."""
    betas = {i: np.zeros(len(s.columns)) for i, s in enumerate(specs)}
    value, good = {i: -np.inf for i in betas}, dict(betas)
    done: dict[int, Fit] = {}
    for step in range(1, steps + 1):
        models = _grouped(specs, betas)
        cells = _derivatives(blocks, len(scope), models, _totals(blocks, len(scope), models))
        for i in list(betas):
            beta, alpha, p = betas[i], specs[i].alpha, len(specs[i].columns)
            if i not in cells:
                done[i] = Fit(specs[i], beta, step, "no rows to fit")
            else:
                now = cells[i][0] - alpha / 2 * float(beta @ beta)
                gradient, hessian = cells[i][1 : 1 + p] - alpha * beta, cells[i][1 + p :].reshape(p, p) + alpha * np.eye(p)
                try:
                    move = np.linalg.solve(hessian, gradient)
                except np.linalg.LinAlgError:
                    done[i] = Fit(specs[i], beta, step, "singular Hessian")
                    move = None
                if move is not None:
                    if now < value[i] - 1e-9 * max(1.0, abs(value[i])):  # a step that lowers the penalised likelihood is halved from the last good point
                        move = -0.5 * (beta - good[i])
                    else:
                        value[i], good[i] = now, beta
                    betas[i] = beta + move
                    if np.abs(move).max(initial=0.0) < tolerance:
                        done[i] = Fit(specs[i], betas[i], step, None)
            if i in done:
                del betas[i]
        if not betas:
            break
    return [done.get(i) or Fit(s, betas[i], steps, "did not converge") for i, s in enumerate(specs)]


def hazards(blocks: DataFrame, scope: Sequence[str], fits: Sequence[Fit], grids: Mapping[tuple, np.ndarray]) -> list[np.ndarray]:
    """Breslow's cumulative baseline hazard of every model at the grid times of its scope."""
    models = _grouped([f.spec for f in fits], {i: f.beta for i, f in enumerate(fits)})
    carried, width = _totals(blocks, len(scope), models), len(scope)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part, t, e, x in _blocks(batches, width):
            rows = []
            for model, columns, beta in models.get(key, ()):
                shift = carried[model][part][0]
                d, s0, _, _, spot = _risk_sets(t, e, x[:, columns], beta, carried[model][part])
                times = t[np.searchsorted(spot, np.arange(len(d)))][::-1]  # rising
                total = np.concatenate([[0.0], np.cumsum((d / s0)[::-1])]) * np.exp(-shift)
                rows.append((model, total[np.searchsorted(times, grids[key], side="right")].tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows])], names=["model", "cells"])

    out = [np.zeros(len(grids[f.spec.scope])) for f in fits]
    for r in blocks.mapInArrow(summed, "model int, cells array<double>").collect():
        out[r["model"]] += np.array(r["cells"])
    return out


def curves(rows: DataFrame, scope: Sequence[str], fits: Sequence[Fit], base: Sequence[np.ndarray], grids: Mapping[tuple, np.ndarray], vector: str = "x", whole: bool = False) -> DataFrame:
    """`rows` (without the vector) per model of their scope and grid time: candidate_id, grid_index, evaluation_time, survival.

    With `whole` a row per model has `survival` at all grid times of its scope as an array.
    """
    width = len(scope)
    kept = [c for c in rows.columns if c not in (vector, *scope)]
    models: dict[tuple, list[tuple]] = {}
    for fit, hazard in zip(fits, base, strict=True):
        models.setdefault(fit.spec.scope, []).append((fit.spec.candidate, np.array(fit.spec.columns), fit.beta, hazard))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(width)], strict=True))
            x = [np.asarray(v, dtype=float) for v in batch.column(batch.num_columns - 1).to_pylist()]
            for key in dict.fromkeys(keys):
                if key not in models:
                    continue
                own = np.array([i for i, k in enumerate(keys) if k == key])
                matrix, grid = np.stack([x[i] for i in own]), grids[key]
                for candidate, columns, beta, hazard in models[key]:
                    survival = np.exp(-np.exp(matrix[:, columns] @ beta)[:, None] * hazard[None, :])
                    if whole:
                        part, ends = batch.take(pa.array(own)), np.arange(0, survival.size + 1, len(grid), dtype=np.int32)
                        cells = [*part.columns[:-1], pa.array(np.full(len(own), candidate, dtype=np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(survival.ravel()))]
                        yield pa.RecordBatch.from_arrays(cells, names=[*scope, *kept, "candidate_id", "survival"])
                        continue
                    part = batch.take(pa.array(np.repeat(own, len(grid))))
                    yield pa.RecordBatch.from_arrays(
                        [
                            *part.columns[:-1], pa.array(np.full(survival.size, candidate, dtype=np.int32)), pa.array(np.tile(np.arange(len(grid), dtype=np.int32), len(own))),
                            pa.array(np.tile(grid, len(own))), pa.array(survival.ravel()),
                        ],
                        names=[*scope, *kept, "candidate_id", "grid_index", "evaluation_time", "survival"],
                    )

    ddl = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*scope, *kept])
    curve = "survival array<double>" if whole else "grid_index int, evaluation_time double, survival double"
    return rows.select(*scope, *kept, vector).mapInArrow(scored, f"{ddl}, candidate_id int, {curve}")
