"""Fitted preprocessing as small parameter tables: log mask, robust scale, PCA; and its application.

Fits read training units only and collect nothing but parameters (a few numbers per feature).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearline.operators.folds import UNIT
from wearline.operators.scale import average_ranks, percentiles
from wearline.operators.trajectory import correlation, resample
from wearline.session import cut, parameter_table

#: Name parts of heavy-tailed features. Fixed values.
LOG_TOKENS = (
    "variance", "rms", "max_abs", "peak_to_peak", "kurtosis", "energy", "crest_factor", "impulse_factor",
    "clearance_factor", "spectral_power", "band_power",
)


def is_logged(feature: str) -> bool:
    return any(token in feature for token in LOG_TOKENS)


def log_mask(feature: Column, value: Column) -> Column:
    """log1p of heavy-tailed features; a negative input there is an error."""
    heavy = F.lit(False)
    for token in LOG_TOKENS:
        heavy = heavy | feature.contains(token)
    guarded = F.when(value < 0, F.raise_error(F.lit("log1p received a negative feature value")).cast("double")).otherwise(F.log1p(value))
    return F.when(heavy, guarded).otherwise(value)


def balanced_rows(long: DataFrame, folds: DataFrame, points: int = 100) -> DataFrame:
    """Training units of every fold, each resampled to the same number of rows: fold, unit, feature, grid, value."""
    training = folds.where("subset = 'train'").select("fold", "unit_id")
    return resample(long, points).join(training, "unit_id")


def robust_parameters(rows: DataFrame, scope: Sequence[str], split: bool | None = None) -> DataFrame:
    """Median and interquartile range per scope and feature; a zero range scales by one."""
    v = F.col("value")
    needed = rows.select(*scope, "feature", "value")  # resampled and repeated per scope, so many more rows than the sources have
    out = percentiles(needed, [*scope, "feature"], {"center": (v, 0.5), "_q25": (v, 0.25), "_q75": (v, 0.75)}, split=split, grown=True)
    spread = F.col("_q75") - F.col("_q25")
    return out.select(*scope, "feature", "center", F.when(spread == 0, 1.0).otherwise(spread).alias("scale"))


def apply_scale(long: DataFrame, parameters: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Scaled values in long form; rows repeat per scope where `long` has no scope column."""
    keys = [c for c in [*scope, "feature"] if c in long.columns]
    return long.join(F.broadcast(parameters), keys).withColumn("scaled", (F.col("value") - F.col("center")) / F.col("scale"))


def transformed(long: DataFrame, parameters: DataFrame, scope: Sequence[str], keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Log-masked and scaled features, one column each, per key and scope: what the fitted preprocessing makes of any rows."""
    scaled = apply_scale(long.withColumn("value", log_mask(F.col("feature"), F.col("value"))), parameters, scope)
    return scaled.groupBy(*scope, *keys).agg(*[F.max(F.when(F.col("feature") == f, F.col("scaled"))).alias(f) for f in features])


def yeo_johnson(value: Column, lam: Column) -> Column:
    positive = F.when(lam == 0, F.log1p(F.abs(value))).otherwise((F.pow(F.abs(value) + 1, lam) - 1) / F.when(lam == 0, 1.0).otherwise(lam))
    away = 2 - lam
    negative = F.when(away == 0, -F.log1p(F.abs(value))).otherwise(-(F.pow(F.abs(value) + 1, away) - 1) / F.when(away == 0, 1.0).otherwise(away))
    return F.when(value >= 0, positive).otherwise(negative)


def _moved(logs: np.ndarray, lam: float) -> np.ndarray:
    """The transform of numbers that are not negative, from their log1p."""
    return logs if lam == 0 else (np.exp(lam * logs) - 1) / lam


def _candidate_moments(candidates: dict[str, Sequence[float]]):
    """One task's rows (feature, value) to the rows, known values, mean, squared deviations and log-Jacobian of every candidate."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, jacobian, found = {}, {}, {}
        for pdf in batches:
            for feature, part in pdf.groupby("feature"):
                if feature not in candidates:
                    continue
                rows[feature] = rows.get(feature, 0) + len(part)
                x = part["value"].to_numpy(float)[part["known"].to_numpy(bool)]
                if not len(x):
                    continue
                above, logs = x >= 0, np.log1p(np.abs(x))
                jacobian[feature] = jacobian.get(feature, 0.0) + logs[above].sum() - logs[~above].sum()
                n = len(x)
                if x.min() == x.max():  # equal values have no spread, not even that of rounding
                    above, logs = above[:1], logs[:1]
                up, down = logs[above], logs[~above]
                for lam in candidates[feature]:
                    moved = np.concatenate([_moved(up, lam), -_moved(down, 2 - lam)])
                    mean = moved.mean()
                    square = np.square(moved - mean).sum()
                    if (feature, lam) not in found:
                        found[feature, lam] = (n, mean, square)
                        continue
                    n0, mean0, square0 = found[feature, lam]
                    gap, both = mean - mean0, n0 + n
                    found[feature, lam] = (both, mean0 + gap * n / both, square0 + square + gap * gap * n0 * n / both)
        out = [(f, lam, rows[f], *found.get((f, lam), (0, 0.0, 0.0)), jacobian.get(f, 0.0)) for f in rows for lam in candidates[f]]
        yield pd.DataFrame(out, columns=["feature", "candidate", "n", "known", "mean", "square", "jacobian"])

    return moments


def yeo_johnson_lambdas(long: DataFrame, low: float = -3.0, high: float = 3.0, points: int = 61, rounds: int = 2) -> DataFrame:
    """Most likely lambda per feature by a candidate grid, refined around the best one.

    Each round is a single pass: tasks add up the moments of all candidates of their rows, so no row is repeated per candidate and no
    exchange carries rows. The few candidates per feature go through the driver.
    """
    best = long.select("feature").distinct().withColumn("lambda", F.lit((low + high) / 2))
    rows = long.select("feature", F.col("value").cast("double").alias("value"), F.col("value").isNotNull().alias("known"))
    half = (high - low) / 2
    for _ in range(rounds):
        step = 2 * half / (points - 1)
        offsets = F.array(*[F.round(F.col("lambda") + F.lit(k * step - half), 9) for k in range(points)])
        candidates = {r["feature"]: r["offsets"] for r in best.where("feature IS NOT NULL").select("feature", offsets.alias("offsets")).collect()}
        parts = rows.mapInPandas(_candidate_moments(candidates), "feature string, candidate double, n bigint, known bigint, mean double, square double, jacobian double")
        w = Window.partitionBy("feature", "candidate")  # one row per task
        off = F.col("mean") - F.col("_centre")
        own = F.when(F.col("known") > 0, F.col("mean"))
        centre = F.when(F.min(own).over(w) == F.max(own).over(w), F.max(own).over(w)).otherwise(F.try_divide(F.sum(F.col("known") * own).over(w), F.sum("known").over(w)))
        fit = parts.withColumn("_centre", centre).groupBy("feature", "candidate").agg(
            F.try_divide(F.sum(F.when(F.col("known") > 0, F.col("square") + F.col("known") * off * off)), F.sum("known")).alias("var"),
            F.sum("n").alias("n"), F.sum("jacobian").alias("jacobian"),
        ).where("var > 0")
        likelihood = -F.col("n") / 2 * F.ln("var") + (F.col("candidate") - 1) * F.col("jacobian")
        best = cut(fit.groupBy("feature").agg(F.max_by("candidate", F.struct(likelihood, -F.abs("candidate"))).alias("lambda"), F.max(likelihood).alias("log_likelihood")))
        half = step
    return best


def wide_rows(scaled: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One row per key with the scaled values as an array in `features` order."""
    cells = [F.max(F.when(F.col("feature") == f, F.col("scaled"))) for f in features]
    return scaled.groupBy(*keys).agg(F.array(*cells).alias("x"))


def _gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial sums and products per fold of one task's rows."""
    for pdf in batches:
        for fold, part in pdf.groupby("fold"):
            x = np.stack(part["x"].to_numpy())
            ones = np.column_stack([np.ones(len(x)), x])
            yield pd.DataFrame({"fold": [fold], "m": [(ones.T @ ones).ravel()]})


def moments_by_fold(rows: DataFrame, width: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Row count, mean vector and covariance matrix of the array column `x` per fold, in one pass.

    Tasks add up product matrices; only those (width + 1)^2 numbers per fold reach the driver.
    """
    parts = rows.select("fold", "x").mapInPandas(_gram, "fold int, m array<double>").select("fold", F.posexplode("m").alias("cell", "v"))
    summed = parts.groupBy("fold", "cell").agg(F.sum("v").alias("v")).groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("cell", "v"))).alias("m"))
    found = {}
    for r in summed.orderBy("fold").collect():
        m = np.array([c["v"] for c in r["m"]]).reshape(width + 1, -1)
        n, mean = float(m[0, 0]), m[0, 1:] / m[0, 0]
        found[int(r["fold"])] = (n, mean, m[1:, 1:] / n - np.outer(mean, mean))
    return found


def fit_pca(balanced: DataFrame, features: Sequence[str], components: int) -> DataFrame:
    """Component table per fold: fold, component, explained ratio, means, loadings and orientation.

    `balanced` has fold, condition_id, unit_id, grid, x. The orientation is the sign of the median over units
    of the rank correlation of the first component with life.
    """
    spark = balanced.sparkSession
    rows = []
    for fold, (_, mean, covariance) in moments_by_fold(balanced, len(features)).items():
        values, vectors = np.linalg.eigh(covariance)
        order = values.argsort()[::-1][:components]
        rows += [(fold, i, float(values[c] / values.sum()), mean.tolist(), vectors[:, c].tolist()) for i, c in enumerate(order)]
    table = parameter_table(spark, rows, "fold int, component int, explained double, mean array<double>, loading array<double>")
    first = project(balanced, table.where("component = 0"))
    ranked = average_ranks(first, ["fold", *UNIT], "score", "_rank", split=False)  # a unit has a fixed number of grid rows
    per_unit = ranked.groupBy("fold", *UNIT).agg(correlation("_rank", "grid").alias("rho"))
    sign = percentiles(per_unit, ["fold"], {"_mid": (F.col("rho"), 0.5)}, split=False)
    return table.join(sign.select("fold", F.when(F.col("_mid") < 0, -1).otherwise(1).alias("orientation")), "fold")


def project(rows: DataFrame, components: DataFrame, oriented: bool = False) -> DataFrame:
    """Score of every row on the components of its fold."""
    dot = F.aggregate(
        F.zip_with(F.zip_with("x", "mean", lambda a, m: a - m), "loading", lambda a, w: a * w), F.lit(0.0), lambda a, v: a + v
    )
    score = dot * F.col("orientation") if oriented else dot
    return rows.join(components, "fold").withColumn("score", score).drop("mean", "loading", "explained")


def weighted_target(df: DataFrame, scope: Sequence[str], target: str, weight: str = "sample_weight") -> DataFrame:
    """Weighted centre and scale of the target; a scale of zero or less is an error."""
    w, y = F.col(weight), F.col(target)
    sums = df.groupBy(*scope).agg(F.sum(w).alias("_w"), F.sum(w * y).alias("_wy"), F.avg(y).alias("_m"))
    centred = df.join(sums, list(scope)) if scope else df
    spread = centred.groupBy(*scope).agg(
        F.first(F.col("_wy") / F.col("_w")).alias("center"), F.sqrt(F.sum(w * F.pow(y - F.col("_wy") / F.col("_w"), 2)) / F.sum(w)).alias("scale")
    )
    bad = F.raise_error(F.lit("the target does not vary")).cast("double")
    return spread.withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(bad))


def fit_scope_issues(fitted: DataFrame, folds: DataFrame) -> DataFrame:
    """Units a fit used outside the training subset of its fold."""
    allowed = folds.where("subset = 'train'").select("fold", "unit_id")
    return fitted.select("fold", "unit_id").distinct().join(allowed, ["fold", "unit_id"], "left_anti")


