"""Trajectory quality metrics per unit and feature, aggregated and ranked per scope.

Tables are long: condition_id, unit_id, sequence_index, total_acquisitions, feature, value.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearline.operators.scale import average_ranks, percentiles, running, trailing, with_totals
from wearline.session import cut, parameter_table, scratch

SERIES = ["condition_id", "unit_id", "feature"]
#: Components of the composite feature score, equally weighted by default. Fixed values.
METRICS = ("monotonicity", "trendability", "prognosability", "spearman_abs", "stability")
#: Scopes up to this many units are one small matrix product each.
BLOCK_UNITS = 512
#: Units per block of the pair product beyond that; a block pair holds no more than two of these.
PAIR_UNITS = 8192
#: Rows of a block that are multiplied at once.
STRIP = 512
#: Bins of each pass of the median search over correlations.
BINS = (4096, 65_536, 65_536)


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation, 0 where either side is constant."""
    return F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))


def unit_scores(long: DataFrame, split: bool | None = None) -> DataFrame:
    """Monotonicity, trend sign, Spearman correlation with time, fluctuation and completeness."""
    ranked = average_ranks(long, SERIES, "value", "_rank", split)
    stepped = trailing(ranked, SERIES, 1, {"_before": lambda w: F.lag("value").over(w)})
    step = F.col("value") - F.col("_before")
    value = F.col("value")
    summary = percentiles(
        stepped,
        SERIES,
        {"_q25": (value, 0.25), "_q75": (value, 0.75), "_step": (F.abs(step), 0.5)},
        {
            "_up": F.count_if(step > 0),
            "_down": F.count_if(step < 0),
            "_still": F.count_if(step == 0),
            "spearman": correlation("_rank", "sequence_index"),
            "missing_count": F.count_if(value.isNull() | F.isnan(value)),
            "_infinite": F.count_if(F.coalesce(F.abs(value) == float("inf"), F.lit(False))),
        },
        split,
    )
    valid, lead = F.col("_up") + F.col("_down"), F.col("_up") - F.col("_down")
    iqr = F.col("_q75") - F.col("_q25")
    return summary.select(
        *SERIES,
        F.coalesce(F.try_divide(F.abs(lead).cast("double"), valid.cast("double")), F.lit(0.0)).alias("monotonicity"),
        F.signum(lead.cast("double")).cast("int").alias("trend_sign"),
        "spearman",
        F.abs("spearman").alias("spearman_abs"),
        F.when(iqr > 0, F.col("_step") / iqr).when(valid == 0, 0.0).otherwise(float("inf")).alias("fluctuation"),
        valid.alias("valid_differences"),
        F.col("_still").alias("tie_differences"),
        ((F.col("missing_count") == 0) & (F.col("_infinite") == 0)).alias("finite"),
        "missing_count",
    )


def resample(long: DataFrame, points: int, keys: Sequence[str] = tuple(SERIES)) -> DataFrame:
    """Linear interpolation of every series at `points` equal steps of normalised life.

    Each row emits the grid points between its predecessor and itself, so there is no join: grid point g
    sits at index g*(N-1)/(points-1).
    """
    if points < 3:
        raise ValueError("a resampling grid needs at least three points")
    last = F.col("total_acquisitions") - 1
    before = trailing(long, list(keys), 1, {"_before": lambda w: F.lag("value").over(w)})
    i = F.col("sequence_index")
    upto = F.when(last == 0, F.lit(points - 1)).otherwise(F.floor(F.try_divide(i * (points - 1), last)))
    start = F.when(i == 0, F.lit(0)).otherwise(F.floor(F.try_divide((i - 1) * (points - 1), last)) + 1)
    emitted = before.withColumn("_g", F.when(start <= upto, F.sequence(start.cast("int"), upto.cast("int")))).withColumn("grid", F.explode("_g"))
    spot = F.col("grid") * last / F.lit(points - 1)
    value = F.when(i == 0, F.col("value")).otherwise(F.col("_before") + (spot - (i - 1)) * (F.col("value") - F.col("_before")))
    return emitted.select(*keys, "grid", value.alias("value"))


def scopes(units: DataFrame, folds: DataFrame | None = None) -> DataFrame:
    """Scope membership of units: all, their condition and the training part of each fold."""
    base = units.select("unit_id", F.explode(F.array(F.lit("all"), F.concat(F.lit("condition_"), F.col("condition_id").cast("string")))).alias("scope"))
    if folds is None:
        return base
    training = folds.where("subset = 'train'").select("unit_id", F.concat(F.lit("fold_"), F.col("fold").cast("string")).alias("scope"))
    return base.unionByName(training)


def _vectors(grid: DataFrame) -> DataFrame:
    """Unit-length centred vectors of the resampled series, NULL for constant ones."""
    # a series has a fixed number of grid points, so the gathered arrays are bounded
    gathered = grid.groupBy("unit_id", "feature").agg(
        F.array_sort(F.collect_list(F.struct("grid", "value"))).alias("_v"),
        F.avg("value").alias("_mean"),
        F.stddev_pop("value").alias("_sd"),
        F.count(F.lit(1)).alias("_n"),
    )
    centred = F.transform("_v", lambda z: (z["value"] - F.col("_mean")) / (F.col("_sd") * F.sqrt("_n")))
    return gathered.select("unit_id", "feature", F.when(F.col("_sd") > 0, centred).alias("vector"))


def _block_median(pdf: pd.DataFrame) -> pd.DataFrame:
    left = np.stack(pdf["vector"].to_numpy())
    values = np.minimum(np.abs(left @ left.T)[np.triu_indices(len(left), 1)], 1.0)
    first = pdf.iloc[0]
    middle = float(np.median(values)) if len(values) else 0.0
    return pd.DataFrame({"scope": [first["scope"]], "feature": [first["feature"]], "trendability": [middle], "trendability_valid_pairs": [len(values)]})


def _strips(left: np.ndarray, right: np.ndarray | None) -> Iterator[np.ndarray]:
    """Absolute correlations between two blocks (inside `left` where `right` is None, each pair once), a strip of rows at a time."""
    for at in range(0, len(left), STRIP):
        strip = left[at : at + STRIP]
        if right is not None:
            yield np.minimum(np.abs(strip @ right.T).ravel(), 1.0)
            continue
        gram = np.abs(strip @ left[at:].T)
        yield np.minimum(gram[np.triu_indices(len(strip), 1, gram.shape[1])], 1.0)


def _stored(folder: str, feature: int, block: int) -> np.ndarray:
    """The vectors of a feature in a block, read from the shared folder."""
    files, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    column = pq.read_table(f"{root}/_feature={feature}/block={block}", columns=["vector"], filesystem=files, partitioning=None).column("vector")
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _bin_counter(folder: str, stored: Mapping[str, tuple[int, frozenset[int]]], members: Mapping[int, Mapping[str, int]], bases: Mapping[tuple[str, str], Sequence[float]], width: float, bins: int):
    """Counts of block pairs' correlations (feature, low, high) in the `bins` bins of every base their common scopes ask for.

    Only the names of a pair come as a row; its vectors are read from `folder`, where `stored` has each feature's number and blocks. `members` has, per
    block, the scopes its units belong to and how often, `bases` the lower ends per scope and feature.
    """
    step = width / bins

    def count_bins(feature: str, low: int, high: int) -> pd.DataFrame:
        common = {s: (members[low][s], members[high][s]) for s in members[low].keys() & members[high].keys() if (s, feature) in bases}
        wanted = sorted({base for s in common for base in bases[s, feature]})
        tally = {base: np.zeros(bins, dtype=np.int64) for base in wanted}
        own = {base: np.zeros(bins, dtype=np.int64) for base in wanted}
        mask = np.zeros(BINS[0], dtype=bool)
        mask[np.minimum([int(base * BINS[0]) for base in wanted], BINS[0] - 1).astype(int) if wanted else []] = True

        def add(values: np.ndarray, to: dict[float, np.ndarray]) -> None:
            if np.isnan(values).any():
                values = values[~np.isnan(values)]
            if width < 1.0:
                values = values[mask[np.minimum((values * BINS[0]).astype(np.int32), BINS[0] - 1)]]
            for base in wanted:
                inside = values if width >= 1.0 else values[(values >= base) & ((values < base + width) | (base + width >= 1.0))]
                to[base] += np.bincount(np.minimum(((inside - base) / step).astype(np.int64), bins - 1), minlength=bins)

        number, blocks = stored[feature]
        if wanted and low in blocks and high in blocks:
            parts = {b: _stored(folder, number, b) for b in {low, high}}
            for values in _strips(parts[low], None if low == high else parts[high]):
                add(values, tally)
            if low == high and any(a > 1 for a, _ in common.values()):  # a unit listed twice meets itself
                add(np.minimum(np.einsum("ij,ij->i", parts[low], parts[low]), 1.0), own)
        found = []
        for scope, (a, b) in common.items():
            for base in bases[scope, feature]:
                n = tally[base] * (a * b) + own[base] * (a * (a - 1) // 2)
                at = np.flatnonzero(n)
                found.append(pd.DataFrame({"scope": scope, "feature": feature, "base": base, "bin": at, "n": n[at]}))
        empty = pd.DataFrame({"scope": pd.Series(dtype=str), "feature": pd.Series(dtype=str), "base": pd.Series(dtype=float), "bin": pd.Series(dtype=int), "n": pd.Series(dtype=int)})
        return pd.concat(found, ignore_index=True) if found else empty

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for feature, low, high in zip(pdf["feature"], pdf["low"], pdf["high"], strict=True):
                yield count_bins(feature, int(low), int(high))

    return counted


def unit_blocks(members: DataFrame, pair_units: int = PAIR_UNITS) -> DataFrame:
    """Units in blocks of at most `pair_units` that belong to the same scopes: unit_id, scopes, block.

    A pair of blocks then lies in certain scopes as a whole, so its product serves all of them.
    """
    placed = members.where("unit_id IS NOT NULL").groupBy("unit_id").agg(F.sort_array(F.collect_list("scope")).alias("scopes")).withColumn("_key", F.array_join("scopes", "\n"))
    nth = running(placed, ["_key"], ["unit_id"], {"_nth": ("sum", F.lit(1).cast("bigint"))})
    sized = cut(with_totals(nth, ["_key"], {"_units": F.count(F.lit(1))}).withColumn("_part", F.pmod(F.col("_nth"), F.ceil(F.col("_units") / pair_units))))
    # one row per block
    numbered = sized.select("_key", "_part").distinct().withColumn("block", F.row_number().over(Window.orderBy("_key", "_part")))
    return sized.join(F.broadcast(numbered), ["_key", "_part"]).select("unit_id", "scopes", "block")


def trendability(grid: DataFrame, members: DataFrame, block_units: int = BLOCK_UNITS, pair_units: int = PAIR_UNITS) -> DataFrame:
    """Median absolute correlation over all unit pairs of each scope, and the number of pairs.

    Scopes of up to `block_units` units are one matrix product each. Beyond that units of the same scopes form blocks (`unit_blocks`), and each
    pair of blocks is multiplied once for all scopes; pairs are only counted into bins, never emitted. Blocks are written once, and a task reads the two it
    multiplies, so no vector is sent per pair. Each pass keeps the bin that holds the
    median, so three of them resolve it to 2**-44. Work grows with the square of the units, memory does not.
    """
    keys, spark = ["scope", "feature"], grid.sparkSession
    vectors = cut(_vectors(grid))
    everyone = vectors.select("unit_id", "feature").join(members, "unit_id").select(*keys).distinct()
    vectors = vectors.where("vector IS NOT NULL")
    largest = members.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= block_units:
        # every scope is a single block: its pairs fit one small matrix product
        found = vectors.join(members, "unit_id").select(*keys, "vector").groupBy(*keys).applyInPandas(_block_median, "scope string, feature string, trendability double, trendability_valid_pairs bigint")
        return everyone.join(found, keys, "left").fillna(0, ["trendability", "trendability_valid_pairs"])
    names = sorted(r["feature"] for r in vectors.select("feature").distinct().collect() if r["feature"] is not None)
    numbered = parameter_table(spark, [(f, i) for i, f in enumerate(names)], "feature string, _feature int")
    placed = vectors.join(unit_blocks(members, pair_units), "unit_id").join(numbered, "feature").select("feature", "scopes", "vector", "_feature", "block")
    folder = scratch(spark, "blocks")
    placed.repartition("_feature", "block").write.partitionBy("_feature", "block").parquet(folder)
    placed = spark.read.schema(placed.schema).parquet(folder)
    inside: dict[int, dict[str, int]] = {}
    sizes: dict[tuple[str, str], int] = {}
    held: dict[str, set[int]] = {}
    for r in placed.groupBy("block", "scopes", "feature").count().collect():  # one row per block and feature
        inside[r["block"]] = {s: r["scopes"].count(s) for s in r["scopes"]}
        held.setdefault(r["feature"], set()).add(r["block"])
        for scope, times in inside[r["block"]].items():
            sizes[scope, r["feature"]] = sizes.get((scope, r["feature"]), 0) + times * r["count"]
    stored = {f: (i, frozenset(held[f])) for i, f in enumerate(names) if f in held}
    pairs = {k: n * (n - 1) // 2 for k, n in sizes.items() if n > 1}
    # the one or two middle ranks of every scope and feature: rank, base, pairs below the base
    state = {k: [(rank, 0.0, 0) for rank in sorted({(n - 1) // 2, n // 2})] for k, n in pairs.items()}
    blocks = F.array(*[F.lit(b) for b in sorted(inside)]) if inside else F.array().cast("array<int>")
    asked_pairs = spark.range(1).select(F.explode(F.array(*[F.lit(f) for f in stored]).cast("array<string>")).alias("feature"), blocks.alias("_blocks")).select(
        "feature", "_blocks", F.explode("_blocks").alias("low")
    ).select("feature", "low", F.explode(F.filter("_blocks", lambda b: b >= F.col("low"))).alias("high"))
    tasks = max(1, min(2000, len(inside) * (len(inside) + 1)))  # a small block pair may take long
    width = 1.0
    for bins in BINS:
        step = width / bins
        bases = {k: sorted({base for _, base, _ in v}) for k, v in state.items()}
        wanted = [(*k, i, int(rank - before), base) for k, v in state.items() for i, (rank, base, before) in enumerate(v)]
        counts = (
            asked_pairs.repartition(tasks)
            .mapInPandas(_bin_counter(folder, stored, inside, bases, width, bins), "scope string, feature string, base double, bin bigint, n bigint")
            .groupBy("scope", "feature", "base", "bin")
            .agg(F.sum("n").alias("n"))
        )
        # at most `bins` rows per base
        upto = counts.withColumn("_upto", F.sum("n").over(Window.partitionBy("scope", "feature", "base").orderBy("bin")))
        asked = parameter_table(spark, wanted, "scope string, feature string, which int, rest bigint, base double")
        met = upto.join(F.broadcast(asked), ["scope", "feature", "base"]).where("_upto > rest AND _upto - n <= rest")
        state_, state = state, {}
        for r in met.select("scope", "feature", "which", "bin", (F.col("_upto") - F.col("n")).alias("less")).collect():  # at most two per scope and feature
            rank, base, before = state_[r["scope"], r["feature"]][r["which"]]
            state.setdefault((r["scope"], r["feature"]), []).append((rank, base + r["bin"] * step, before + r["less"]))
        width = step
    rows = [(*k, float(np.mean([base for _, base, _ in v])), pairs[k]) for k, v in state.items()]
    found = parameter_table(spark, rows, "scope string, feature string, trendability double, trendability_valid_pairs bigint")
    return everyone.join(found, keys, "left").fillna(0, ["trendability", "trendability_valid_pairs"])


def endpoint_medians(long: DataFrame, first: float = 0.1, last: float = 0.1, split: bool | None = None) -> DataFrame:
    """Median of the first and of the last part of every series (at least one row each)."""
    n, i, v = F.col("total_acquisitions"), F.col("sequence_index"), F.col("value")
    head = F.greatest(F.lit(1), F.ceil(n * F.lit(first)))
    tail = F.greatest(F.lit(1), F.ceil(n * F.lit(last)))
    return percentiles(long, SERIES, {"initial_median": (F.when(i < head, v), 0.5), "final_median": (F.when(i >= n - tail, v), 0.5)}, split=split)


def prognosability(ends: DataFrame, members: DataFrame, split: bool | None = None) -> DataFrame:
    """exp(-spread of the final level / change over life) per scope and feature."""
    keys = ["scope", "feature"]
    scoped = ends.join(members, "unit_id")
    centre = percentiles(scoped, keys, {"_mid": (F.col("final_median"), 0.5)}, split=split)
    spread = F.abs(F.col("final_median") - F.col("_mid"))
    change = F.abs(F.col("final_median") - F.col("initial_median"))
    both = percentiles(
        scoped.join(centre, keys), keys, {"_spread": (spread, 0.5), "_change": (change, 0.5)},
        {"_low": F.min("final_median"), "_high": F.max("final_median")}, split,
    )
    return both.select(
        *keys,
        F.when(F.col("_change") == 0, F.when((F.col("_spread") == 0) & (F.col("_low") == F.col("_high")), 1.0).otherwise(0.0))
        .otherwise(F.exp(-F.try_divide(F.col("_spread"), F.col("_change"))))
        .alias("prognosability"),
    )


def scope_scores(scores: DataFrame, members: DataFrame, split: bool | None = None) -> DataFrame:
    """Medians of the unit scores per scope and feature, all scopes in one aggregation."""
    rho, fluct = F.col("spearman_abs"), F.col("fluctuation")
    out = percentiles(
        scores.join(members, "unit_id"),
        ["scope", "feature"],
        {
            "monotonicity": (F.col("monotonicity"), 0.5),
            "spearman": (F.col("spearman"), 0.5),
            "spearman_abs": (rho, 0.5),
            "fluctuation": (F.when(fluct != float("inf"), fluct), 0.5),
            "_q25": (rho, 0.25),
            "_q75": (rho, 0.75),
        },
        {"unit_count": F.countDistinct("unit_id"), "finite": F.bool_and("finite"), "missing_count": F.sum("missing_count")},
        split,
    )
    return out.withColumn("stability", F.least(F.greatest(1 - (F.col("_q75") - F.col("_q25")), F.lit(0.0)), F.lit(1.0))).drop("_q25", "_q75")


def rank_features(scores: DataFrame, weights: Mapping[str, float], count: int, scope: str = "scope") -> DataFrame:
    """Min-max normalise each metric inside its scope, rank by weighted mean then name, flag the first `count`."""
    if set(weights) != set(METRICS) or any(w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("weights must be non-negative and cover every metric")
    all_rows = Window.partitionBy(scope)
    total = float(sum(weights.values()))

    def scaled(metric: str) -> Column:
        low, high = F.min(metric).over(all_rows), F.max(metric).over(all_rows)
        return F.coalesce(F.try_divide(F.col(metric) - low, high - low), F.lit(0.0))

    normal = scores.withColumns({f"normalized_{m}": scaled(m) for m in METRICS})
    composite = sum((F.col(f"normalized_{m}") * (weights[m] / total) for m in METRICS), F.lit(0.0))
    scored = normal.withColumn("composite_score", F.round(composite, 12))
    place = F.row_number().over(Window.partitionBy(scope).orderBy(F.desc("composite_score"), "feature"))
    return scored.withColumn("rank", place).withColumn("selected", F.col("rank") <= count)


def name_issues(selected: DataFrame, known: Sequence[str], forbidden: Sequence[str]) -> DataFrame:
    """Selected names that repeat inside a scope, are unknown, or are metadata or targets."""
    counted = selected.groupBy("scope", "feature").agg(F.count(F.lit(1)).alias("_n"))
    codes = F.array_compact(
        F.array(
            F.when(F.col("_n") > 1, F.lit("duplicate_name")),
            F.when(~F.col("feature").isin(*known), F.lit("unknown_name")),
            F.when(F.col("feature").isin(*forbidden), F.lit("forbidden_name")),
        )
    )
    return counted.select("scope", "feature", F.explode(codes).alias("code"))
