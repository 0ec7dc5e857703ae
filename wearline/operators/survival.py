"""Censored cohorts, Kaplan-Meier and Cox models, and inverse-censoring-weighted metrics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wearline.operators import cox
from wearline.operators.rul import rank_candidates
from wearline.operators.scale import TINY, average_ranks, groups_fit, index_units, percentiles, running, same_keys, settled, trailing, with_totals
from wearline.operators.scaling import moments_by_fold
from wearline.operators.stats import holm, wilcoxon
from wearline.operators.trajectory import correlation
from wearline.session import cut, fits_one_task, parameter_table

#: Fixed horizons, target censoring rates, grid quantiles and points.
HORIZONS = (30.0, 60.0, 120.0, 240.0)
CENSORING_RATES = (0.25, 0.5, 0.75)
GRID_QUANTILES = (0.10, 0.90)
GRID_POINTS = 25
Z95 = 1.959963984540054
DOUBLE_EPS = float(np.finfo(float).eps)
#: Values of a step function that a broadcast may carry.
FEW_VALUES = 50_000


# cohorts ---------------------------------------------------------------------------------------------------


def landmarks(rows: DataFrame, onsets: DataFrame, stride: int = 5, follow_up: int = 5) -> DataFrame:
    """Every `stride`-th row from the alarm on that still has `follow_up` rows, weighted equally per unit.

    `rows` carry sequence_index and total_acquisitions; `onsets` one row per fold, subset and unit.
    """
    at, i = F.col("alarm_confirmation_index"), F.col("sequence_index")
    left = F.col("total_acquisitions") - 1 - i
    hits = onsets.where("detection_status = 'detected'").select("fold", "subset", "unit_id", "alarm_confirmation_index")
    chosen = rows.join(hits, "unit_id").where((i >= at) & (left >= follow_up) & ((i - at) % stride == 0)).withColumns(
        {
            "landmark_id": F.concat_ws(":", F.col("fold").cast("string"), "subset", F.col("unit_id").cast("string"), i.cast("string")),
            "time_since_causal_onset": i - at,
            "true_time_to_failure_minutes": left.cast("double"),
            "duration_minutes": left.cast("double"),
            "event_observed": F.lit(1),
        }
    )
    scope = ["fold", "subset"]
    per_unit = chosen.groupBy(*scope, "unit_id").agg(F.count(F.lit(1)).alias("_n"))
    totals = per_unit.groupBy(*scope).agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_units"))
    weight = F.col("_rows") / (F.col("_units") * F.col("_n"))
    weights = per_unit.join(totals, scope).select(*scope, "unit_id", weight.alias("landmark_weight"))
    return chosen.join(weights, [*scope, "unit_id"])


#: Reason of an excluded unit. Fixed value.
NOT_DETECTED = "causal onset not detected"


def excluded_units(onsets: DataFrame) -> DataFrame:
    return onsets.where("detection_status <> 'detected'").select("fold", "subset", "unit_id", F.lit(NOT_DETECTED).alias("reason"))


def onset_cohort(marks: DataFrame) -> DataFrame:
    """The first landmark of every fold, subset and unit."""
    return marks.where("time_since_causal_onset = 0")


def _censored(df: DataFrame, horizon: Column) -> DataFrame:
    life = F.col("true_time_to_failure_minutes")
    return df.withColumns({"duration_minutes": F.least(life, horizon), "event_observed": (life <= horizon).cast("int")})


def fixed_horizon(marks: DataFrame, horizons: Sequence[float] = HORIZONS) -> DataFrame:
    """One administratively censored copy per horizon."""
    many = marks.withColumn("horizon_minutes", F.explode(F.array(*[F.lit(float(h)) for h in horizons])))
    name = F.concat(F.lit("fixed_horizon_"), F.col("horizon_minutes").cast("int").cast("string"))
    return _censored(many, F.col("horizon_minutes")).withColumn("scenario", name)


def rate_horizons(marks: DataFrame, rates: Sequence[float] = CENSORING_RATES, split: bool | None = None) -> DataFrame:
    """Horizon per fold and target rate: the (1 - rate) quantile of the training times."""
    life = F.col("true_time_to_failure_minutes")
    train = marks.where("subset = 'train'")
    wide = percentiles(train, ["fold"], {f"q{i}": (life, 1 - r) for i, r in enumerate(rates)}, split=split)
    return wide.select("fold", F.inline(F.array(*[F.struct(F.lit(float(r)).alias("target_censoring_rate"), F.col(f"q{i}").alias("administrative_horizon_minutes")) for i, r in enumerate(rates)])))


def rate_censored(marks: DataFrame, horizons: DataFrame) -> DataFrame:
    out = _censored(marks.join(horizons, "fold"), F.col("administrative_horizon_minutes"))
    return out.withColumn("scenario", F.concat(F.lit("target_censoring_"), F.round(F.col("target_censoring_rate") * 100).cast("int").cast("string")))


def censoring_manifest(censored: DataFrame) -> DataFrame:
    return censored.groupBy("fold", "subset", "target_censoring_rate").agg(
        F.max("administrative_horizon_minutes").alias("training_only_horizon_minutes"), (1 - F.avg("event_observed")).alias("achieved_censoring_rate")
    )


TRUTH_COLUMNS = ["true_time_to_failure_minutes", "rul_minutes"]


def split_truth(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Model table without any truth, and the truth keyed by fold, subset, unit and landmark."""
    keys = ["fold", "subset", "unit_id", "landmark_id"]
    return marks.drop(*TRUTH_COLUMNS), marks.select(*keys, *TRUTH_COLUMNS)


def join_truth(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Truth joined back to frozen predictions; a landmark without truth, or with two, is an error."""
    known = truth.groupBy("landmark_id").agg(F.count(F.lit(1)).alias("_truths"), F.first("true_time_to_failure_minutes").alias("true_time_to_failure_minutes"))
    joined = predictions.join(known, "landmark_id", "left")
    missing = F.raise_error(F.lit("prediction without evaluation truth")).cast("double")
    repeated = F.raise_error(F.lit("landmark with more than one evaluation truth")).cast("double")
    checked = F.when(F.col("_truths") > 1, repeated).otherwise(F.coalesce("true_time_to_failure_minutes", missing))
    return joined.withColumn("true_time_to_failure_minutes", checked).drop("_truths")


def scenario_rows(cohorts: DataFrame, scenario: str) -> DataFrame:
    return cohorts.where(F.col("scenario") == scenario)


# feature screening -----------------------------------------------------------------------------------------


def screen_features(long: DataFrame, key: str, near_constant: float = 0.999, by: Sequence[str] = ()) -> DataFrame:
    """Status per feature: invalid, constant, near constant, exact duplicate of an earlier name, or retained.

    `long` has `by`, key, feature, value. Duplicates share an order-free fingerprint and are confirmed row by row.
    """
    by, v = list(by), F.col("value")
    named = [*by, "feature"]
    counts = long.groupBy(*named, "value").agg(F.count(F.lit(1)).alias("n"))
    shape = counts.groupBy(*named).agg(
        F.sum(F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.col("n")).otherwise(0)).alias("invalid"),
        F.count(F.lit(1)).alias("distinct"), (F.max("n") / F.sum("n")).alias("top_share"),
    )
    status = (
        F.when(F.col("invalid") > 0, "invalid_value").when(F.col("distinct") <= 1, "constant")
        .when(F.col("top_share") >= near_constant, "near_constant").otherwise("retained")
    )
    judged = shape.select(*named, status.alias("status"))
    prints = long.join(judged.where("status = 'retained'").select(*named), named, "left_semi").groupBy(*named).agg(
        F.sum(F.xxhash64(key, "value").cast("decimal(38,0)")).alias("print"), F.count(F.lit(1)).alias("rows")
    )
    twins = prints.alias("a").join(prints.alias("b"), [*by, "print", "rows"]).where("b.feature < a.feature").groupBy(*by, F.col("a.feature").alias("feature")).agg(F.min("b.feature").alias("related_feature"))
    left = long.join(twins, named)
    differing = (
        left.join(long.select(*by, key, F.col("feature").alias("related_feature"), F.col("value").alias("_other")), [*by, key, "related_feature"])
        .groupBy(*named).agg(F.count_if(~F.col("value").eqNullSafe(F.col("_other"))).alias("_differs"))
    )
    confirmed = twins.join(differing, named).where("_differs = 0").select(*named, "related_feature")
    return judged.join(confirmed, named, "left").withColumn("status", F.when(F.col("related_feature").isNotNull(), "exact_duplicate").otherwise(F.col("status")))


def univariate_relevance(long: DataFrame, by: Sequence[str] = ("feature",), split: bool | None = None) -> DataFrame:
    """max(C(x), C(-x)) per feature, 0.5 where the feature is constant or no pair is comparable.

    Reversing the risk swaps concordant and discordant pairs, so one count serves both directions.
    """
    counted = concordance(long.withColumn("_one", F.lit(1.0)), by, "duration_minutes", "event_observed", "value", "_one", split)
    c = F.col("concordance")
    return counted.select(*by, F.coalesce(F.greatest(c, 1 - c), F.lit(0.5)).alias("survival_relevance"))


def prune_correlated(wide: DataFrame, features: Sequence[str], scores: dict[str, float], threshold: float = 0.95, split: bool | None = None) -> list[tuple[str, str | None, float | None]]:
    """Greedy pruning by (-score, name): a feature falls to an already kept one with |Spearman| at the threshold.

    Ranks and their product matrix are computed on the cluster; the driver only sees features x features numbers.
    """
    ranked = wide.select(*features, F.lit(0).alias("_all"))
    for f in features:
        ranked = average_ranks(ranked, ["_all"], f, f"_r_{f}", split)
    rows = ranked.select(F.lit(0).alias("fold"), F.array(*[F.col(f"_r_{f}").cast("double") for f in features]).alias("x"))
    covariance = moments_by_fold(rows, len(features))[0][2]
    spread = np.sqrt(np.diag(covariance))
    rho = covariance / np.where(np.outer(spread, spread) > 0, np.outer(spread, spread), np.inf)
    spot = {f: i for i, f in enumerate(features)}
    kept: list[str] = []
    result: list[tuple[str, str | None, float | None]] = []
    for name in sorted(features, key=lambda f: (-scores[f], f)):
        rival = next((k for k in kept if abs(rho[spot[name], spot[k]]) >= threshold), None)
        if rival is None:
            kept.append(name)
        result.append((name, rival, None if rival is None else float(abs(rho[spot[name], spot[rival]]))))
    return result


def evaluation_grid(train: DataFrame, scope: Sequence[str], points: int = GRID_POINTS, quantiles: Sequence[float] = GRID_QUANTILES, horizon: float | None = None, split: bool | None = None, strict: bool = True) -> DataFrame:
    """Equally spaced evaluation times per scope: between event-time quantiles, or up to a fixed horizon.

    A scope without a supported interval is an error, or has no times if not `strict`.
    """
    t = F.col("duration_minutes")
    if horizon is None:
        event = F.when(F.col("event_observed") == 1, t)
        ends = percentiles(train, scope, {"_lo": (event, quantiles[0]), "_hi": (event, quantiles[1])}, {"_max": F.max(t)}, split)
        ends = ends.withColumn("_hi", F.when(F.col("_hi") < F.col("_max"), F.col("_hi")).otherwise(F.col("_max") * (1 - DOUBLE_EPS)))
    else:
        ends = train.groupBy(*scope).agg(F.greatest(F.min(F.when(t > 0, t)), F.lit(horizon / points)).alias("_lo")).withColumn("_hi", F.lit(float(horizon)))
    bad = F.raise_error(F.lit("no supported interval for an evaluation grid")).cast("double")
    ends = ends.withColumn("_hi", F.when(F.col("_hi") > F.col("_lo"), F.col("_hi")).otherwise(bad)) if strict else ends.where("_hi > _lo")
    spots = ends.withColumn("grid_index", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return spots.select(*scope, "grid_index", (F.col("_lo") + F.col("grid_index") * (F.col("_hi") - F.col("_lo")) / (points - 1)).alias("evaluation_time"))


# Kaplan-Meier ----------------------------------------------------------------------------------------------


def risk_table(df: DataFrame, by: Sequence[str], time: str = "duration_minutes", event: str = "event_observed", split: bool | None = None) -> DataFrame:
    """Events, censorings and number at risk at every distinct time."""
    per_time = settled(df.groupBy(*by, F.col(time).alias("time")).agg(F.sum(F.col(event).cast("bigint")).alias("events"), F.count(F.lit(1)).alias("rows")))
    totals = per_time.groupBy(*by).agg(F.sum("rows").alias("_total"))
    before = running(per_time, by, ["time"], {"_before": ("sum", F.col("rows"))}, split, exclusive=True)
    joined = before.join(totals, list(by))
    return joined.select(*by, "time", "events", (F.col("rows") - F.col("events")).alias("censored"), (F.col("_total") - F.coalesce("_before", F.lit(0))).alias("at_risk"))


def _log_share(hits: Column, pool: Column) -> Column:
    return F.when(hits == 0, 0.0).when(hits == pool, float("-inf")).otherwise(F.log1p(-hits / pool))


def kaplan_meier(df: DataFrame, by: Sequence[str], time: str = "duration_minutes", event: str = "event_observed", intervals: bool = False, split: bool | None = None) -> DataFrame:
    """Product-limit survival at every distinct time, with log-log confidence limits on request."""
    d, n = F.col("events"), F.col("at_risk")
    table = risk_table(df, by, time, event, split)
    greenwood = F.coalesce(F.try_divide(d.cast("double"), (n * (n - d)).cast("double")), F.lit(0.0))
    summed = running(table, by, ["time"], {"_log": ("sum", _log_share(d, n)), "_var": ("sum", greenwood)}, split)
    out = summed.withColumn("survival", F.exp("_log"))
    if intervals:
        s = F.col("survival")
        shift = F.try_divide(F.lit(Z95) * F.sqrt("_var"), F.abs(F.col("_log")))
        limit = lambda sign: F.when(s <= DOUBLE_EPS, 0.0).when(1 - s <= DOUBLE_EPS, 1.0).otherwise(F.exp(F.exp(sign * shift) * F.col("_log")))
        out = out.withColumns({"confidence_lower": limit(1), "confidence_upper": limit(-1)})
    return out.drop("_log", "_var")


def censoring_curve(df: DataFrame, by: Sequence[str], time: str = "duration_minutes", event: str = "event_observed", split: bool | None = None) -> DataFrame:
    """Kaplan-Meier of the censoring times; events at a time leave the risk set before its censorings."""
    c, n = F.col("censored"), F.col("at_risk") - F.col("events")
    summed = running(risk_table(df, by, time, event, split), by, ["time"], {"_log": ("sum", _log_share(c, n))}, split)
    return summed.select(*by, "time", F.exp("_log").alias("survival"))


def step_lookup(curve: DataFrame, points: DataFrame, by: Sequence[str], at: str, name: str = "survival", split: bool | None = None) -> DataFrame:
    """Value of a falling step function at the points' times: the lowest value reached so far, 1 before the first.

    An as-of join without range predicates: steps and distinct times are sorted together.
    """
    return points.join(step_values(curve, points, by, at, name, split), [*by, at])


def step_values(curve: DataFrame, points: DataFrame, by: Sequence[str], at: str, name: str = "survival", split: bool | None = None) -> DataFrame:
    """The value of `step_lookup` at every distinct time of the points; few of them carry a broadcast hint, by their count."""
    wanted = points.select(*by, F.col(at).alias("time")).distinct()
    both = settled(curve.select(*by, "time", "survival", F.lit(0).alias("_point")).unionByName(
        wanted.select(*by, "time", F.lit(None).cast("double").alias("survival"), F.lit(1).alias("_point"))
    ))
    filled = running(both, by, ["time", "_point"], {"_s": ("min", F.col("survival"))}, split).where("_point = 1")
    found = filled.select(*by, F.col("time").alias(at), F.coalesce("_s", F.lit(1.0)).alias(name))
    return found.hint("broadcast") if not fits_one_task(points, TINY) and both.where("_point = 1").count() <= FEW_VALUES else found


def pooled_and_by(df: DataFrame, group: str, label: str = "condition") -> DataFrame:
    """Each row once under `pooled` and once under its group value."""
    return df.withColumn(label, F.explode(F.array(F.lit("pooled"), F.col(group).cast("string"))))


def median_survival(curves: DataFrame, by: Sequence[str], time: str = "evaluation_time", survival: str = "survival") -> DataFrame:
    """First time the curve is at or below one half; NULL without a crossing."""
    return curves.groupBy(*by).agg(F.min(F.when(F.col(survival) <= 0.5, F.col(time))).alias("median_survival"))


def horizon_survival(curves: DataFrame, by: Sequence[str], horizons: Sequence[float], time: str = "evaluation_time", survival: str = "survival") -> DataFrame:
    """Linear interpolation of each curve at the horizons, NULL outside its grid.

    Each segment of a curve emits the horizons it covers, so no range join is needed. Needs `grid_index`.
    """
    indexed = curves.withColumn("sequence_index", F.col("grid_index").cast("bigint"))
    t, s = F.col(time), F.col(survival)
    segments = trailing(indexed, by, 1, {"_t0": lambda w: F.lag(t).over(w), "_s0": lambda w: F.lag(s).over(w)})
    wanted = F.array(*[F.lit(float(h)) for h in horizons])
    inside = F.filter(wanted, lambda h: F.when(F.col("_t0").isNull(), h == t).otherwise((h > F.col("_t0")) & (h <= t)))
    hits = segments.withColumn("horizon_minutes", F.explode(inside))
    slope = F.coalesce(F.try_divide(s - F.col("_s0"), t - F.col("_t0")), F.lit(0.0))
    value = F.when(F.col("_t0").isNull(), s).otherwise(F.col("_s0") + slope * (F.col("horizon_minutes") - F.col("_t0")))
    found = hits.select(*by, "horizon_minutes", value.alias("survival_probability"))
    asked = curves.where("grid_index = 0").select(*by, F.explode(wanted).alias("horizon_minutes"))
    return asked.join(found, [*by, "horizon_minutes"], "left").withColumn("failure_probability", 1 - F.col("survival_probability"))


def curve_issues(curves: DataFrame, by: Sequence[str], survival: str = "survival") -> DataFrame:
    """Curve points outside [0, 1] or above their predecessor."""
    indexed = curves.withColumn("sequence_index", F.col("grid_index").cast("bigint"))
    s = F.col(survival)
    rows = trailing(indexed, by, 1, {"_before": lambda w: F.lag(s).over(w)})
    code = F.when(s.isNull() | F.isnan(s) | (s < -1e-12) | (s > 1 + 1e-12), "probability_out_of_range").when(s - F.col("_before") > 1e-10, "survival_increases")
    return rows.select(*by, "grid_index", code.alias("code")).where("code IS NOT NULL")


# concordance -----------------------------------------------------------------------------------------------

#: Rows of whole groups that a task counts at once.
COUNTED_ROWS = 200_000


def _pairs(group: np.ndarray, t: np.ndarray, e: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Per group (0, 1, ...) concordant, tied and comparable weight; `x` are whole numbers that fall as the risk rises.

    Rows are kept in order of (group, higher digits of the time rank, x) and divided stably by the next digit, so every digit is a few passes.
    """
    n, groups = len(t), int(group[-1]) + 1
    order = np.lexsort((1 - e, t, group))  # at equal times an event comes first
    g, s, c = group[order], t[order], e[order]
    changed = np.append(True, (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1])) | (c[1:] != c[:-1]))
    rank = np.empty(n, dtype=np.int64)
    dense = np.cumsum(changed | np.append(True, g[1:] != g[:-1]))
    rank[order] = dense - dense[np.searchsorted(g, g)]
    order = np.lexsort((x, group))
    g, r, x, early = group[order], rank[order], x[order], np.where(e[order] == 1, w[order], 0.0)
    spots, found = np.arange(n), np.zeros((groups, 3))
    for level in range(max(int(r.max()).bit_length(), 1) - 1, -1, -1):
        high = r >> (level + 1)
        fresh = np.append(True, (g[1:] != g[:-1]) | (high[1:] != high[:-1]))
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.append(starts, n))
        runs = np.flatnonzero(fresh | np.append(True, x[1:] != x[:-1]))
        one = (r >> level) & 1
        upto = np.append(0.0, np.cumsum(np.where(one == 0, early, 0.0)))
        above, through = upto[runs], upto[np.append(runs[1:], n)]
        base, whole = np.repeat(upto[starts], sizes), np.repeat(upto[starts + sizes], sizes)
        counts = np.add.reduceat(one, runs)
        at = g[runs]
        found[:, 0] += np.bincount(at, counts * (above - base[runs]), groups)
        found[:, 1] += np.bincount(at, counts * (through - above), groups)
        found[:, 2] += np.bincount(at, counts * (whole - base)[runs], groups)
        zeros = np.append(0, np.cumsum(1 - one))
        first = np.repeat(starts, sizes)
        before = zeros[:-1] - zeros[first]
        place = np.where(one == 0, first + before, spots - before + np.repeat(zeros[starts + sizes] - zeros[starts], sizes))
        moved = np.empty(n, dtype=np.int64)
        moved[place] = spots
        g, r, x, early = g[moved], r[moved], x[moved], early[moved]
    return found


def _counted(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Concordance of groups that a task holds: whole groups are dealt to tasks, which count many at once."""
    by, schema = list(by), rows.schema
    known = [F.col(k).isNotNull() for k in by]
    # a group with a NULL key has no pairs; NULL is the highest risk and NaN the lowest, as in a sort of the negated risk
    usable = reduce(lambda a, b: a & b, [*known, F.col("_t").isNotNull(), F.col("_e").isNotNull()])
    marked = rows.select(*by, *[F.when(usable, F.col(c)).alias(c) for c in ("_t", "_e", "_x", "_w")], F.coalesce(usable, F.lit(False)).alias("_use"))
    dealt = (marked.repartition(*by) if by else marked.coalesce(1)).sortWithinPartitions(*by)
    fields = pa.schema([*[(k, to_arrow_type(schema[k].dataType)) for k in by], *[(c, pa.float64()) for c in ("concordant", "tied_risk", "comparable")]])

    def numbers(table: pa.Table) -> np.ndarray:
        """The number of every row's group; groups are adjacent."""
        changed = np.zeros(table.num_rows, dtype=bool)
        for k in range(len(by)):
            codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            changed[1:] |= codes[1:] != codes[:-1]
        return np.cumsum(changed)

    def tallied(table: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        result = np.zeros((len(starts), 3))
        use = np.flatnonzero(table.column("_use").to_numpy())
        if len(use):
            t, e, x, w = (table.column(c).take(pa.array(use)) for c in ("_t", "_e", "_x", "_w"))
            missing = x.is_null().to_numpy()
            risk = x.fill_null(0.0).to_numpy()
            number = np.unique(-risk, return_inverse=True)[1] + 1  # NaN, the lowest risk, comes last
            number[missing] = 0
            names, own = np.unique(group[use], return_inverse=True)
            result[names] = _pairs(own, t.to_numpy(), e.to_numpy(), number, w.fill_null(0.0).to_numpy())
        keys = table.select(by).take(pa.array(starts)) if by else None
        cells = [keys.column(k).combine_chunks().cast(fields.field(k).type) for k in range(len(by))] if by else []
        return pa.RecordBatch.from_arrays([*cells, *[pa.array(result[:, i]) for i in range(3)]], schema=fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= COUNTED_ROWS:
                table = pa.Table.from_batches(held)
                group = numbers(table)
                last = int(np.searchsorted(group, group[-1]))  # the last group may go on
                if last:
                    yield tallied(table.slice(0, last), group[:last])
                held = table.slice(last).to_batches()
                size = 0 if last else size // 2  # a group longer than that waits for as many rows again
        if held:
            table = pa.Table.from_batches(held)
            if table.num_rows:
                yield tallied(table, numbers(table))

    ddl = ", ".join([*[f"`{k}` {schema[k].dataType.simpleString()}" for k in by], "concordant double, tied_risk double, comparable double"])
    return dealt.mapInArrow(count, ddl).withColumn("concordance", F.try_divide(F.col("concordant") + F.col("tied_risk") / 2, F.col("comparable")))


def concordance(df: DataFrame, by: Sequence[str], time: str, event: str, risk: str, weight: str, split: bool | None = None) -> DataFrame:
    """Concordance of risk and time over all comparable pairs, tied risks counting one half.

    A pair is comparable when the earlier row is an event; at equal times an event precedes censored rows.
    No pair is formed: rows get a dense time rank, and two ranks differ first at exactly one binary digit. Per
    digit, rows with the same higher digits form a group in which the 0 side is earlier than the 1 side, so
    running weights over falling risk count the pairs. The cost is n log n for a group of any size. Groups that a task
    holds are counted digit by digit inside tasks (`_pairs`), larger ones by a row per digit.
    """
    by = list(by)
    rows = df.select(*by, F.col(time).alias("_t"), F.col(event).cast("int").alias("_e"), F.round(F.col(risk).cast("double"), 8).alias("_x"), F.col(weight).cast("double").alias("_w"))
    if split is None and not fits_one_task(df, TINY):
        rows = cut(rows)
        split = not groups_fit(rows, by)
    if not split:
        return _counted(rows, by)
    spots = index_units(rows.select(*by, "_t", (1 - F.col("_e")).alias("_c")).distinct(), by, ["_t", "_c"], split)
    sized = with_totals(spots, by, {"_last": F.max("sequence_index")}, split).withColumn("_e", 1 - F.col("_c"))
    ranked = rows.join(sized.select(*by, "_t", "_e", F.col("sequence_index").alias("_r"), "_last"), [*by, "_t", "_e"])
    levels = F.sequence(F.lit(0), F.greatest(F.length(F.bin("_last")) - 1, F.lit(0)))
    spread = ranked.withColumn("_level", F.explode(levels)).withColumns(
        {"_late": F.expr("shiftright(_r, _level) & 1"), "_group": F.expr("shiftright(_r, _level + 1)")}
    )
    keys = [*by, "_level", "_group"]
    early = (F.col("_late") == 0) & (F.col("_e") == 1)
    tallied = spread.where(early | (F.col("_late") == 1)).groupBy(*keys, "_x").agg(
        F.sum(F.when(early, F.col("_w")).otherwise(0.0)).alias("_lw"), F.count_if(F.col("_late") == 1).alias("_rc")
    )
    above = running(tallied.withColumn("_neg", -F.col("_x")), keys, ["_neg"], {"_higher": ("sum", F.col("_lw"))}, split, exclusive=True)
    per_group = above.groupBy(*keys).agg(
        F.sum(F.col("_rc") * F.coalesce("_higher", F.lit(0.0))).alias("_con"), F.sum(F.col("_rc") * F.col("_lw")).alias("_tie"), (F.sum("_rc") * F.sum("_lw")).alias("_all")
    )
    totals = per_group.groupBy(*by).agg(F.sum("_con").alias("concordant"), F.sum("_tie").alias("tied_risk"), F.sum("_all").alias("comparable"))
    everyone = rows.select(*by).distinct()
    return everyone.join(totals, by, "left").fillna(0.0, ["concordant", "tied_risk", "comparable"]).withColumn(
        "concordance", F.try_divide(F.col("concordant") + F.col("tied_risk") / 2, F.col("comparable"))
    )


# IPCW metrics ----------------------------------------------------------------------------------------------


def supported_grid(train: DataFrame, test: DataFrame, grid: DataFrame, scope: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Grid times strictly inside both duration ranges; `by` extends `scope` by the tested unit."""
    t = "duration_minutes"
    a = train.groupBy(*scope).agg(F.min(t).alias("_a0"), F.max(t).alias("_a1"))
    b = test.groupBy(*by).agg(F.min(t).alias("_b0"), F.max(t).alias("_b1"))
    low, high = F.greatest(F.lit(0.0), F.col("_a0"), F.col("_b0")), F.least("_a1", "_b1")
    joined = b.join(a, list(scope)).join(grid, list(scope))
    return joined.where((F.col("evaluation_time") > low) & (F.col("evaluation_time") < high)).select(*by, "grid_index", "evaluation_time")


def brier(train: DataFrame, curves: DataFrame, support: DataFrame, scope: Sequence[str], by: Sequence[str], split: bool | None = None) -> DataFrame:
    """Inverse-censoring-weighted Brier score at every supported time.

    `curves` is long: landmark rows with duration_minutes, event_observed, grid_index, evaluation_time, survival.
    """
    scope, by = list(scope), list(by)
    g = settled(censoring_curve(train, scope, split=split))
    kept = curves.join(support.select(*by, "grid_index"), [*by, "grid_index"], "left_semi")
    # values are looked up for the times of all curves, so that only their two columns are read
    at_own = kept.join(step_values(g, curves, scope, "duration_minutes", "_g_own", split), [*scope, "duration_minutes"])
    both = at_own.join(step_values(g, curves, scope, "evaluation_time", "_g_time", split), [*scope, "evaluation_time"])
    t, s = F.col("evaluation_time"), F.col("survival")
    case = (F.col("duration_minutes") <= t) & (F.col("event_observed") == 1)
    control = F.col("duration_minutes") > t
    score = F.when(case, F.try_divide(s * s, F.col("_g_own"))).when(control, F.try_divide((1 - s) * (1 - s), F.col("_g_time"))).otherwise(0.0)
    return both.groupBy(*by, "grid_index", "evaluation_time").agg(F.avg(F.coalesce(score, F.lit(0.0))).alias("brier_score"))


def integrated(scores: DataFrame, by: Sequence[str], value: str = "brier_score", least: int = 2) -> DataFrame:
    """Trapezoid integral of a score over its times divided by their span; NULL below `least` times."""
    t = F.col("evaluation_time")
    indexed = index_units(settled(scores), by, ["evaluation_time"])
    rows = trailing(indexed, by, 1, {"_t0": lambda w: F.lag(t).over(w), "_v0": lambda w: F.lag(value).over(w)})
    area = F.sum((F.col(value) + F.col("_v0")) / 2 * (t - F.col("_t0")))
    return rows.groupBy(*by).agg(
        F.when(F.count(F.lit(1)) >= least, F.try_divide(area, F.max(t) - F.min(t))).alias("integrated_brier_score"),
        F.count(F.lit(1)).alias("supported_grid_points"), F.min(t).alias("grid_lower"), F.max(t).alias("grid_upper"),
    )


def curve_risk(curves: DataFrame, support: DataFrame, by: Sequence[str]) -> DataFrame:
    """Risk of a landmark: minus the area under its curve over the supported times."""
    kept = curves.join(support.select(*by, "grid_index"), [*by, "grid_index"], "left_semi")
    keys = [*by, "landmark_id"]
    t, s = F.col("evaluation_time"), F.col("survival")
    indexed = kept.withColumn("sequence_index", F.col("grid_index").cast("bigint"))
    rows = trailing(indexed, keys, 1, {"_t0": lambda w: F.lag(t).over(w), "_s0": lambda w: F.lag(s).over(w)})
    return rows.groupBy(*keys).agg(
        F.max("duration_minutes").alias("duration_minutes"), F.max("event_observed").alias("event_observed"),
        F.coalesce(-F.sum((s + F.col("_s0")) / 2 * (t - F.col("_t0"))), F.lit(0.0)).alias("risk"),
    )


def ipcw_concordance(train: DataFrame, risks: DataFrame, taus: DataFrame, scope: Sequence[str], by: Sequence[str], split: bool | None = None, curve: DataFrame | None = None) -> DataFrame:
    """Concordance weighted by 1 / G(T)^2 of the earlier event, truncated at `taus.grid_upper`; NULL if undefined.

    `curve` may pass the written censoring curve of `train`.
    """
    curve = settled(censoring_curve(train, scope, split=split)) if curve is None else curve
    looked = step_lookup(curve, risks, list(scope), "duration_minutes", "_g", split).join(taus.select(*by, "grid_upper"), list(by))
    use = (F.col("event_observed") == 1) & (F.col("duration_minutes") < F.col("grid_upper"))
    weight = F.when(use, F.try_divide(F.lit(1.0), F.col("_g") * F.col("_g"))).otherwise(0.0)
    out = concordance(looked.withColumn("_weight", F.coalesce(weight, F.lit(0.0))), by, "duration_minutes", "event_observed", "risk", "_weight", split)
    broken = looked.groupBy(*by).agg(F.count_if(use & (F.col("_g") == 0)).alias("_undefined"))
    return out.join(broken, list(by)).select(*by, F.when(F.col("_undefined") == 0, F.col("concordance")).alias("ipcw_c_index"))


def supported_scores(train: DataFrame, curves: DataFrame, grid: DataFrame, scope: Sequence[str], by: Sequence[str], split: bool | None = None) -> DataFrame:
    """Brier scores at the supported times of every tested unit."""
    return brier(train, curves, supported_grid(train, curves.where("grid_index = 0"), grid, scope, by), scope, by, split)


#: Reasons of a unit without metrics, in the order they are looked for. Fixed values.
UNSUPPORTED = ("fewer than two supported evaluation times", "durations beyond the training support", "no event among the landmarks", "no comparable pair of landmarks")


def unit_metrics(train: DataFrame, curves: DataFrame, grid: DataFrame, scope: Sequence[str], by: Sequence[str], split: bool | None = None, scores: DataFrame | None = None) -> DataFrame:
    """Brier, concordance and median-survival errors per tested unit; an unsupported unit has its reason in place of the first two.

    A unit with a landmark beyond the last training time is unsupported while the censoring curve there is above zero: the weights are unknown.
    `scores` may pass written `supported_scores`.
    """
    scope, by = list(scope), list(by)
    landmark = curves.where("grid_index = 0")
    support = supported_grid(train, landmark, grid, scope, by)
    scored = integrated(scores if scores is not None else brier(train, curves, support, scope, by, split), by)
    risks = settled(curve_risk(curves, support, by))
    harrell = concordance(risks.withColumn("_one", F.lit(1.0)), by, "duration_minutes", "event_observed", "risk", "_one", split).select(
        *by, F.col("concordance").alias("harrell_c_index"), F.col("comparable").cast("bigint").alias("harrell_comparable_pairs")
    )
    uno = ipcw_concordance(train, risks, scored.where("supported_grid_points >= 2"), scope, by, split)
    medians = landmark.select(*by, "landmark_id", "duration_minutes", "event_observed").join(median_survival(curves, [*by, "landmark_id"]), [*by, "landmark_id"])
    error = F.col("median_survival") - F.col("duration_minutes")
    summary = medians.groupBy(*by).agg(
        F.count(F.lit(1)).alias("landmark_count"), F.avg(F.col("median_survival").isNotNull().cast("double")).alias("median_survival_coverage"),
        F.avg(F.abs(error)).alias("median_survival_mae"), F.sqrt(F.avg(error * error)).alias("median_survival_rmse"), F.avg(error).alias("median_survival_signed_error"),
        F.max("duration_minutes").alias("_longest"), F.max("event_observed").alias("_events"),
    )
    ends = train.groupBy(*scope).agg(F.max("duration_minutes").alias("_known")).join(censoring_curve(train, scope, split=split).groupBy(*scope).agg(F.min("survival").alias("_left")), scope)
    return _judged(summary.join(ends, scope).join(scored, by, "left").join(harrell, by, "left").join(uno, by, "left"))


def _judged(joined: DataFrame) -> DataFrame:
    """Units with the reason against their metrics, or with them."""
    checks = [F.coalesce(F.col("supported_grid_points") < 2, F.lit(True)), (F.col("_longest") > F.col("_known")) & (F.col("_left") > 0), F.col("_events") == 0, F.coalesce(F.col("harrell_comparable_pairs") == 0, F.lit(True))]
    reason = F.coalesce(*[F.when(c, r) for c, r in zip(checks, UNSUPPORTED, strict=True)])
    judged = joined.withColumn("failure_reason", reason).withColumn("valid", F.col("failure_reason").isNull())
    measured = ["integrated_brier_score", "harrell_c_index", "harrell_comparable_pairs", "ipcw_c_index", "supported_grid_points", "grid_lower", "grid_upper"]
    return judged.withColumns({m: F.when(F.col("valid"), F.col(m)) for m in measured}).drop("_longest", "_events", "_known", "_left")


def censoring_support(train: DataFrame, scope: Sequence[str], split: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """The written censoring curve and, per scope, its lowest value with the first and last training time: what all metrics of the scope read."""
    curve, t = cut(censoring_curve(train, scope, split=split)), "duration_minutes"
    ends = train.groupBy(*scope).agg(F.min(t).alias("_first"), F.max(t).alias("_known")).join(curve.groupBy(*scope).agg(F.min("survival").alias("_left")), list(scope))
    return curve, cut(ends)


def _area(points: Column) -> Column:
    """Trapezoid sum over an array of (t, v)."""
    steps = F.greatest(F.size(points) - 1, F.lit(0))
    parts = F.zip_with(F.slice(points, F.lit(1), steps), F.slice(points, F.lit(2), steps), lambda a, b: (b["v"] + a["v"]) / 2 * (b["t"] - a["t"]))
    return F.aggregate(parts, F.lit(0.0), lambda total, part: total + part)


def array_unit_metrics(
    train: DataFrame, curves: DataFrame, grid: DataFrame, scope: Sequence[str], by: Sequence[str], horizons: DataFrame | None = None,
    known: tuple[DataFrame, DataFrame] | None = None, split: bool | None = None,
) -> DataFrame:
    """`unit_metrics` of curves that are one row per landmark: `survival` is an array in the order of the scope's `grid`, so no row per grid time exists.

    With `horizons` (`main_horizon` per scope) also `_near`, the score at the supported time nearest to it. `known` may pass `censoring_support`.
    """
    scope, by = list(scope), list(by)
    curves = curves.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in by]))  # as an equi-join would
    censoring, ends = known or censoring_support(train, scope, split)
    looked = step_lookup(censoring, grid.select(*scope, "grid_index", "evaluation_time"), scope, "evaluation_time", "_g", split)
    points = F.array_sort(F.collect_list(F.struct("grid_index", F.col("evaluation_time").alias("t"), "_g")))
    table = cut(looked.groupBy(*scope).agg(points.alias("_grid")))  # one row per scope
    count = table.agg(F.max(F.size("_grid"))).first()[0] or 0
    times = F.broadcast(table)
    d, event = F.col("duration_minutes"), F.col("event_observed")

    def score(z: Column, s: Column) -> Column:
        value = F.when((d <= z["t"]) & (event == 1), F.try_divide(s * s, F.col("_g_own"))).when(d > z["t"], F.try_divide((1 - s) * (1 - s), z["_g"])).otherwise(0.0)
        return F.when(d.isNotNull(), F.coalesce(value, F.lit(0.0)))

    lines = curves.join(step_values(censoring, curves, scope, "duration_minutes", "_g_own", split), [*scope, "duration_minutes"], "left").join(times, scope).select(
        *by, d, event, F.zip_with("_grid", "survival", score).alias("_scores"),
        F.array_min(F.zip_with("_grid", "survival", lambda z, s: F.when(s <= 0.5, z["t"]))).alias("median_survival"),
    )
    error = F.col("median_survival") - d
    summary = lines.groupBy(*by).agg(
        F.count(F.lit(1)).alias("landmark_count"), F.avg(F.col("median_survival").isNotNull().cast("double")).alias("median_survival_coverage"),
        F.avg(F.abs(error)).alias("median_survival_mae"), F.sqrt(F.avg(error * error)).alias("median_survival_rmse"), F.avg(error).alias("median_survival_signed_error"),
        F.min(d).alias("_shortest"), F.max(d).alias("_longest"), F.max(event).alias("_events"), F.array(*[F.avg(F.get("_scores", F.lit(j))) for j in range(count)]).alias("_means"),
    )
    low, high = F.greatest(F.lit(0.0), F.col("_first"), F.col("_shortest")), F.least("_known", "_longest")
    bounded = summary.join(times, scope).join(ends, scope).withColumns({"_low": low, "_high": high})
    scores = F.zip_with(F.slice("_means", F.lit(1), F.size("_grid")), "_grid", lambda v, z: F.struct(z["t"].alias("t"), v.alias("v")))
    spots, t = F.col("_spots"), lambda i: F.get("_spots", i)["t"]
    measured = bounded.withColumn("_spots", F.filter(scores, lambda p: (p["t"] > F.col("_low")) & (p["t"] < F.col("_high")) & p["v"].isNotNull()))
    if horizons is not None:
        near = lambda p: F.struct(F.abs(p["t"] - F.col("main_horizon")).alias("gap"), p["t"].alias("t"), p["v"].alias("v"))
        measured = measured.join(horizons, scope, "left").withColumn("_near", F.when(F.col("main_horizon").isNotNull(), F.array_min(F.transform(spots, near))["v"]))
    first, last = t(F.lit(0)), t(F.size("_spots") - 1)
    units = cut(measured.withColumns({
        "integrated_brier_score": F.when(F.size("_spots") >= 2, F.try_divide(_area(spots), last - first)), "supported_grid_points": F.size("_spots").cast("bigint"), "grid_lower": first, "grid_upper": last,
    }).drop("_means", "_grid", "_spots", "_first", "_shortest", "main_horizon"))
    inside = F.filter(F.zip_with("_grid", "survival", lambda z, s: F.struct(z["t"].alias("t"), s.alias("v"))), lambda p: (p["t"] > F.col("_low")) & (p["t"] < F.col("_high")))
    supported = curves.join(times, scope).join(units.where("supported_grid_points > 0").select(*by, "_low", "_high"), by)
    risks = cut(supported.select(*by, d, event, inside.alias("_inside")).select(*by, d, event, (0.0 - _area(F.col("_inside"))).alias("risk")))
    harrell = concordance(risks.withColumn("_one", F.lit(1.0)), by, "duration_minutes", "event_observed", "risk", "_one", split).select(
        *by, F.col("concordance").alias("harrell_c_index"), F.col("comparable").cast("bigint").alias("harrell_comparable_pairs")
    )
    uno = ipcw_concordance(train, risks, units.where("supported_grid_points >= 2"), scope, by, split, censoring)
    return _judged(units.join(harrell, by, "left").join(uno, by, "left")).drop("_low", "_high")


def rank_survival_candidates(records: DataFrame) -> DataFrame:
    order = ["validation_macro_ibs", "validation_main_horizon_brier", F.desc("validation_macro_ipcw_c_index"), "selected_feature_count", "complexity_order", "candidate_id"]
    return rank_candidates(records, ["fold", "scenario", "model"], order)


def calibration(predictions: DataFrame, by: Sequence[str], bins: int = 3, sparse: int = 10, split: bool | None = None) -> DataFrame:
    """Predicted against observed failure per quantile bin, on landmarks whose outcome at the horizon is known.

    Bin edges that repeat, or equal the extremes, are dropped as duplicates.
    """
    by = list(by)
    p = F.col("failure_probability")
    rows = predictions.where(p.isNotNull())
    distinct = rows.groupBy(*by, "failure_probability").agg(F.lit(1).alias("_d")).groupBy(*by).agg(F.count(F.lit(1)).alias("_distinct"))
    wanted = {f"_e{q}_{k}": (p, k / q) for q in range(2, bins + 1) for k in range(1, q)}
    ends = percentiles(rows, by, wanted, {"_min": F.min(p), "_max": F.max(p)}, split).join(distinct, by)
    chosen = F.array().cast("array<double>")
    for q in range(2, bins + 1):
        use = F.least(F.col("_distinct"), F.lit(bins).cast("bigint")) == q
        chosen = F.when(use, F.array(*[F.col(f"_e{q}_{k}") for k in range(1, q)])).otherwise(chosen)
    edges = ends.select(*by, F.array_distinct(F.filter(chosen, lambda e: (e > F.col("_min")) & (e < F.col("_max")))).alias("_edges"))
    placed = rows.join(edges, by).withColumn("calibration_bin", F.size(F.filter("_edges", lambda e: e < p)))
    t, h, e = F.col("duration_minutes"), F.col("horizon_minutes"), F.col("event_observed")
    failed = (e == 1) & (t <= h)
    known = failed | (t > h)
    out = placed.groupBy(*by, "calibration_bin").agg(
        F.avg(p).alias("mean_predicted_failure_probability"), F.avg(F.when(known, failed.cast("double"))).alias("observed_event_probability"),
        F.count(F.lit(1)).alias("landmark_count"), F.count_if(known).alias("known_outcome_count"),
    )
    return out.withColumns(
        {"calibration_difference": F.col("mean_predicted_failure_probability") - F.col("observed_event_probability"), "sparse_bin": F.col("known_outcome_count") < sparse}
    )


def horizon_brier(scores: DataFrame, by: Sequence[str], horizons: Sequence[float], split: bool | None = None) -> DataFrame:
    """Score at the grid time nearest to each horizon, if within half a median grid step of the grid."""
    scores = settled(scores)
    indexed = index_units(scores, by, ["evaluation_time"], split)
    t = F.col("evaluation_time")
    stepped = trailing(indexed, by, 1, {"_step": lambda w: t - F.lag(t).over(w)})
    span = percentiles(stepped, by, {"_spacing": (F.col("_step"), 0.5)}, {"_lo": F.min(t), "_hi": F.max(t)}, split)
    asked = scores.withColumn("horizon_minutes", F.explode(F.array(*[F.lit(float(h)) for h in horizons])))
    near = asked.groupBy(*by, "horizon_minutes").agg(
        F.min_by(F.struct("evaluation_time", "brier_score"), F.struct(F.abs(t - F.col("horizon_minutes")), t)).alias("_n")
    ).join(span, list(by))
    half, h = F.coalesce("_spacing", F.lit(0.0)) / 2, F.col("horizon_minutes")
    ok = (h >= F.col("_lo") - half) & (h <= F.col("_hi") + half)
    return near.select(*by, "horizon_minutes", F.when(ok, F.col("_n.evaluation_time")).alias("actual_evaluation_time"), F.when(ok, F.col("_n.brier_score")).alias("brier_score"), ok.alias("supported"))


def paired_comparisons(units: DataFrame, pairs: Sequence[tuple[str, str]], metric: str = "integrated_brier_score", split: bool | None = None) -> DataFrame:
    """Wilcoxon tests of unit-level differences for every model pair and scenario, Holm-adjusted per scenario."""
    keys = ["scenario", "fold", "condition_id", "unit_id"]
    listed = F.array(*[F.struct(F.lit(a).alias("candidate"), F.lit(b).alias("reference")) for a, b in pairs])
    scored = units.where(F.col(metric).isNotNull()).select(*keys, "model", F.col(metric).alias("_v"), F.inline(listed)).where("model IN (candidate, reference)")
    wide = scored.groupBy(*keys, "candidate", "reference").agg(
        F.max(F.when(F.col("model") == F.col("candidate"), F.col("_v"))).alias("_c"), F.max(F.when(F.col("model") == F.col("reference"), F.col("_v"))).alias("_r")
    )
    table = cut(wide.where("_c IS NOT NULL AND _r IS NOT NULL").withColumn("delta_mae", F.col("_c") - F.col("_r")))
    by = ["scenario", "candidate", "reference"]
    d = F.col("delta_mae")
    summary = percentiles(table, by, {"median_delta": (d, 0.5)}, {"mean_delta": F.avg(d), "wins": F.count_if(d < 0), "ties": F.count_if(d == 0), "losses": F.count_if(d > 0)}, split)
    tested = wilcoxon(table, by, 0.0, split=split).join(summary, by).withColumn("_id", F.concat_ws("|", "candidate", "reference"))
    return holm(tested, ["scenario"], "wilcoxon_p_raw", "_id", split=split).drop("_id")


def matched_rul(survival: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per unit: error of the predicted median survival against the error of each remaining-life model."""
    keys = ["fold", "unit_id", "acquisition_number"]
    joined = survival.where("median_survival IS NOT NULL").select(*keys, F.col("model").alias("survival_model"), "median_survival", "true_time_to_failure_minutes").join(
        predictions.select(*keys, F.col("experiment").alias("rul_experiment"), "prediction_non_negative_minutes"), keys
    )
    a = F.col("median_survival") - F.col("true_time_to_failure_minutes")
    b = F.col("prediction_non_negative_minutes") - F.col("true_time_to_failure_minutes")
    out = joined.groupBy("survival_model", "rul_experiment", "unit_id").agg(
        F.count(F.lit(1)).alias("support_size"), F.avg(F.abs(a)).alias("survival_median_mae"), F.sqrt(F.avg(a * a)).alias("survival_median_rmse"),
        F.avg(F.abs(b)).alias("existing_rul_mae"), F.sqrt(F.avg(b * b)).alias("existing_rul_rmse"),
    )
    return out.withColumn("delta_mae", F.col("survival_median_mae") - F.col("existing_rul_mae"))


def coefficient_consensus(coefficients: DataFrame, split: bool | None = None) -> DataFrame:
    """Coefficients by feature family: channel prefix removed, trend suffix folded together."""
    family = F.regexp_replace(F.regexp_replace("feature", r"^(horizontal|vertical)_", ""), r"__.*$", "_causal_descriptor")
    return percentiles(
        coefficients.withColumn("feature_family", family), ["feature_family"], {"median_hazard_ratio": (F.col("hazard_ratio"), 0.5)},
        {"fold_occurrences": F.countDistinct("fold"), "mean_absolute_coefficient": F.avg(F.abs("standardized_coefficient"))}, split,
    ).orderBy(F.desc("fold_occurrences"), F.desc("mean_absolute_coefficient"), "feature_family")


# Cox model -------------------------------------------------------------------------------------------------


def _linear(features: Sequence[str], weights: str = "_beta") -> Column:
    return sum((F.col(f) * F.get(weights, F.lit(i)) for i, f in enumerate(features)), F.lit(0.0))


def _risk_sums(rows: DataFrame, fold: str, features: Sequence[str], second: bool, split: bool | None) -> DataFrame:
    """Sums of e^eta, x e^eta (and x x' e^eta) over each distinct time's risk set, plus its event sums.

    The fold's largest eta (`shift`) is taken off first, so nothing overflows and no covariate's origin matters; the ratios of the
    sums and the likelihood do not depend on it.
    """
    rows = same_keys(rows, rows.groupBy(fold).agg(F.max(_linear(features)).alias("_shift")), [fold])
    eta = _linear(features) - F.col("_shift")
    e = F.exp(eta)
    cells = {"s0": e, **{f"s1_{i}": e * F.col(f) for i, f in enumerate(features)}}
    if second:
        cells |= {f"s2_{i}_{j}": e * F.col(a) * F.col(b) for i, a in enumerate(features) for j, b in enumerate(features) if j <= i}
    d = F.col("event_observed")
    per_time = rows.groupBy(fold, F.col("duration_minutes").alias("time")).agg(
        *[F.sum(c).alias(f"_{n}") for n, c in cells.items()], F.sum(d).alias("events"), F.sum(d * eta).alias("eta_events"),
        *[F.sum(d * F.col(f)).alias(f"x_events_{i}") for i, f in enumerate(features)], F.max("_shift").alias("shift"),
    )
    return running(settled(per_time).withColumn("_late", -F.col("time")), [fold], ["_late"], {n: ("sum", F.col(f"_{n}")) for n in cells}, split)


def fit_cox(rows: DataFrame, features: Sequence[str], alpha: float, fold: str = "fold", steps: int = cox.STEPS) -> DataFrame:
    """Ridge-penalised Cox coefficients per fold (Breslow ties); a fold that does not converge is an error."""
    vector = F.array(*[F.col(f).cast("double") for f in features])
    blocks = cox.packed(rows.withColumn("_vector", vector), [fold], "_vector")
    folds = sorted(r[fold] for r in rows.select(fold).distinct().collect())
    fits = cox.fit_many(blocks, [fold], [cox.Spec((f,), 0, tuple(range(len(features))), alpha) for f in folds], steps)
    if failed := [f for f in fits if f.failure]:
        raise ValueError(f"Cox model of fold {failed[0].spec.scope[0]}: {failed[0].failure}")
    kind = rows.schema[fold].dataType.simpleString()
    table = [(f.spec.scope[0], name, float(b), float(np.exp(np.clip(b, -50, 50)))) for f in fits for name, b in zip(features, f.beta, strict=True)]
    return parameter_table(rows.sparkSession, table, f"{fold} {kind}, feature string, standardized_coefficient double, hazard_ratio double")


def _packed(coefficients: DataFrame, features: Sequence[str], fold: str) -> DataFrame:
    cells = [F.max(F.when(F.col("feature") == f, F.col("standardized_coefficient"))) for f in features]
    return coefficients.groupBy(fold).agg(F.array(*cells).alias("_beta"))


def baseline_hazard(rows: DataFrame, coefficients: DataFrame, features: Sequence[str], fold: str = "fold", split: bool | None = None) -> DataFrame:
    """Breslow cumulative baseline hazard as `survival` = exp(-H0) steps."""
    sums = _risk_sums(rows.join(_packed(coefficients, features, fold), fold), fold, features, False, split)
    steps = sums.select(fold, "time", (F.col("events") / F.col("s0") * F.exp(-F.col("shift"))).alias("_h"))
    return running(steps, [fold], ["time"], {"_total": ("sum", F.col("_h"))}, split).select(fold, "time", F.exp(-F.col("_total")).alias("survival"))


def cox_curves(rows: DataFrame, coefficients: DataFrame, hazard: DataFrame, grid: DataFrame, features: Sequence[str], fold: str = "fold", split: bool | None = None) -> DataFrame:
    """Survival of every row at every grid time of its fold: exp(-H0(t)) ** e^eta."""
    base = step_lookup(hazard, grid, [fold], "evaluation_time", "_s0", split)
    scored = rows.join(_packed(coefficients, features, fold), fold).withColumn("_risk", F.exp(_linear(features)))
    return scored.join(base, fold).withColumn("survival", F.pow("_s0", "_risk")).drop("_s0", "_risk", "_beta")


def schoenfeld(rows: DataFrame, coefficients: DataFrame, features: Sequence[str], fold: str = "fold", split: bool | None = None) -> DataFrame:
    """Mean residual (covariate minus risk-set mean at the event) and mean log event time per unit and feature."""
    sums = _risk_sums(rows.join(_packed(coefficients, features, fold), fold), fold, features, False, split)
    means = sums.select(fold, F.col("time").alias("duration_minutes"), *[(F.col(f"s1_{i}") / F.col("s0")).alias(f"_m{i}") for i in range(len(features))])
    events = rows.where("event_observed = 1 AND duration_minutes > 0").join(means, [fold, "duration_minutes"])
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), (F.col(f) - F.col(f"_m{i}")).alias("residual")) for i, f in enumerate(features)])
    return events.select(fold, "unit_id", F.ln("duration_minutes").alias("log_time"), F.inline(cells)).groupBy(fold, "unit_id", "feature").agg(
        F.avg("residual").alias("residual"), F.avg("log_time").alias("log_event_time")
    )


def proportional_hazards(residuals: DataFrame, permutations: int = 499, fold: str = "fold", seed: int = 1847, split: bool | None = None) -> DataFrame:
    """|Spearman| of residual and log time per feature, with permutation p per feature and for the maximum.

    Units are paired with permuted times in the order of MD5 hashes; the pairing is an equi-join on position.
    """
    by = [fold, "feature"]
    residuals = residuals.withColumns({c: F.round(c, 9) for c in ("residual", "log_event_time")})  # closer values tie
    ranked = average_ranks(average_ranks(residuals, by, "residual", "_x", split), by, "log_event_time", "_y", split)
    observed = ranked.groupBy(*by).agg(F.abs(correlation("_x", "_y")).alias("absolute_spearman"), F.count(F.lit(1)).alias("independent_units"))
    placed = index_units(ranked.select(*by, "unit_id", "_x"), by, ["unit_id"], split)
    runs = F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("_run")
    times = residuals.select(fold, "unit_id", "log_event_time").distinct()
    shuffled = index_units(average_ranks(times, [fold], "log_event_time", "_y", split).select(fold, "unit_id", "_y", runs).withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), "_run", "unit_id"))), [fold, "_run"], ["_h", "unit_id"], split)
    null = placed.join(shuffled.select(fold, "_run", "sequence_index", "_y"), [fold, "sequence_index"]).groupBy(*by, "_run").agg(F.abs(correlation("_x", "_y")).alias("_rho"))
    judged = null.join(observed, by).groupBy(*by, "absolute_spearman", "independent_units").agg(F.count_if(F.col("_rho") >= F.col("absolute_spearman") - 1e-12).alias("_ge"))
    top = observed.groupBy(fold).agg(F.max("absolute_spearman").alias("absolute_spearman"), F.max("independent_units").alias("independent_units"))
    global_null = null.groupBy(fold, "_run").agg(F.max("_rho").alias("_rho")).join(top, fold).groupBy(fold, "absolute_spearman", "independent_units").agg(
        F.count_if(F.col("_rho") >= F.col("absolute_spearman") - 1e-12).alias("_ge")
    )
    both = judged.withColumn("scope", F.lit("feature")).unionByName(global_null.withColumns({"feature": F.lit("__global__"), "scope": F.lit("global")}))
    p = (F.col("_ge") + 1) / (permutations + 1)
    return both.select(fold, "scope", "feature", "absolute_spearman", p.alias("p_value"), (p < 0.05).alias("evidence_against_ph"), "independent_units")


# discrete-time forest --------------------------------------------------------------------------------------


def person_periods(rows: DataFrame, grid: DataFrame, fold: str = "fold", kept: bool = False) -> DataFrame:
    """One row per landmark and grid interval it entered, labelled 1 where its event falls inside.

    With `kept` the rows stay in their partitions: the intervals, a few per fold, are broadcast.
    """
    t = F.col("evaluation_time")
    points = grid.withColumn("sequence_index", F.col("grid_index").cast("bigint"))
    spans = trailing(points, [fold], 1, {"_from": lambda w: F.coalesce(F.lag(t).over(w), F.lit(0.0))}).drop("sequence_index")
    joined = rows.join(F.broadcast(spans) if kept else spans, fold).where(F.col("duration_minutes") > F.col("_from"))
    hit = (F.col("event_observed") == 1) & (F.col("duration_minutes") <= t)
    return joined.withColumn("label", hit.cast("double")).drop("_from")


#: Rows of one landmark and interval each that a task of the forest holds; their bytes are few for the work they cause.
PERIOD_ROWS = 50_000


def hazard_forest(train: DataFrame, score: DataFrame, grid: DataFrame, features: Sequence[str], parameters: dict, fold: str = "fold", seed: int = 42) -> DataFrame:
    """Survival curves from a weighted forest of interval hazards: the running product of 1 - hazard.

    MLlib takes the partitions of the rows as its tasks, and adaptive execution would merge them by their few bytes, so rows beyond one task are
    dealt out first.
    """
    inputs, keys = [*features, "evaluation_time"], [fold, "landmark_id"]
    assembler = VectorAssembler(inputCols=inputs, outputCol="_x")
    points = grid.groupBy(fold).count().agg(F.max("count")).first()[0] or 0
    tasks, asked_tasks = (-(-rows.count() * points // PERIOD_ROWS) for rows in (train, score))
    dealt = train.repartition(tasks, *keys).sortWithinPartitions(*keys) if tasks > 1 else train
    periods = person_periods(dealt, grid, fold, kept=tasks > 1)
    model = RandomForestClassifier(featuresCol="_x", labelCol="label", weightCol="landmark_weight", seed=seed, **parameters).fit(assembler.transform(periods))
    asked = assembler.transform(score.repartition(asked_tasks, *keys).join(F.broadcast(grid), fold) if asked_tasks > 1 else score.join(grid, fold))
    hazard = vector_to_array("probability")[1]
    scored = model.transform(asked).withColumn("_log", F.log1p(-F.least(hazard, F.lit(1 - 1e-12)))).drop("_x", "rawPrediction", "probability", "prediction")
    # a landmark has one row per grid time, a fixed number
    upto = Window.partitionBy(fold, "landmark_id").orderBy("grid_index").rowsBetween(Window.unboundedPreceding, 0)
    return scored.withColumn("survival", F.exp(F.sum("_log").over(upto))).drop("_log")
