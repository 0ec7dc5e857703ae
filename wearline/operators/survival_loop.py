"""The survival candidate loop: filter and rank features, fit all candidates, choose on validation units, freeze, score test units.

Every step works for all scopes (scenario and fold) at once. Training rows alone decide which features stay, how they are scaled, which
landmarks the equal-count sample holds, and the evaluation times. Candidates are Kaplan-Meier, Cox on the context columns, and Cox on the 5, 10 and
15 most relevant features, under three penalties; all Cox models are fitted side by side (`cox.fit_many`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.operators import cox, folds
from wearline.operators import survival as su
from wearline.operators.scale import average_ranks, settled, unpivot
from wearline.operators.scaling import moments_by_fold, robust_parameters
from wearline.session import cut, parameter_table

#: Candidate grid and filter thresholds. Fixed values.
FEATURE_COUNTS = (5, 10, 15)
ALPHAS = (0.1, 1.0, 10.0)
CORRELATION = 0.95
NEAR_CONSTANT = 0.999
#: Survival forests that take a number behind the Cox models of every feature count.
FORESTS = 3
MODELS = ("landmark_km_baseline", "cox_context_only", "cox_causal_features")

SCOPE = ["scenario", "fold"]


def _ddl(rows: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)


def filter_and_rank(train: DataFrame, features: Sequence[str], scope: Sequence[str] = SCOPE, key: str = "landmark_id") -> tuple[DataFrame, dict[tuple, list[str]]]:
    """(scope, feature, status, related_feature, survival_relevance, rank) and, per scope, the kept names by rank.

    Names that are no numeric column are reported as such. The driver sees features x features numbers per scope.
    """
    scope, spark = list(scope), train.sparkSession
    numeric = {f.name for f in train.schema if f.dataType.typeName() in ("double", "float", "long", "integer", "short", "byte", "decimal")}
    usable = sorted(f for f in features if f in numeric)
    long = cut(unpivot(train, [*scope, key, "duration_minutes", "event_observed"], usable))
    status = cut(su.screen_features(long, key, NEAR_CONSTANT, scope))
    held = cut(long.join(status.where("status = 'retained'").select(*scope, "feature"), [*scope, "feature"]))
    relevance = su.univariate_relevance(held, [*scope, "feature"])
    scores: dict[tuple, dict[str, float]] = {}
    for r in relevance.collect():  # one number per scope and feature
        scores.setdefault(tuple(r[c] for c in scope), {})[r["feature"]] = r["survival_relevance"]
    scopes = sorted(scores)
    ranked = average_ranks(held, [*scope, "feature"], "value", "_rank")
    cells = [F.max(F.when(F.col("feature") == f, F.col("_rank").cast("double"))) for f in usable]
    numbered = parameter_table(spark, [(*s, i) for i, s in enumerate(scopes)], f"{_ddl(train, scope)}, _scope int")
    wide = ranked.groupBy(*scope, key).agg(F.array(*[F.coalesce(c, F.lit(0.0)) for c in cells]).alias("x")).join(numbered, scope)
    moments = moments_by_fold(wide.select(F.col("_scope").alias("fold"), "x"), len(usable)) if scopes else {}
    kept: dict[tuple, list[str]] = {}
    pruned: list[tuple] = []
    for i, s in enumerate(scopes):
        covariance = moments[i][2]
        spread = np.sqrt(np.maximum(np.diag(covariance), 0))
        rho = covariance / np.where(np.outer(spread, spread) > 0, np.outer(spread, spread), np.inf)
        kept[s] = []
        for name in sorted(scores[s], key=lambda f: (-scores[s][f], f)):
            at = usable.index(name)
            rival = next((k for k in kept[s] if abs(rho[at, usable.index(k)]) >= CORRELATION), None)
            if rival is None:
                kept[s].append(name)
            pruned.append((*s, name, rival, scores[s][name], None if rival else len(kept[s])))
    verdict = parameter_table(spark, pruned, f"{_ddl(train, scope)}, feature string, _rival string, survival_relevance double, rank int")
    table = status.join(verdict, [*scope, "feature"], "left").select(
        *scope, "feature", F.when(F.col("_rival").isNotNull(), "correlation_pruned").otherwise(F.col("status")).alias("status"),
        F.coalesce("_rival", "related_feature").alias("related_feature"), "survival_relevance", "rank",
    )
    if others := sorted(set(features) - set(usable)):
        listed = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit("non_numeric_or_missing").alias("status"), F.lit(None).cast("string").alias("related_feature"), F.lit(None).cast("double").alias("survival_relevance"), F.lit(None).cast("int").alias("rank")) for f in others])
        table = table.unionByName(train.select(*scope).distinct().select(*scope, F.inline(listed)))
    return table, kept


def candidates(kept: Mapping[tuple, Sequence[str]], context: Sequence[str]) -> list[dict]:
    """Every candidate of every scope with its number; a feature count that a scope cannot fill is listed with the reason."""
    found = []
    for scope, names in kept.items():
        found.append({"scope": scope, "candidate_id": 1, "model": MODELS[0], "complexity_order": 0, "features": [], "alpha": None, "failure": None})
        for i, alpha in enumerate(ALPHAS):
            found.append({"scope": scope, "candidate_id": 2 + i, "model": MODELS[1], "complexity_order": 10 + int(alpha * 10), "features": list(context), "alpha": alpha, "failure": None})
        for c, count in enumerate(FEATURE_COUNTS):
            failure = None if len(names) >= count else "insufficient retained causal features"
            for i, alpha in enumerate(ALPHAS):
                number = 2 + len(ALPHAS) + c * (len(ALPHAS) + FORESTS) + i
                found.append({"scope": scope, "candidate_id": number, "model": MODELS[2], "complexity_order": 100 + count + int(alpha * 10), "features": list(names[:count]), "alpha": alpha, "failure": failure})
    return found


def scaled_rows(rows: DataFrame, sample: DataFrame, names: Sequence[str], scope: Sequence[str] = SCOPE) -> DataFrame:
    """`rows` with `x`, the named columns centred and scaled by the median and interquartile range of the sample's rows."""
    scope = list(scope)
    parameters = robust_parameters(unpivot(sample, scope, names), scope)
    cell = lambda column, f, other: F.coalesce(F.max(F.when(F.col("feature") == f, F.col(column))), F.lit(other))
    table = parameters.groupBy(*scope).agg(F.array(*[cell("center", f, 0.0) for f in names]).alias("_c"), F.array(*[cell("scale", f, 1.0) for f in names]).alias("_s"))
    vector = F.array(*[F.col(f).cast("double") for f in names])
    return rows.join(table, scope).withColumn("x", F.zip_with(F.zip_with(vector, "_c", lambda v, c: v - c), "_s", lambda v, s: v / s)).drop("_c", "_s")


def baseline_curves(rows: DataFrame, sample: DataFrame, grid: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """The Kaplan-Meier curve of the sample for every row, an array over the grid times, as candidate 1."""
    scope = list(scope)
    curve = su.step_lookup(su.kaplan_meier(sample, scope), grid, scope, "evaluation_time")
    whole = F.transform(F.array_sort(F.collect_list(F.struct("grid_index", "survival"))), lambda p: p["survival"])  # the grid times of a scope
    return rows.join(F.broadcast(curve.groupBy(*scope).agg(whole.alias("survival"))), scope).withColumn("candidate_id", F.lit(1))


def validation_records(train: DataFrame, curves: DataFrame, grid: DataFrame, horizons: DataFrame, scope: Sequence[str] = SCOPE, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Macro metrics of every candidate over its validation units; where no unit is supported, those of all landmarks together.

    `curves` has an array per landmark and candidate. `horizons` has `main_horizon` per scope: the score at the time nearest to it breaks ties.
    """
    scope = list(scope)
    by = [*scope, "candidate_id"]
    known = known or su.censoring_support(train, scope)
    units = cut(su.array_unit_metrics(train, curves, grid, scope, [*by, "condition_id", "unit_id"], horizons, known))
    valid = F.col("valid")
    macro = units.groupBy(*by).agg(
        F.avg(F.when(valid, F.col("integrated_brier_score"))).alias("validation_macro_ibs"), F.avg(F.when(valid, F.col("_near"))).alias("validation_main_horizon_brier"),
        F.avg(F.when(valid, F.col("ipcw_c_index"))).alias("validation_macro_ipcw_c_index"), F.count_if(valid).alias("valid_validation_units"),
    )
    scopes = [F.lit("unit_macro").alias("validation_metric_scope"), F.lit("landmark_weighted_fallback_no_unit_supported").alias("validation_metric_scope")]
    supported = macro.where("valid_validation_units > 0").select("*", scopes[0])
    unsupported = macro.where("valid_validation_units = 0").select(*by)
    if unsupported.isEmpty():
        return supported
    left = settled(curves.join(unsupported, by, "left_semi"))
    pooled = su.array_unit_metrics(train, left, grid, scope, by, horizons, known).where("valid").select(
        *by, F.col("integrated_brier_score").alias("validation_macro_ibs"), F.col("_near").alias("validation_main_horizon_brier"), F.col("ipcw_c_index").alias("validation_macro_ipcw_c_index"),
        F.lit(0).cast("bigint").alias("valid_validation_units"), scopes[1],
    )
    return supported.unionByName(pooled)


def run(rows: DataFrame, features: Sequence[str], context: Sequence[str], grid: DataFrame, horizons: DataFrame, scope: Sequence[str] = SCOPE, unit: str = "unit_id", key: str = "landmark_id") -> dict[str, DataFrame]:
    """The whole loop over a written table of landmarks with scenario, fold, subset, outcome and feature columns.

    Returns `features` (filter and ranking), `candidates` (all records with rank, choice and failures), `coefficients` of all fits
    and `units` (test metrics of the chosen models, whose curves no test row has influenced).
    """
    scope, spark = list(scope), rows.sparkSession
    train = rows.where("subset = 'train'")
    table, kept = filter_and_rank(train, features, scope, key)
    listed = candidates(kept, context)
    names = sorted({f for c in listed for f in c["features"]} | set(context))
    drawn = cut(folds.equal_counts(train.select(*scope, unit, key), scope, unit, key))
    sample = cut(train.join(drawn, [*scope, unit, key], "left_semi"))
    outcome = [*scope, "subset", "condition_id", unit, key, "duration_minutes", "event_observed"]
    vectors = cut(scaled_rows(rows, sample, names, scope).select(*outcome, "x"))
    blocks = cox.packed(vectors.join(drawn, [*scope, unit, key], "left_semi"), scope)
    grids: dict[tuple, list[float]] = {}
    for r in grid.orderBy("grid_index").collect():  # a few points per scope
        grids.setdefault(tuple(r[c] for c in scope), []).append(r["evaluation_time"])
    grids = {s: np.array(v) for s, v in grids.items()}
    asked = [c for c in listed if c["alpha"] is not None and c["failure"] is None and c["scope"] in grids]
    fits = cox.fit_many(blocks, scope, [cox.Spec(c["scope"], c["candidate_id"], tuple(names.index(f) for f in c["features"]), c["alpha"]) for c in asked])
    failures = {(f.spec.scope, f.spec.candidate): f.failure for f in fits}
    fitted = [f for f in fits if f.failure is None]
    base = cox.hazards(blocks, scope, fitted, grids)

    def lines(subset: str, wanted: set | None = None) -> DataFrame:
        part = vectors.where(F.col("subset") == subset)
        use = [(f, h) for f, h in zip(fitted, base, strict=True) if wanted is None or (f.spec.scope, f.spec.candidate) in wanted]
        smooth = cox.curves(part, scope, [f for f, _ in use], [h for _, h in use], grids, whole=True)
        return cut(smooth.unionByName(baseline_curves(part.drop("x"), sample, grid, scope)))

    known = su.censoring_support(train, scope)
    records = validation_records(train, lines("validation"), grid, horizons, scope, known)
    rows_ = [
        (*c["scope"], c["candidate_id"], c["model"], c["complexity_order"], len(c["features"]), ",".join(c["features"]), c["alpha"], c["failure"] or failures.get((c["scope"], c["candidate_id"])))
        for c in listed
    ]
    described = parameter_table(spark, rows_, f"{_ddl(rows, scope)}, candidate_id int, model string, complexity_order int, selected_feature_count int, features string, alpha double, _failure string")
    joined = described.join(records, [*scope, "candidate_id"], "left")
    valid = F.col("validation_macro_ibs").isNotNull() & F.col("_failure").isNull()
    reason = F.when(~valid, F.coalesce("_failure", F.lit("no supported validation landmark")))
    judged = cut(joined.select("*", valid.alias("valid"), reason.alias("failure_reason")).drop("_failure"))
    order = ["validation_macro_ibs", F.col("validation_main_horizon_brier").asc_nulls_last(), F.col("validation_macro_ipcw_c_index").desc_nulls_last(), "selected_feature_count", "complexity_order", "candidate_id"]
    ranked = su.rank_candidates(judged.where("valid"), [*scope, "model"], order)
    out = judged.join(ranked.select(*scope, "candidate_id", "selection_rank", "selected"), [*scope, "candidate_id"], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
    out = cut(out)
    chosen = out.where("selected").select(*scope, "candidate_id", "model")
    wanted = {(tuple(r[c] for c in scope), r["candidate_id"]) for r in chosen.collect()}  # one per scope and model
    test = cut(lines("test", wanted).join(chosen, [*scope, "candidate_id"]))
    units = su.array_unit_metrics(train, test, grid, scope, [*scope, "model", "condition_id", unit], known=known)
    cells = [(*f.spec.scope, f.spec.candidate, names[c], float(b), float(np.exp(np.clip(b, -50, 50))), f.spec.alpha) for f in fitted for c, b in zip(f.spec.columns, f.beta, strict=True)]
    coefficients = parameter_table(spark, cells, f"{_ddl(rows, scope)}, candidate_id int, feature string, standardized_coefficient double, hazard_ratio double, alpha double")
    return {"features": table, "candidates": out, "coefficients": coefficients, "units": units}


def scenarios(marks: DataFrame) -> DataFrame:
    """Full follow-up, the fixed horizons and the target censoring rates as one table of landmarks by scenario."""
    full = marks.withColumn("scenario", F.lit("full_event"))
    fixed = su.fixed_horizon(marks).drop("horizon_minutes")
    rate = su.rate_censored(marks, su.rate_horizons(marks)).drop("target_censoring_rate", "administrative_horizon_minutes")
    return reduce(DataFrame.unionByName, [full, fixed, rate])


def evaluation_grids(train: DataFrame, points: int = su.GRID_POINTS, scope: Sequence[str] = SCOPE) -> DataFrame:
    """Evaluation times of every scope, fixed horizons ending at theirs; scopes without a supported interval have none."""
    fixed = F.col("scenario").startswith("fixed_horizon_")
    parts = [su.evaluation_grid(train.where(~fixed), scope, points, strict=False)]
    parts += [su.evaluation_grid(train.where(F.col("scenario") == f"fixed_horizon_{h:.0f}"), scope, points, horizon=h, strict=False) for h in su.HORIZONS]
    return reduce(DataFrame.unionByName, parts)


def main_horizons(grid: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """The fixed horizon of a scenario, at most the last grid time, or the grid's middle."""
    t, i = F.col("evaluation_time"), F.col("grid_index")
    stats = grid.groupBy(*scope).agg(F.max(t).alias("_last"), F.max_by(t, F.struct(-F.abs(i - F.lit(su.GRID_POINTS // 2)), i)).alias("_middle"))
    asked = F.when(F.col("scenario").startswith("fixed_horizon_"), F.substring_index("scenario", "_", -1).cast("double"))
    return stats.select(*scope, F.coalesce(F.least(asked, "_last"), "_middle").alias("main_horizon"))
