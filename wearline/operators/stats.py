"""Model consolidation: shared support, paired differences, resampling intervals, exact tests, consensus."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearline.operators.scale import average_ranks, index_units, percentiles, running, with_totals
from wearline.operators.trajectory import correlation
from wearline.session import cut

KEY = ["fold", "condition_id", "unit_id", "acquisition_number"]


def harmonise(sources: Sequence[DataFrame], allowed: Sequence[str]) -> DataFrame:
    """Union of prediction sources limited to the allowed experiments, with the composite row key."""
    merged = sources[0]
    for other in sources[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    key = F.concat_ws("|", "condition_id", "unit_id", "acquisition_number")
    return merged.where(F.col("experiment").isin(*allowed)).withColumn("canonical_key", key)


def harmony_issues(data: DataFrame) -> DataFrame:
    """Repeated keys, keys with several truths, units in several folds, values that are not finite."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    by_key = data.groupBy("experiment", "canonical_key").agg(F.count(F.lit(1)).alias("n"))
    truth = data.groupBy("canonical_key").agg((F.max("rul_minutes") - F.min("rul_minutes")).alias("spread"))
    folds = data.groupBy("unit_id").agg(F.countDistinct("fold").alias("folds"))
    parts = [
        by_key.where("n > 1").select(F.concat_ws(":", "experiment", "canonical_key").alias("path"), F.lit("duplicate_key").alias("code")),
        truth.where("spread > 0").select(F.col("canonical_key").alias("path"), F.lit("truth_mismatch").alias("code")),
        folds.where("folds > 1").select(F.col("unit_id").cast("string").alias("path"), F.lit("unit_in_several_folds").alias("code")),
        data.where(bad("rul_minutes") | bad("prediction_non_negative_minutes")).select(F.col("canonical_key").alias("path"), F.lit("not_finite").alias("code")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def strict_support(data: DataFrame, models: Sequence[str], key: str = "canonical_key") -> DataFrame:
    """Rows whose key every listed model predicted."""
    chosen = data.where(F.col("experiment").isin(*models))
    full = chosen.groupBy(key).agg(F.countDistinct("experiment").alias("_m")).where(F.col("_m") == len(models)).select(key)
    return chosen.join(full, key, "left_semi")


def pairwise_support(data: DataFrame, candidate: str, reference: str) -> DataFrame:
    """Rows of both models on the keys they share."""
    return strict_support(data, [candidate, reference])


def support_manifest(data: DataFrame, candidate: str, reference: str) -> DataFrame:
    """Native and matched row counts per unit and the share each side keeps."""
    pair = data.where(F.col("experiment").isin(candidate, reference))
    keyed = pair.groupBy("unit_id", "canonical_key").agg(
        F.count_if(F.col("experiment") == candidate).alias("_c"), F.count_if(F.col("experiment") == reference).alias("_r")
    )
    matched = F.count_if((F.col("_c") > 0) & (F.col("_r") > 0))
    out = keyed.groupBy("unit_id").agg(F.sum("_c").alias("candidate_native_count"), F.sum("_r").alias("reference_native_count"), matched.alias("matched_count"))
    share = lambda c: F.try_divide(F.col("matched_count").cast("double"), F.col(c).cast("double"))
    return out.withColumns({"candidate_retention": share("candidate_native_count"), "reference_retention": share("reference_native_count")})


def paired_differences(units: DataFrame, candidate: str, reference: str, tie: float = 1e-9, practical: float = 1.0) -> DataFrame:
    """Candidate minus reference per unit, with the exact and the practical outcome."""
    keys = ["fold", "condition_id", "unit_id"]
    side = lambda name, tag: units.where(F.col("experiment") == name).select(*keys, F.col("mae").alias(f"mae_{tag}"), F.col("rmse").alias(f"rmse_{tag}"))
    both = side(candidate, "candidate").join(side(reference, "reference"), keys)
    delta = F.col("mae_candidate") - F.col("mae_reference")
    return both.withColumns(
        {
            "delta_mae": delta,
            "delta_rmse": F.col("rmse_candidate") - F.col("rmse_reference"),
            "exact_status": F.when(delta < -tie, "win").when(delta > tie, "loss").otherwise("tie"),
            "practical_status": F.when(delta < -practical, "practical win").when(delta > practical, "practical loss").otherwise("within practical tolerance"),
        }
    )


def summarize_differences(table: DataFrame, by: Sequence[str], split: bool | None = None) -> DataFrame:
    d, status = F.col("delta_mae"), F.col("exact_status")
    out = percentiles(
        table, by, {"median_delta_mae": (d, 0.5), "_q25": (d, 0.25), "_q75": (d, 0.75)},
        {
            "mean_delta_mae": F.avg(d), "std_delta_mae": F.stddev_samp(d), "minimum_delta_mae": F.min(d), "maximum_delta_mae": F.max(d),
            "wins": F.count_if(status == "win"), "ties": F.count_if(status == "tie"), "losses": F.count_if(status == "loss"),
            "win_proportion": F.avg((status == "win").cast("double")), "mean_delta_rmse": F.avg("delta_rmse"),
        },
        split,
    )
    return out.withColumn("iqr_delta_mae", F.col("_q75") - F.col("_q25")).drop("_q25", "_q75")


#: Bootstrap replicates. Fixed value.
REPLICATES = 10_000


def resample_units(units: DataFrame, strata: Sequence[str], replicates: int, seed: int, key: str = "unit_id", split: bool | None = None) -> DataFrame:
    """Bootstrap draws: every replicate picks, per stratum, as many units as it has, with replacement.

    Slot j of replicate b takes the unit at position h mod n, h being the first 48 bits of the MD5 of `seed|b|stratum|j`: an
    equi-join on position, spread over all positions, with no random state to lose and the same in every engine.
    """
    distinct = units.select(*strata, key).distinct()
    placed = with_totals(index_units(distinct, strata, [key], split), strata, {"_n": F.count(F.lit(1))}, split)
    slots = placed.select(*strata, "_n", F.col("sequence_index").alias("_slot"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    digest = F.md5(F.concat_ws("|", F.lit(seed), "replicate", *strata, "_slot"))
    drawn = slots.withColumn("sequence_index", F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") % F.col("_n"))
    return drawn.join(placed.select(*strata, "sequence_index", key), [*strata, "sequence_index"]).select("replicate", *strata, key)


#: Rows (units times models) up to which a task holds the whole unit table and draws its replicates itself.
DRAWN_ROWS = 4_000_000
#: Tasks the replicates are dealt to.
DRAW_TASKS = 128


def _replicated(rows: DataFrame, strata: Sequence[str], replicates: int, seed: int, key: str, summarise: Callable[[pd.DataFrame], Callable[[np.ndarray], list[tuple]]], schema: str, split: bool | None) -> DataFrame:
    """The draws of `resample_units`, summed up per replicate without a row per draw.

    Replicates are dealt to tasks, each of which gets the (small) unit table, works out the slots' picks and so how often every row is drawn.
    `summarise` takes that table once and then the counts of every replicate.
    """
    distinct = rows.select(*strata, key).distinct()
    placed = with_totals(index_units(distinct, strata, [key], split), strata, {"_n": F.count(F.lit(1))}, split)
    table = rows.join(placed.withColumnsRenamed({"sequence_index": "_at"}), [*strata, key]).withColumn("_label", F.concat_ws("|", *strata))
    dealt = table.withColumn("_task", F.explode(F.sequence(F.lit(0), F.lit(DRAW_TASKS - 1)))).repartition(DRAW_TASKS, "_task")
    names = [c.split()[0] for c in schema.split(", ")]

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        measure, task, out = summarise(pdf), int(pdf["_task"].iloc[0]), []
        strata_rows = [(label, int(part["_n"].iloc[0]), part.index.to_numpy(), part["_at"].to_numpy()) for label, part in pdf.reset_index(drop=True).groupby("_label")]
        slots = [b"%d" % i for i in range(max(n for _, n, _, _ in strata_rows))]
        for replicate in range(task, replicates, DRAW_TASKS):
            times = np.zeros(len(pdf), dtype=np.int64)
            for label, n, spots, at in strata_rows:
                head = f"{seed}|{replicate}|{label}|".encode()
                digests = b"".join([hashlib.md5(head + slot, usedforsecurity=False).digest() for slot in slots[:n]])
                picks = (np.frombuffer(digests, dtype=">u8")[::2] >> 16).astype(np.int64) % n  # the first 48 of 128 bits
                times[spots] = np.bincount(picks, minlength=n)[at]
            if times.any():
                out += [(replicate, *r) for r in measure(times)]
        return pd.DataFrame(out, columns=names)

    return dealt.groupBy("_task").applyInPandas(draw, schema)


def _packs(rows: DataFrame, split: bool | None) -> bool:
    return not split and rows.count() <= DRAWN_ROWS


def _difference_summary(pdf: pd.DataFrame) -> Callable[[np.ndarray], list[tuple]]:
    known = pdf["_known"].to_numpy()
    d = pdf["delta_mae"].to_numpy(float)[known]
    order = np.argsort(d, kind="stable")  # NaN comes last, as in Spark
    ordered, below = d[order], (d < 0).astype(float)

    def measure(times: np.ndarray) -> list[tuple]:
        drawn = times[known]
        upto = np.cumsum(drawn[order])
        if not len(upto) or not upto[-1]:
            return [(None, None, None)]
        total, hit = int(upto[-1]), drawn > 0
        low, high = (ordered[np.searchsorted(upto, k, side="right")] for k in ((total - 1) // 2, total // 2))
        return [(float((low + high) / 2), float(drawn[hit] @ d[hit]) / total, float(drawn @ below) / total)]

    return measure


def _model_means(metrics: Sequence[str]):
    def summarise(pdf: pd.DataFrame) -> Callable[[np.ndarray], list[tuple]]:
        parts = [
            (None if pd.isna(name) else name, part.index.to_numpy(), [(part[f"_known_{m}"].to_numpy(), part[m].to_numpy(float)) for m in metrics])
            for name, part in pdf.reset_index(drop=True).groupby("experiment", dropna=False)
        ]

        def mean(drawn: np.ndarray, known: np.ndarray, values: np.ndarray) -> float | None:
            hit = known & (drawn > 0)
            n = int(drawn[hit].sum())
            return float(drawn[hit] @ values[hit]) / n if n else None

        def measure(times: np.ndarray) -> list[tuple]:
            drawn = [(name, times[spots], columns) for name, spots, columns in parts]
            return [(name, *[mean(t, *c) for c in columns]) for name, t, columns in drawn if t.any()]

        return measure

    return summarise


def _replicate_means(units: DataFrame, metrics: Sequence[str], replicates: int, seed: int, split: bool | None) -> DataFrame:
    """Mean of every metric per replicate and model."""
    rows = units.select("condition_id", "unit_id", "experiment", *[F.col(m).cast("double").alias(m) for m in metrics])
    if not _packs(units, split):
        draws = resample_units(units, ["condition_id"], replicates, seed, split=split)
        return draws.join(rows, ["condition_id", "unit_id"]).groupBy("replicate", "experiment").agg(*[F.avg(m).alias(m) for m in metrics])
    known = rows.select("*", *[F.col(m).isNotNull().alias(f"_known_{m}") for m in metrics])
    schema = f"replicate int, experiment {units.schema['experiment'].dataType.simpleString()}, " + ", ".join(f"{m} double" for m in metrics)
    return _replicated(known, ["condition_id"], replicates, seed, "unit_id", _model_means(metrics), schema, split)


def bootstrap_difference(table: DataFrame, replicates: int = REPLICATES, seed: int = 42, confidence: float = 0.95, strata: Sequence[str] = ("condition_id",), split: bool | None = None) -> DataFrame:
    """Percentile intervals of the mean, median and win rate of the paired differences."""
    base = table if strata else table.withColumn("_one", F.lit(0))
    strata = list(strata) or ["_one"]
    d = F.col("delta_mae")
    if _packs(base, split):
        known = base.select(*strata, "unit_id", d.cast("double").alias("delta_mae"), d.isNotNull().alias("_known"))
        stats = _replicated(known, strata, replicates, seed, "unit_id", _difference_summary, "replicate int, median double, mean double, win double", split)
    else:
        draws = resample_units(base, strata, replicates, seed, split=split).join(base.select(*strata, "unit_id", "delta_mae"), [*strata, "unit_id"])
        stats = percentiles(draws, ["replicate"], {"median": (d, 0.5)}, {"mean": F.avg(d), "win": F.avg((d < 0).cast("double"))}, split)
    low, high = (1 - confidence) / 2, (1 + confidence) / 2
    wanted = {f"{s}_ci_{side}": (F.col(s), p) for s in ("mean", "median", "win") for side, p in (("lower", low), ("upper", high))}
    return percentiles(cut(stats), [], wanted, {"effective_replicates": F.count("mean"), "failed_replicates": F.count_if(F.col("mean").isNull())}, split)


def bootstrap_ranks(units: DataFrame, replicates: int = REPLICATES, seed: int = 42, split: bool | None = None) -> DataFrame:
    """Share of replicates in which each model has the smallest mean error; ties go to the first name."""
    scores = _replicate_means(units, ["mae"], replicates, seed, split).select("replicate", "experiment", F.round("mae", 9).alias("score"))
    best = scores.groupBy("replicate").agg(F.min_by("experiment", F.struct("score", "experiment")).alias("experiment"))
    firsts = best.groupBy("experiment").agg((F.count(F.lit(1)) / replicates).alias("_p"))
    return units.select("experiment").distinct().join(firsts, "experiment", "left").select("experiment", F.coalesce("_p", F.lit(0.0)).alias("bootstrap_rank_first_probability"))


def bootstrap_metrics(units: DataFrame, metrics: Sequence[str], replicates: int = REPLICATES, seed: int = 42, confidence: float = 0.95, split: bool | None = None) -> DataFrame:
    """Percentile intervals of each model's mean errors; a failed replicate is NULL and counted."""
    means = cut(_replicate_means(units, metrics, replicates, seed, split))
    low, high = (1 - confidence) / 2, (1 + confidence) / 2
    wanted = {f"{m}_ci_{side}": (F.col(m), p) for m in metrics for side, p in (("lower", low), ("upper", high))}
    failed = {f"{m}_failed_replicates": F.count_if(F.col(m).isNull()) for m in metrics}
    return percentiles(means, ["experiment"], wanted, failed, split)


@lru_cache(maxsize=64)
def _rank_sum_counts(n: int) -> np.ndarray:
    """How many of the 2**n sign patterns give each rank sum; the cumulative share is the exact null."""
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1.0
    for rank in range(1, n + 1):
        counts[rank:] = counts[rank:] + counts[: len(counts) - rank]
    return counts.cumsum() / 2.0**n


#: Up to this many untied non-zero differences the exact null distribution is used. Fixed value.
EXACT_ROWS = 50


@F.pandas_udf(T.DoubleType())
def signed_rank_p(n: pd.Series, statistic: pd.Series, ties: pd.Series, exact: pd.Series) -> pd.Series:
    """Two-sided p of the smaller rank sum: exact table, else normal with tie correction."""
    out = []
    for size, w, t, use_table in zip(n, statistic, ties, exact):
        if size == 0:
            out.append(1.0)
        elif use_table:
            out.append(min(1.0, 2.0 * float(_rank_sum_counts(int(size))[int(w)])))
        else:
            mean, var = size * (size + 1) / 4.0, size * (size + 1) * (2 * size + 1) / 24.0 - t / 48.0
            out.append(math.erfc(abs(w - mean) / math.sqrt(var) / math.sqrt(2.0)) if var > 0 else 1.0)
    return pd.Series(out)


def wilcoxon(table: DataFrame, by: Sequence[str], tie: float = 1e-9, value: str = "delta_mae", split: bool | None = None) -> DataFrame:
    """Signed-rank test per group: statistic, p, rank-biserial effect, zero count. Zeros are not ranked."""
    by = list(by)
    counted = table.groupBy(*by).agg(F.count(F.lit(1)).alias("paired_units"), F.count_if(F.abs(value) <= tie).alias("zero_differences"))
    moved = table.where(F.abs(value) > tie).select(*by, F.col(value).alias("_d"), F.round(F.abs(value), 9).alias("_a"))
    ranked = average_ranks(moved, by, "_a", "_rank", split)
    sums = ranked.groupBy(*by).agg(
        F.sum(F.when(F.col("_d") > 0, F.col("_rank")).otherwise(0.0)).alias("_pos"),
        F.sum(F.when(F.col("_d") < 0, F.col("_rank")).otherwise(0.0)).alias("_neg"),
        F.count(F.lit(1)).alias("_n"),
    )
    cubes = moved.groupBy(*by, "_a").agg(F.count(F.lit(1)).alias("_t")).groupBy(*by).agg(F.sum((F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")).cast("double")).alias("_ties"))
    joined = counted.join(sums, by, "left").join(cubes, by, "left").fillna(0)
    smaller = F.least("_pos", "_neg")
    exact = (F.col("_n") <= EXACT_ROWS) & (F.col("_ties") == 0) & (F.col("zero_differences") == 0)
    return joined.select(
        *by, "paired_units", "zero_differences", smaller.alias("wilcoxon_statistic"),
        signed_rank_p(F.col("_n"), smaller, F.col("_ties"), exact).alias("wilcoxon_p_raw"),
        F.coalesce(F.try_divide(F.col("_pos") - F.col("_neg"), F.col("_pos") + F.col("_neg")), F.lit(0.0)).alias("rank_biserial_effect"),
    )


def sign_test(table: DataFrame, by: Sequence[str], tie: float = 1e-9, value: str = "delta_mae", split: bool | None = None) -> DataFrame:
    """Exact two-sided binomial test of the signs, from log binomial terms added up row by row."""
    by = list(by)
    counted = table.groupBy(*by).agg(F.count_if(F.col(value) < -tie).alias("negative"), F.count_if(F.col(value) > tie).alias("positive"))
    n = F.col("negative") + F.col("positive")
    terms = counted.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least("negative", "positive"))))
    step = F.when(F.col("_k") > 0, F.ln(F.try_divide((n - F.col("_k") + 1).cast("double"), F.col("_k").cast("double")))).otherwise(0.0)
    logs = running(terms, by, ["_k"], {"_choose": ("sum", step)}, split)
    tail = logs.groupBy(*by, "negative", "positive").agg(F.sum(F.exp(F.col("_choose") - n * F.ln(F.lit(2.0)))).alias("_tail"))
    p = F.when(F.col("negative") == F.col("positive"), 1.0).otherwise(F.least(F.lit(1.0), 2 * F.col("_tail")))
    return tail.select(*by, "negative", "positive", p.alias("sign_test_p_raw"))


def holm(table: DataFrame, family: Sequence[str], p: str, key: str, alpha: float = 0.05, split: bool | None = None) -> DataFrame:
    """Step-down adjusted p values inside each family, capped at 1."""
    sized = with_totals(index_units(table, family, [p, key], split), family, {"family_hypothesis_count": F.count(F.lit(1))}, split)
    factor = F.col("family_hypothesis_count") - F.col("sequence_index")
    raised = running(sized, family, [p, key], {"holm_p_adjusted": ("max", F.least(F.lit(1.0), factor * F.col(p)))}, split)
    return raised.withColumn("holm_reject", F.col("holm_p_adjusted") < alpha).drop("sequence_index")


def enrich_units(units: DataFrame, differences: Mapping[str, DataFrame], manifest: DataFrame) -> DataFrame:
    """Unit metrics with the difference to each reference and the matched row counts."""
    out = units
    for name, table in differences.items():
        out = out.join(table.select("fold", "unit_id", F.col("delta_mae").alias(f"delta_mae_vs_{name}")), ["fold", "unit_id"], "left")
    return out.join(manifest.select("unit_id", "matched_count"), "unit_id", "left")


def rank_evidence(scores: DataFrame, by: Sequence[str], score: str = "score", split: bool | None = None) -> DataFrame:
    """Add `normalized_rank`: 1 for the best score of its group, 0 for the worst, ties averaged."""
    negated = scores.withColumn("_s", -F.col(score))
    ranked = with_totals(average_ranks(negated, by, "_s", "_rank", split), by, {"_n": F.count(F.lit(1))}, split)
    return ranked.withColumn("normalized_rank", 1 - F.try_divide(F.col("_rank") - 1, F.col("_n") - 1)).drop("_s", "_rank", "_n")


def consensus(evidence: DataFrame, split: bool | None = None) -> DataFrame:
    """Mean and median normalised rank, distinct sources and selections per feature."""
    r = F.col("normalized_rank")
    return percentiles(
        evidence, ["feature"], {"median_normalized_rank": (r, 0.5)},
        {"mean_normalized_rank": F.avg(r), "evidence_sources": F.countDistinct("source"), "selected_occurrences": F.count_if(F.col("selected"))}, split,
    )


def source_agreement(evidence: DataFrame, tops: Sequence[int] = (5, 10), split: bool | None = None) -> DataFrame:
    """Rank agreement of every pair of sources on their common features and overlap of their top lists."""
    mean = evidence.groupBy("source", "feature").agg(F.round(F.avg("normalized_rank"), 12).alias("rank"))
    names = mean.select("source").distinct()
    a = mean.select(F.col("source").alias("source_a"), "feature", F.col("rank").alias("_ra"))
    b = mean.select(F.col("source").alias("source_b"), "feature", F.col("rank").alias("_rb"))
    pairs = ["source_a", "source_b"]
    common = a.join(b, "feature").where("source_a < source_b")
    ranked = average_ranks(average_ranks(common, pairs, "_ra", "_ia", split), pairs, "_rb", "_ib", split)
    rho = ranked.groupBy(*pairs).agg(F.count(F.lit(1)).alias("common_features"), correlation("_ia", "_ib").alias("_rho"))
    place = index_units(mean.withColumn("_neg", -F.col("rank")), ["source"], ["_neg", "feature"], split)
    lists = place.select("source", "feature", F.explode(F.array(*[F.lit(k) for k in tops])).alias("top_k"), "sequence_index").where("sequence_index < top_k")
    sizes = lists.groupBy("source", "top_k").agg(F.count(F.lit(1)).alias("n"))
    every = names.select(F.col("source").alias("source_a")).join(names.select(F.col("source").alias("source_b")), F.col("source_a") < F.col("source_b"))
    shared = (
        lists.select(F.col("source").alias("source_a"), "top_k", "feature")
        .join(lists.select(F.col("source").alias("source_b"), "top_k", "feature"), ["top_k", "feature"])
        .where("source_a < source_b").groupBy(*pairs, "top_k").agg(F.count(F.lit(1)).alias("intersection"))
    )
    out = (
        every.join(sizes.select(F.col("source").alias("source_a"), "top_k", F.col("n").alias("_na")), "source_a")
        .join(sizes.select(F.col("source").alias("source_b"), "top_k", F.col("n").alias("_nb")), ["source_b", "top_k"])
        .join(shared, [*pairs, "top_k"], "left").join(rho, pairs, "left").fillna(0, ["intersection", "common_features"])
    )
    return out.select(
        *pairs, "top_k", "common_features", F.when(F.col("common_features") >= 3, F.col("_rho")).alias("spearman_rank_agreement"), "intersection",
        (F.col("intersection") / (F.col("_na") + F.col("_nb") - F.col("intersection"))).alias("jaccard"),
    )


def consolidate_costs(classical: DataFrame, temporal: DataFrame) -> DataFrame:
    """Costs per experiment of both model families in one table; a missing measure carries its reason."""
    total = lambda df, extra: df.groupBy("experiment").agg(
        F.sum("training_seconds").alias("training_seconds"), F.sum("inference_seconds").alias("inference_seconds"), F.avg(extra).alias(extra)
    )
    a = total(classical, "input_feature_count").withColumn("missing_reason", F.lit("trainable parameters not applicable"))
    b = total(temporal, "trainable_parameters").withColumn("missing_reason", F.lit("input feature count not recorded"))
    return a.unionByName(b, allowMissingColumns=True)


def pareto_front(table: DataFrame, x: str, y: str, split: bool | None = None) -> DataFrame:
    """Flag rows no other row beats on both axes: best y per x, then the best y of all smaller x."""
    one = table.withColumn("_all", F.lit(0))
    lowest = one.groupBy("_all", x).agg(F.min(y).alias("_own"))
    earlier = running(lowest, ["_all"], [x], {"_before": ("min", F.col("_own"))}, split, exclusive=True)
    dominated = (F.col("_own") < F.col(y)) | F.coalesce(F.col("_before") <= F.col(y), F.lit(False))
    return one.join(earlier, ["_all", x]).select(*table.columns, (~dominated).alias("pareto"))


