"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from wearline.plans import QUERIES
from wearline.session import build_session

HEADLINE = [
    "a13_describe", "b4_number_gaps", "b8_chronological_index", "b11_manifest_invariants", "b12_duplicate_content", "c2_build_manifest",
    "d_time_features", "e10_feature_rows", "f1_trajectory_scores", "f5_resample", "g8_robust_parameters", "h2_trailing_smooth", "h5_onset_rule",
    "h7_sensitivity", "i4_ridge_time_only", "j2_unit_metrics", "j7_model_comparison", "k1_trailing_sequences", "l10_wilcoxon", "m10_detections",
    "m12_detector_grid", "m17_trend_features", "n1_landmarks", "p1_kaplan_meier", "q2_brier_score", "q3_concordance",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("wearline-bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    wanted = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    QUERIES["c3_unit_summary"](spark, folder).write.format("noop").mode("overwrite").save()  # JVM warm-up
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
