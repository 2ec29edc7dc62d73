"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the folder of parquet tables, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from guardlake.plans.inputs import Tables  # noqa: E402
from guardlake.plans.registry import load_all  # noqa: E402
from guardlake.session import build_session  # noqa: E402

HEADLINE = (
    "v5_status_by_category", "d1_pattern_hits", "d3_pattern_summary", "n0_fixed_point",
    "n7_leetspeak", "m2_keyword_verdict", "r1_redacted_text", "r7_corpus_report",
    "x5_context", "v3_verdict_without_decoding", "v8_full_verdict_words",
    "v8_full_verdict_texts", "g4_batch_summary", "c3_detect", "l1_fixed_window",
    "l2_three_tiers", "l3_violation_windows", "a1_dashboard_summary",
    "a2_top_threat_categories", "a9_request_histogram", "a10_key_attribution",
    "f6_tuned_thresholds", "k2_first_rules", "p8_paragraph_chunks", "w1_streaming_redaction",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    registry, tables = load_all(), Tables(spark, folder)
    tables.read("documents").write.format("noop").mode("overwrite").save()  # start-up
    took = {}
    for name in names:
        start = time.time()
        registry[name].build(tables).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3),
                      "unit": "sec", "queries": took,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
