"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rftspark.runtime import build_session  # noqa: E402
from workload import catalog  # noqa: E402

HEADLINE = (
    "grade_responses", "grade_in_place", "grade_forms", "flagship", "uniform_quota", "proportional_quota",
    "vanilla_trials", "stop_replay", "stop_replay_unlimited", "strategy_retry", "strategy_cover", "pass_rates",
    "describe_corrects", "level_lookup", "extract_from_documents", "tokenize_documents", "render_prompts",
    "supervised_rows", "pack_exact", "pack_rows", "split_sink", "sample_share", "stream_stop",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(max(8, int(cpus) if cpus.isdigit() else 8)),
            "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf}/region.parquet").count()
    took = {}
    for name in names:
        start = time.time()
        catalog()[name][0](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    responses = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    rates = {n: round(responses / took[n]) for n in ("grade_responses", "flagship") if n in took}
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
                "queries": took, "sf": sf, "responses": responses, "rows_per_sec": rates,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
