"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from postlake.plans.registry import load_all  # noqa: E402
from postlake.session import local_session  # noqa: E402

HEADLINES = (
    "enrich_posts", "score_valence", "score_polarity", "memo_score_distinct", "fn_clean_text", "explode_metadata",
    "search_text", "match_combined", "join_posts_sentiment", "agg_sentiment_stats", "agg_shard_summary",
    "rollup_shard_totals", "topk_per_shard", "upsert_keep_last", "lookup_two_tier", "agg_counters_by_dim",
    "agg_latency_histogram", "win_rolling_mean", "win_failure_streak", "win_clamped_gauge", "replay_token_bucket",
    "sink_sharded_roundtrip", "sink_csv_roundtrip", "sink_json_array_roundtrip", "sink_jsonl_roundtrip",
    "job_pack_roundtrip", "stream_score", "stream_token_bucket", "stream_window_usage", "stream_upsert",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    # Only the JSON line may reach stdout.
    out, sys.stdout = sys.stdout, sys.stderr
    spark = local_session("postlake-bench", cpus, int(cpus) if cpus.isdigit() else 8)
    queries = load_all()
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    line = {
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line), file=out)


if __name__ == "__main__":
    main()
