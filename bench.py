"""Headline queries, each run twice and timed the second time; prints one JSON line."""

import json
import os
import sys
import time

from streamscope.registry import QUERIES
from streamscope.session import local_session

HEADLINE = """a1_piece_completeness j2_window_coverage w1_pcr_segments w5_contiguous_frontier
a12_stream_stability a2_covered_bytes a10_swarm_health a14_scenario_rollup a15_memory_trend
h7_viewer_sessions j1_correlate_replies j7_resolve_catalog j8_verify_pieces j13_cached_prefix
j15_servable_blocks u4_missing_pieces w2_hls_segments w6_byte_budget_retention w10_have_ranges
w11_startup_release w12_stall_intervals""".split()


def run(spark, name: str, folder: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    times = {}
    for name in names:
        run(spark, name, folder)
        times[name] = run(spark, name, folder)
    print(
        json.dumps(
            {
                "metric": "headline queries, warm second run",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
