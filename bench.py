"""Benchmark: seconds per headline query, one JSON line.

``BENCH_SF_DIR`` names the data (default sf0.1), ``BENCH_CPUS`` the threads.
All queries are run once to warm up, then each is timed, with its whole
result computed and discarded by the tasks.
"""

from __future__ import annotations

import json
import os
import time

from workload.queries import QUERIES
from workload.session import local_session

HEADLINE = [
    "quality_by_subject",
    "score_join",
    "extract_mcq",
    "score_mixed",
    "score_retrieval",
    "score_set",
    "score_rules",
    "rules_length",
    "rules_format",
    "rule_pass_rates",
    "score_multi_turn",
    "score_calls",
    "score_actions",
    "assemble_programs",
    "dialogue_stop",
    "score_test_verdicts",
    "request_bodies",
    "request_summary",
    "latency_percentiles",
    "pass_at_k",
    "result_rows",
    "compare_runs",
    "stream_ttft",
    "score_runs",
    "suite_graphwalks",
    "suite_mrcr",
    "suite_ifeval",
    "suite_bfcl",
    "suite_humaneval",
    "suite_tau_bench",
    "suite_terminal_bench",
    "suite_swe_bench",
]


def run(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(cpus)
    for name in names:
        run(QUERIES[name], spark, sf_dir)
    seconds = {name: round(run(QUERIES[name], spark, sf_dir), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
