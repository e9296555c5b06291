"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data
and cores; BENCH_RUNS the timed runs after one warm-up (the median counts);
BENCH_ONLY a comma-separated list of queries, ``all`` for every one.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tidemark.plans import registry
from tidemark.session import build_session

HEADLINE = (
    "line_table", "prose_rule_findings", "secret_findings", "security_findings", "redacted_texts", "fingerprints", "finding_delta",
    "check_scores", "duplicate_blocks", "token_clones", "similar_names", "broken_links", "page_findings", "import_edges",
    "cycles_static", "last_thirty_scans", "regressions", "path_policy", "eslint_findings", "stream_score_changes",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = os.environ.get("BENCH_ONLY", "")
    spark = build_session(
        "tidemark-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.log.level": "ERROR"},
    )
    queries, _ = registry.load()
    names = list(queries) if only == "all" else [n for n in only.split(",") if n] or list(HEADLINE)
    timings: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(taken[1:] or taken), 3)
    result = {
        "metric": "headline query time", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "runs": runs, "spark": spark.version,
        "documents": spark.read.parquet(f"{sf_dir}/documents.parquet").count(), "events": spark.read.parquet(f"{sf_dir}/events.parquet").count(),
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
