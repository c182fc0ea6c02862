"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wiregrid.plans.catalog import queries  # noqa: E402
from wiregrid.session import build_session  # noqa: E402

HEADLINE = [
    "articles_normalized",
    "pages_clean_text",
    "raw_ingest",
    "stream_ingest",
    "articles_first_wins",
    "article_scores",
    "clusters",
    "cluster_summaries",
    "top_stories",
    "digest_sections",
    "digest_text",
    "part_clusters",
    "turn_clusters",
    "trailing_window_counts",
    "constraint_report",
    "send_decisions",
    "run_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "wiregrid-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, wanted = queries(), sys.argv[1:] or HEADLINE
    known["run_steps"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline query seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
