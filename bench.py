"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8).
Every query runs once to warm up and twice timed; the better time counts. The
whole result is produced (a sink that discards rows), nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rankloom.catalogue.registry import load_all  # noqa: E402
from rankloom.session import build_session  # noqa: E402

HEADLINE = [
    "rank_predictor", "rank_predictor_topk", "filter_explorer", "group_stats",
    "group_stats_wide", "colleges_for_exam", "coverage", "distribution", "histogram",
    "yoy_trend", "latest_year", "round_ends", "keep_first", "distinct_union", "deliverable",
    "fetch_outcomes", "segment", "catalog_build", "web_fold", "page_buckets",
    "document_text", "enrich", "wide_melt",
    "html_to_canonical", "harvest", "site_rows", "headed_matrix",
]


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__ui__enabled="false", spark__driver__memory="16g",
                          spark__ui__showConsoleProgress="false",
                          # the benchmark tables are single row groups
                          rankloom__read__partitions=cpus)
    spark.sparkContext.setLogLevel("OFF")
    entries = load_all()
    names = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(3):
            start = time.time()
            entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - start)
        seconds[name] = round(min(times[1:]), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
