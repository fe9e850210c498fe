"""Benchmark the headline jobs.

Runs each query of ``HEADLINE`` on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints one JSON line.
Every query is executed in full through the ``noop`` sink (no collect), twice;
the faster run is reported.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from feedspark.plans.queries import queries  # noqa: E402
from feedspark.session import build_session  # noqa: E402

HEADLINE = [
    "collect_batch",        # watermark collection: parse, clean, append, sort
    "late_entries",         # entries behind the watermark, per blog
    "render_posts",         # next article per community, rendered
    "mark_posted",          # queue state after posting
    "page_content",         # page extraction, one projection
    "to_bill_articles",     # bill enrichment: three joins against page facts
    "split_sentences",      # sentence split over all documents
    "article_summary",      # chunk, summarize, cap, clean
    "rank_sentences",       # TF-IDF sentence ranking
    "summary_and_points",   # summary + main points
    "summarize_queue",      # pick, extract, summarize per community
    "collect_stream",       # file stream, availableNow
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(cpus=cpus, app="feedspark-bench")
    qs = queries()
    times = {}
    for name in HEADLINE:
        best = None
        for _ in range(runs):
            t0 = time.perf_counter()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
