"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores. Results go
to a noop sink, so that only Spark's work is timed. ``BENCH_QUERIES`` picks other queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import all_queries  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = (
    "clean_text", "keyword_hits", "daily_return", "weekly_ohlcv", "weekly_returns", "forward_label",
    "weekly_text_stats", "lexicon_sentiment", "weekly_text_pieces", "weekly_panel", "match_posts",
    "collect_archive", "term_counts", "tfidf", "median_impute", "roc_auc_many_scores",
    "metrics_by_asset", "naive_cv_metrics", "coverage", "weekly_volume",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = local_session(cores=cpus)
    queries = all_queries()
    # Start the JVM's compilers on the smallest query before the clock runs.
    queries["weekly_volume"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in chosen:
        started = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
