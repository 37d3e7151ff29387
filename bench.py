"""Seconds for each headline query. Prints one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the cores. Every query is run twice; the second run counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from websift.plans import catalog  # noqa: E402
from websift.session import get_spark  # noqa: E402

HEADLINE = [
    "page_text", "page_title", "page_links", "clean_text", "tokenize", "parse_queries", "normalize_url",
    "match_phrase", "bm25_scores", "bm25_phrase", "website_rank", "search_basic", "search_rerank",
    "search_filtered", "search_summary", "search_full", "index_postings", "index_term_stats",
    "index_apply_changes", "match_terms_indexed", "match_phrase_indexed", "search_batch",
    "search_batch_summary", "save_pages", "duplicate_url_check", "robots_allowed", "frontier_new",
    "crawl_progress", "stream_ingest_pages",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    conf = {"spark__sql__shuffle__partitions": cpus, "spark__ui__enabled": "false",
            "spark__ui__showConsoleProgress": "false", "spark__driver__memory": "12g"}
    with tempfile.TemporaryDirectory(prefix="websift-bench-") as tmp:
        spark = get_spark("bench", f"local[{cpus}]", **conf, spark__checkpoint__dir=tmp)
        spark.sparkContext.setLogLevel("ERROR")
        seconds = {}
        for name in names:
            for _ in range(2):
                start = time.time()
                catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                seconds[name] = round(time.time() - start, 3)
        spark.stop()
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
