"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from reviewloom import catalog
from reviewloom.session import local_session

HEADLINE = ["keywords_top_2500", "tfidf_category_scores", "side_share_report", "embedding_category_scores",
            "dbscan_on_pca", "exact_duplicates", "near_duplicate_pairs", "text_features", "top_seed_themes",
            "collocations", "phrase_factor_scores", "eps_join_pairs", "knn_join_edges"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    seconds = {}
    for name in names:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 2)
        print(name, seconds[name], file=sys.stderr, flush=True)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 2), "unit": "sec",
                      "queries": seconds, "sf": float(sf.group(1)) if sf else None}))


if __name__ == "__main__":
    main()
