"""Times the headline queries and prints one line of JSON. BENCH_SF_DIR, BENCH_CPUS."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkseek import queries as core
from sparkseek.operators.keyword import KeywordIndex
from sparkseek.operators.store import DocumentStore
from sparkseek.operators.vector import knn_many
from sparkseek.plans.schema import DOCUMENT
from sparkseek.sources.generated import synthetic
from sparkseek.streaming.ingest import ingest

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["bm25_topk", "bm25_multi_term", "bm25_filtered", "search_many", "agg_count", "agg_value_counts", "agg_time_histogram", "agg_numeric_histogram", "agg_geo_grid", "agg_percentiles_exact", "agg_percentiles_approx", "agg_percentiles_tdigest", "knn_exact", "knn_quantized", "knn_multi_query", "hybrid_rrf", "upsert_latest_arrival", "dedup_freshest", "shard_assignment", "federated_topk", "windowed_stream_counts"]


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:] or HEADLINE
    found = core.queries()
    queries = {}
    for name in only:
        queries[name] = round(timed(lambda: found[name](spark, SF_DIR).collect()), 3)
    more = {}
    if not sys.argv[1:]:
        index = KeywordIndex.build(core.read(spark, SF_DIR, "documents"), "doc_id", F.col("text")).keep()
        for t in ("postings", "scopes", "terms"):
            getattr(index, t).count()
        more["search_warm"] = round(min(timed(lambda: index.search("tion", 10).collect()) for _ in range(3)), 3)
        words = [r.term for r in index.terms.orderBy(F.desc("df"), "term").limit(200).collect()]
        many = list(enumerate(words))
        more["search_many_200"] = round(min(timed(lambda: index.search_many(many, 10).collect()) for _ in range(2)), 3)
        vectors = core.read(spark, SF_DIR, "embeddings").persist()
        asked = vectors.where("vec_id < 200").select("vec_id", "embedding")
        more["knn_many_200"] = round(timed(lambda: knn_many(vectors, asked, 10, "vec_id", "embedding").collect()), 3)
        exact, quick = core.knn_exact(spark, SF_DIR).collect(), core.knn_quantized(spark, SF_DIR).collect()
        with tempfile.TemporaryDirectory() as folder:
            synthetic(spark, 20_000).write.parquet(f"{folder}/feed")
            store = DocumentStore(spark, f"{folder}/store", DOCUMENT)
            feed = spark.readStream.schema(DOCUMENT).parquet(f"{folder}/feed")
            more["stream_ingest_20000"] = round(timed(lambda: ingest(feed, store, f"{folder}/checkpoint").awaitTermination()), 3)
        queries |= more
        extra = {"ingest_rows_per_s": round(20_000 / more["stream_ingest_20000"]), "search_queries_per_s": round(200 / more["search_many_200"], 1), "quantized_recall_at_10": float(np.mean([r.vec_id in {x.vec_id for x in quick} for r in exact]))}
    else:
        extra = {}
    print(json.dumps({"metric": "headline_total", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "sf": os.path.basename(SF_DIR.rstrip("/")), **extra}))


if __name__ == "__main__":
    main()
