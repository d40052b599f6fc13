"""Ranking quality: normalised discounted cumulative gain."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ndcg(ranking: Sequence[str], relevance: dict[str, float], k: int = 10) -> float:
    gain = lambda values: sum(v / math.log2(i + 2) for i, v in enumerate(values[:k]))
    ideal = gain(sorted(relevance.values(), reverse=True))
    return gain([relevance.get(d, 0.0) for d in ranking]) / ideal if ideal else 0.0


def ndcg_table(ranked: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """ranked: query_id, doc, rank; judged: query_id, doc, relevance. One row for each query: query_id, ndcg."""
    discount = 1 / F.log2(F.col("rank") + 1)
    got = ranked.where(F.col("rank") <= k).join(judged, ["query_id", "doc"], "left").groupBy("query_id").agg(F.sum(F.coalesce("relevance", F.lit(0.0)) * discount).alias("dcg"))
    best = Window.partitionBy("query_id").orderBy(F.desc("relevance"))
    ideal = judged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(F.col("relevance") * discount).alias("idcg"))
    return got.join(ideal, "query_id").select("query_id", F.round(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0), 6).alias("ndcg"))
