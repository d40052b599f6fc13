"""Fusion of two rankings by reciprocal rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def ranked(hits: DataFrame, key: str = "doc_key") -> DataFrame:
    """key, rank (from 1): by falling score, then key. hits are few: a list that is already cut to its best."""
    order = Window.orderBy(F.desc("score"), key)
    return hits.select(key, F.row_number().over(order).alias("rank"))


def fuse(keyword: DataFrame, vector: DataFrame, limit: int = 10, key: str = "doc_key") -> DataFrame:
    """key, score, index (which list it came from), best first. An empty key takes a rank but is no result."""
    a, b = ranked(keyword, key).withColumnRenamed("rank", "keyword_rank"), ranked(vector, key).withColumnRenamed("rank", "vector_rank")
    both = a.join(b, key, "full_outer").where(F.col(key) != "") if dict(keyword.dtypes)[key] == "string" else a.join(b, key, "full_outer")
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    index = F.when(F.col("vector_rank").isNull(), "keyword").when(F.col("keyword_rank").isNull(), "vector").otherwise("both")
    out = both.select(key, F.round(part("keyword_rank") + part("vector_rank"), 9).alias("score"), index.alias("index"))
    out = out.orderBy(F.desc("score"), key)
    return out.limit(limit) if limit else out
