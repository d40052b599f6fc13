"""Nearest neighbours by cosine: exact, and in two tiers over sign bits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkseek.functions.vectors import correction, dot, hamming, normalized, sign_bits, topk_dot
from sparkseek.operators.keyword import top
from sparkseek.shipping import ship

#: The first tier keeps this many candidates for each result.
OVERSAMPLE = 4
DEFAULT_K = 10


def _literal(query: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in query))


def check_dimensions(vectors: DataFrame, vector: str, query: Sequence[float]) -> None:
    """ValueError if the query has another length than the stored vectors."""
    row = vectors.select(F.size(vector).alias("n")).first()
    if row is not None and row.n != len(query):
        raise ValueError(f"query vector has {len(query)} dimensions, the index has {row.n}")


def knn(vectors: DataFrame, query: Sequence[float], k: int = DEFAULT_K, key: str = "doc_key", vector: str = "vector") -> DataFrame:
    """The k best rows by inner product, then key: each batch is one matrix product and keeps its best."""
    if k <= 0:
        return vectors.select(F.col(key), F.lit(0.0).alias("score")).limit(0)
    check_dimensions(vectors, vector, query)
    ship(vectors.sparkSession)
    rows = vectors.select(key, F.col(vector).cast("array<double>").alias(vector))
    kind = dict(rows.dtypes)[key]
    best = rows.mapInArrow(topk_dot(np.asarray(query, np.float64), k, key, vector), f"`{key}` {kind}, score double")
    return top(best, k, key)


def knn_expression(vectors: DataFrame, query: Sequence[float], k: int = DEFAULT_K, key: str = "doc_key", vector: str = "vector") -> DataFrame:
    """The same without Python workers, for few dimensions."""
    if k <= 0:
        return vectors.select(F.col(key), F.lit(0.0).alias("score")).limit(0)
    check_dimensions(vectors, vector, query)
    return top(vectors.select(F.col(key), dot(F.col(vector), _literal(query)).alias("score")), k, key)


def knn_many(vectors: DataFrame, queries: DataFrame, k: int = DEFAULT_K, key: str = "doc_key", vector: str = "vector", block: int = 1024) -> DataFrame:
    """queries: (query_id, query vector), in blocks of at most ``block`` rows that are sent to all tasks. query_id, key, score, rank.

    Every batch of vectors gives its k best for each query, so what is shuffled does not depend on the batch's size.
    """
    import pyarrow as pa

    asked = [(r[0], r[1]) for r in queries.toLocalIterator()]
    kind = dict(vectors.dtypes)[key]
    spark, out = vectors.sparkSession, None
    ship(spark)
    rows = vectors.select(key, F.col(vector).cast("array<double>").alias(vector))
    for start in range(0, len(asked), block):
        part = asked[start : start + block]
        ids, matrix = [p[0] for p in part], spark.sparkContext.broadcast(np.array([p[1] for p in part], np.float64))

        def run(batches, ids=ids, matrix=matrix):
            for b in batches:
                if not b.num_rows:
                    continue
                own = np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1) @ matrix.value.T
                n = min(k, b.num_rows)
                # a batch's best, and all that tie with the last of them
                least = np.partition(own, b.num_rows - n, axis=0)[b.num_rows - n] - 1e-9
                row, query = np.nonzero(own >= least)
                yield pa.RecordBatch.from_arrays([pa.array([ids[q] for q in query], pa.int64()), b.column(0).take(pa.array(row)), pa.array(own[row, query])], names=["query_id", key, "score"])

        found = rows.mapInArrow(run, f"query_id long, `{key}` {kind}, score double")
        out = found if out is None else out.unionByName(found)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return out.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def quantize(vectors: DataFrame, dimensions: int, key: str = "doc_key", vector: str = "vector") -> DataFrame:
    """key, vector, bits, correction: what the two-tier search reads."""
    return vectors.select(key, vector, sign_bits(F.col(vector), dimensions).alias("bits"), correction(F.col(vector)).alias("correction"))


def knn_quantized(quantized: DataFrame, query: Sequence[float], k: int = DEFAULT_K, key: str = "doc_key", vector: str = "vector", oversample: int = OVERSAMPLE) -> DataFrame:
    """The oversample * k nearest by differing sign bits (ties by key), of which the k best by inner product."""
    if k <= 0:
        return quantized.select(F.col(key), F.lit(0.0).alias("score")).limit(0)
    check_dimensions(quantized, vector, query)
    words = [0] * -(-len(query) // 64)
    for i, x in enumerate(query):
        if x > 0:
            words[i // 64] |= 1 << (i % 64)
    bits = F.array(*(F.lit(w - (1 << 64) if w >> 63 else w).cast("long") for w in words))
    near = quantized.select(key, vector, hamming(F.col("bits"), bits).alias("distance")).orderBy("distance", key).limit(oversample * k)
    return top(near.select(F.col(key), dot(F.col(vector), _literal(query)).alias("score")), k, key)


def similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either is zero."""
    return dot(normalized(a), normalized(b))
