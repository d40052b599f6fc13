"""Approximate nearest neighbours: an inverted file of vectors by their nearest of a fixed number of centres.

The centres are fitted on at most ``SAMPLE`` rows, those with the least hash of their key; every row is indexed. The
index is Parquet partitioned by list, so a search reads only the lists it probes. How many these are is measured when
the index is built: the least number that finds ``RECALL`` of the true neighbours of ``ASKED`` sampled rows, searched
for over all rows. Vectors without clusters need about half of the lists, clustered ones a few.

Rows without a vector are left out. An empty table gives an index without rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.operators.vector import DEFAULT_K, check_dimensions, knn, knn_many
from sparkseek.shipping import ship

LISTS, SAMPLE, ASKED, ROUNDS, RECALL = 64, 16_384, 256, 10, 0.97


def fit_centres(points: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; a centre that loses its rows stays where it is."""
    centres = points[np.linspace(0, len(points) - 1, min(lists, len(points))).astype(int)]
    for _ in range(rounds):
        nearest = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


class IvfIndex:
    def __init__(self, rows: DataFrame, centres: np.ndarray, probes: int, key: str, vector: str):
        self.rows, self.centres, self.probes, self.key, self.vector = rows, centres, probes, key, vector

    @classmethod
    def build(cls, vectors: DataFrame, path: str, key: str = "doc_key", vector: str = "vector", lists: int = LISTS, recall: float = RECALL, k: int = DEFAULT_K) -> IvfIndex:
        spark = vectors.sparkSession
        ship(spark)
        rows = vectors.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias(vector))
        sample = rows.orderBy(F.xxhash64(key), key).limit(SAMPLE).collect()
        points = np.array([r[vector] for r in sample], np.float64)
        centres = fit_centres(points, lists) if len(points) else np.zeros((0, 0))
        sent = spark.sparkContext.broadcast(centres)

        def assign(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                if b.num_rows:
                    own = np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1) @ sent.value.T
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.argmax(axis=1).astype(np.int32))], names=[key, vector, "list"])

        rows.mapInArrow(assign, f"`{key}` {dict(rows.dtypes)[key]}, `{vector}` array<double>, list int").write.mode("overwrite").partitionBy("list").parquet(path)
        spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}_centres")
        index = cls.read(spark, path, key, vector, len(centres), dict(rows.dtypes)[key])
        index.probes = index.probes_for(points[:ASKED], recall, k)
        return index

    @classmethod
    def read(cls, spark: SparkSession, path: str, key: str, vector: str, probes: int, key_type: str = "string") -> IvfIndex:
        centres = np.array([r.centre for r in spark.read.schema("list int, centre array<double>").parquet(f"{path}_centres").orderBy("list").collect()], np.float64)
        return cls(spark.read.schema(f"`{key}` {key_type}, `{vector}` array<double>, list int").parquet(path), centres, probes, key, vector)

    def order(self, query: Sequence[float]) -> list[int]:
        """The lists by falling nearness of their centre."""
        return [int(i) for i in np.argsort(-(self.centres @ np.asarray(query, np.float64)), kind="stable")] if len(self.centres) else []

    def probes_for(self, asked: np.ndarray, recall: float, k: int) -> int:
        """The least number of lists in which the share ``recall`` of the k true neighbours of the asked vectors lie."""
        if not len(asked):
            return 0
        queries = self.rows.sparkSession.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(asked)], "query_id long, q array<double>")
        true = knn_many(self.rows, queries, k, self.key, self.vector).select("query_id", self.key)
        place = [np.argsort(self.order(q)) for q in asked]
        ranks = sorted(int(place[r.query_id][r.list]) for r in self.rows.select(self.key, "list").join(F.broadcast(true), self.key).collect())
        return ranks[max(0, int(np.ceil(recall * len(ranks))) - 1)] + 1

    def probed(self, queries: DataFrame) -> DataFrame:
        """query_id and each list that a search reads for it. queries: (query id, query vector)."""
        ship(queries.sparkSession)
        centres, probes = queries.sparkSession.sparkContext.broadcast(self.centres), self.probes

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                if b.num_rows and probes:
                    near = np.argsort(-(np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1) @ centres.value.T), axis=1, kind="stable")[:, :probes]
                    ids = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), near.shape[1])))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(near.ravel().astype(np.int32))], names=["query_id", "list"])

        id_, vector = queries.columns[:2]
        own = queries.select(F.col(id_).alias("query_id"), F.col(vector).cast("array<double>").alias("q"))
        return own.mapInArrow(run, f"query_id {dict(own.dtypes)['query_id']}, list int")

    def search(self, query: Sequence[float], k: int = DEFAULT_K, probes: int | None = None) -> DataFrame:
        """The k best rows by inner product, then key, in the probed lists."""
        if len(self.centres) and self.centres.shape[1] != len(query):
            check_dimensions(self.rows, self.vector, query)
        near = self.order(query)[: self.probes if probes is None else probes]
        return knn(self.rows.where(F.col("list").isin(near)), query, k, self.key, self.vector)
