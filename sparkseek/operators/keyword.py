"""BM25 keyword search over postings.

An index is three DataFrames: postings (doc_key, scope, term, tf, dl), scopes (scope, n, avgdl) and terms (scope, term,
df). With statistics by shard, a scope is a shard; else there is one. Scoring a query is a filter on
postings, which are sorted by term on disk, one aggregation and a top-k. An index that is neither kept nor written
has its tokens too: a query then takes its own terms out of them, and no others are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkseek.functions.text import query_terms, tokens

K1, B = 1.2, 0.75


@dataclass
class KeywordIndex:
    postings: DataFrame
    scopes: DataFrame
    terms: DataFrame
    k1: float = K1
    b: float = B
    own: DataFrame | None = None  # doc_key, scope, tokens, dl: of an index whose postings are held nowhere

    @classmethod
    def build(cls, docs: DataFrame, key: str, text: Column, scope: Column | None = None, k1: float = K1, b: float = B) -> KeywordIndex:
        own = docs.select(F.col(key).alias("doc_key"), (F.lit(0) if scope is None else scope).alias("scope"), tokens(text).alias("tokens"))
        own = own.withColumn("dl", F.size("tokens"))
        scopes = own.groupBy("scope").agg(F.count("*").alias("n"), F.greatest(F.sum("dl") / F.count("*"), F.lit(1.0)).alias("avgdl"))
        postings = _postings(own, F.col("tokens"))
        return cls(postings, scopes, _terms(postings), k1, b, own)

    def keep(self) -> KeywordIndex:
        """The same index, held by the session in memory or on local disks: computed by the first query, read by all later ones."""
        postings = self.postings.persist()
        return KeywordIndex(postings, self.scopes.persist(), _terms(postings).persist(), self.k1, self.b)

    def keep_scopes(self) -> KeywordIndex:
        """The same index, with the statistics of its scopes held by the session; the terms of each query are taken from the documents."""
        return KeywordIndex(self.postings, self.scopes.persist(), self.terms, self.k1, self.b, self.own)

    def drop(self) -> None:
        """Let go of what keep() or keep_scopes() holds."""
        for t in (self.postings, self.scopes, self.terms):
            t.unpersist()

    def write(self, folder: str) -> None:
        """Postings sorted by term within files, so that a query's terms prune row groups. Terms are counted in what was written."""
        self.postings.repartitionByRange("term", "doc_key").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/postings")
        self.scopes.write.mode("overwrite").parquet(f"{folder}/scopes")
        terms = _terms(self.postings.sparkSession.read.parquet(f"{folder}/postings"))
        terms.repartitionByRange("term", "scope").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/terms")

    @classmethod
    def read(cls, spark, folder: str, k1: float = K1, b: float = B) -> KeywordIndex:
        return cls(*(spark.read.parquet(f"{folder}/{t}") for t in ("postings", "scopes", "terms")), k1, b)

    def _weighted(self, postings: DataFrame, terms: DataFrame) -> DataFrame:
        """postings with idf and score, from one row for each (scope, term) of the query."""
        stats = terms.join(F.broadcast(self.scopes), "scope")  # a row a shard
        stats = stats.withColumn("idf", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        out = postings.join(F.broadcast(stats.drop("n", "df")), ["scope", "term"])  # a row a query term and shard
        norm = F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("dl") / F.col("avgdl"))
        return out.withColumn("score", F.col("idf") * F.col("tf") * (self.k1 + 1) / norm)

    def _scored(self, words: list[str]) -> DataFrame:
        """The postings of some terms with their scores."""
        wanted = lambda t: t.isin(words) if words else F.lit(False)
        if self.own is None:
            return self._weighted(self.postings.where(wanted(F.col("term"))), self.terms.where(wanted(F.col("term"))))
        postings = _postings(self.own, F.filter("tokens", wanted))
        return self._weighted(postings, _terms(postings))

    def matches(self, query: str) -> DataFrame:
        """doc_key, score of every document with any of the query's terms; none for a query without terms."""
        return self._scored(query_terms(query)).groupBy("doc_key").agg(F.sum("score").alias("score"))

    def search(self, query: str, limit: int = 10, docs: DataFrame | None = None) -> DataFrame:
        """The best ``limit`` documents (0: all), by falling score, then key. docs: only documents with a key in it."""
        return top(self._kept(self.matches(query), docs), limit)

    @staticmethod
    def _kept(hits: DataFrame, docs: DataFrame | None) -> DataFrame:
        return hits if docs is None else hits.join(docs.select("doc_key"), "doc_key", "left_semi")

    def search_many(self, queries: list[tuple[int, str]], limit: int = 10, docs: DataFrame | None = None) -> DataFrame:
        """query_id, doc_key, score, rank: the best of each query, in one job for all."""
        spark = self.postings.sparkSession
        rows = [(i, t) for i, q in queries for t in query_terms(q)]
        asked = spark.createDataFrame(rows, "query_id long, term string")
        scored = self._scored(sorted({t for _, t in rows})).join(F.broadcast(asked), "term")
        hits = scored.groupBy("query_id", "doc_key").agg(F.round(F.sum("score"), 6).alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_key")
        return self._kept(hits, docs).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit if limit else F.lit(True))


def _postings(own: DataFrame, terms: Column) -> DataFrame:
    """Of own (doc_key, scope, tokens, dl): term frequencies. dl comes with the key, so that they need no join for it."""
    return own.select("doc_key", "scope", "dl", F.explode(terms).alias("term")).groupBy("doc_key", "scope", "dl", "term").agg(F.count("*").alias("tf"))


def _terms(postings: DataFrame) -> DataFrame:
    """Document frequencies. They read tf too, so that a plan with both has one exchange for the postings."""
    return postings.groupBy("scope", "term").agg(F.sum((F.col("tf") > 0).cast("long")).alias("df"))


def top(hits: DataFrame, limit: int, key: str = "doc_key") -> DataFrame:
    """By falling score, rounded so that sums in another order tie alike, then key; limit 0 is all."""
    out = hits.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), key)
    return out.limit(limit) if limit else out
