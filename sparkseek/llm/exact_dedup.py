"""Exact dedup against a persistent digest index, by DataFrame operations only.

The index is a Parquet table bucketed and sorted by digest: one row for each distinct normalised text
ever seen, and the batch that brought it. A batch of documents is reduced to digests, its new digests are found by a
sort-merge anti-join with the index and appended; every row of the batch then learns which row stays.

A batch that is ingested again (after a lost job, say) finds its own rows in the index: they count as new, nothing
is appended twice, and the same rows stay. A batch is known by a name, or else by a digest of its rows.

Defined cases: a null text counts as empty, and all empty texts are equal. A null id loses to every
other id. Rows are told apart by themselves, not by id: of several rows with one id those with other texts are judged
on their own, and of rows that repeat id and text one is kept. An empty table gives no rows. Other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm.common import SPACE, durable, join_hot


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


class DigestIndex:
    """Digests of all texts seen so far, in a table of the session's catalog."""

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(self.table):
            empty = spark.createDataFrame([], "digest binary, keep_id long, n_points long, batch string")
            self._write(empty, "error")

    def _write(self, df: DataFrame, mode: str) -> None:
        writer = df.write.format("parquet").mode(mode).bucketBy(self.buckets, "digest").sortBy("digest")
        writer.saveAsTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        """Remove the index. What ingest() has returned does not read it."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Append the batch's new texts to the index. One row for each row of docs: id, text_key (its text's hash), digest, keep_id, group_size, kept.

        A text that an earlier batch brought keeps its first document: all its rows in this one go. Of the
        equal new texts of the batch, the row with the most code points stays, then the smallest id, then any one.
        group_size counts the batch's equal rows.
        """
        text = F.col(text_col)
        rows = docs.select(
            F.col(id_col).cast("long").alias("id"),
            F.unhex(F.sha2(normalised(text), 256)).alias("digest"),
            F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("n_points"),
            F.xxhash64(text).alias("text_key"),
        )
        rows = durable(rows).withColumn("row", F.monotonically_increasing_id())  # of files that are written: the same each time
        if batch is None:
            n, total = rows.agg(F.count("*"), F.sum(F.xxhash64("digest", "id", "n_points", "text_key").cast("decimal(38,0)"))).first()
            batch = f"{n}/{total}"
        # the complement turns the order round, and a null stays the least
        order = F.struct("n_points", F.bitwise_not("id").alias("id"), F.bitwise_not("row").alias("row"))
        groups = rows.groupBy("digest").agg(F.count("*").alias("group_size"), F.max(order).alias("best"))
        groups = durable(groups.select("digest", "group_size", F.bitwise_not("best.id").alias("best_id"), "best.n_points", F.bitwise_not("best.row").alias("best_row")))
        before = self.read().select("digest", F.col("keep_id").alias("first_id"), (F.col("batch") == batch).alias("own"))
        known = groups.join(before.hint("merge"), "digest")
        known = durable(known.select("digest", "group_size", F.when(F.col("own"), F.col("best_id")).otherwise(F.col("first_id")).alias("keep_id"), F.when(F.col("own"), F.col("best_row")).alias("keep_row")))
        new = durable(groups.hint("merge").join(self.read(), "digest", "left_anti"))
        fresh = new.select("digest", F.col("best_id").alias("keep_id"), "n_points", F.lit(batch).alias("batch"))
        self._write(fresh.repartition(self.buckets, "digest"), "append")
        stays = new.select("digest", "group_size", F.col("best_id").alias("keep_id"), F.col("best_row").alias("keep_row")).unionByName(known)
        spread = F.encode(F.col("row").cast("string"), "UTF-8")
        out = join_hot(rows, stays, "digest", F.col("group_size"), rows.count(), spread)
        kept = F.col("row").eqNullSafe(F.col("keep_row"))
        return out.select(F.col("id").alias(id_col), "text_key", "digest", "keep_id", "group_size", kept.alias("kept"))


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    found = durable(index.ingest(docs, id_col, text_col, batch).select(F.col(id_col).alias("_id"), F.col("text_key").alias("_key"), "group_size", "kept"))
    kept = found.where("kept").select("_id", "_key")
    out = docs.join(kept, docs[id_col].cast("long").eqNullSafe(kept["_id"]) & (F.xxhash64(docs[text_col]) == kept["_key"]), "left_semi")
    if found.where("group_size > 1").groupBy("_id", "_key").count().where("count > 1").isEmpty():
        return out
    return out.dropDuplicates([id_col, text_col])  # rows that repeat id and text
