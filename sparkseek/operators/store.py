"""A keyed document table in versioned folders: upsert, delete, evict, replace, snapshot, restore.

A version is a folder of Parquet files; a small pointer file names the current one and is replaced as a
whole, so a reader sees one committed version. Upserts keep the row that arrived last, whatever its time.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.functions.hashing import shard_of


def last_arrival(rows: DataFrame, key: str, arrival: Column) -> DataFrame:
    """For each key the row with the greatest arrival number."""
    others = [c for c in rows.columns if c != key]
    numbered = rows.withColumn("_arrival", arrival)
    return numbered.groupBy(key).agg(F.max_by(F.struct(*others), "_arrival").alias("_r")).select(key, "_r.*").select(*rows.columns)


def upserted(current: DataFrame, batch: DataFrame, key: str = "doc_key") -> DataFrame:
    """current with batch's rows in place of those with its keys; batch has each key once."""
    return current.join(batch.select(key), key, "left_anti").select(*current.columns).unionByName(batch.select(*current.columns))


def deleted(current: DataFrame, keys: DataFrame, key: str = "doc_key") -> DataFrame:
    return current.join(keys.select(key), key, "left_anti").select(*current.columns)


def evicted(current: DataFrame, vshard: int, vshards: int, key: str = "doc_key") -> DataFrame:
    """Without the documents of one virtual shard; without virtual shards nothing goes."""
    return current.where(shard_of(F.col(key), vshards) != vshard) if vshards > 0 else current


def changed_texts(current: DataFrame, batch: DataFrame, text: Column, key: str = "doc_key") -> DataFrame:
    """The rows of batch whose text is new or not what is stored: those that are to be embedded again."""
    old = current.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_old"))
    out = batch.withColumn("_new", F.xxhash64(text)).join(old, F.col(key) == F.col("_key"), "left")
    return out.where(F.col("_old").isNull() | (F.col("_old") != F.col("_new"))).drop("_key", "_old", "_new")


class DocumentStore:
    """folder must be one that the driver and all executors share."""

    def __init__(self, spark: SparkSession, folder: str, schema, key: str = "doc_key"):
        self.spark, self.folder, self.schema, self.key = spark, folder, schema, key
        os.makedirs(folder, exist_ok=True)

    def _state(self) -> dict:
        try:
            with open(f"{self.folder}/current.json") as f:
                return json.load(f)
        except FileNotFoundError:
            return {"version": -1, "batch": -1}

    @property
    def version(self) -> int:
        return self._state()["version"]

    def read(self) -> DataFrame:
        version = self.version
        if version < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v{version}")

    def _commit(self, df: DataFrame, batch: int | None = None) -> None:
        state = self._state()
        new = state["version"] + 1
        df.write.mode("overwrite").parquet(f"{self.folder}/v{new}")
        with tempfile.NamedTemporaryFile("w", dir=self.folder, delete=False) as f:
            json.dump({"version": new, "batch": state["batch"] if batch is None else batch}, f)
        os.replace(f.name, f"{self.folder}/current.json")
        if new >= 2:  # a reader may still hold the version before
            shutil.rmtree(f"{self.folder}/v{new - 2}", ignore_errors=True)

    def upsert(self, rows: DataFrame, arrival: Column | None = None, batch: int | None = None) -> None:
        """A micro-batch that was committed before is skipped, so that it counts once."""
        if batch is not None and batch <= self._state()["batch"]:
            return
        rows = last_arrival(rows, self.key, F.monotonically_increasing_id() if arrival is None else arrival)
        self._commit(upserted(self.read(), rows, self.key), batch)

    def delete(self, keys: list[str]) -> int:
        """How many documents were there to delete."""
        gone = self.spark.createDataFrame([(k,) for k in keys], f"`{self.key}` string")
        n = self.read().join(gone, self.key, "left_semi").count()
        if n:
            self._commit(deleted(self.read(), gone, self.key))
        return n

    def evict(self, vshard: int, vshards: int) -> int:
        if vshards <= 0:
            return 0
        own = self.read()
        n = own.where(shard_of(F.col(self.key), vshards) == vshard).count()
        if n:
            self._commit(evicted(own, vshard, vshards, self.key))
        return n

    def replace_all(self, docs: DataFrame) -> None:
        self._commit(docs.select(*self.schema.fieldNames()))

    def snapshot(self, path: str) -> None:
        self.read().write.mode("overwrite").parquet(path)

    def restore(self, path: str) -> None:
        self.replace_all(self.spark.read.schema(self.schema).parquet(path))
