"""Removal of boilerplate lines, found by the number of distinct sites that they are on. DataFrame operations only.

Every line (white space at its ends aside) has a HyperLogLog sketch of its sites, merged by Spark's partial
aggregation. Lines well above ``min_sites`` go, lines well below stay, and the sites of those within ``BAND`` of it
are counted exactly: at 2**12 registers the sketch's standard error is 1.6 percent, so BAND is six of them.

Defined cases: a null text has no lines; blank lines are never removed; a null site is a site of its own; rows that
share an id must share the text, as repeated rows do; rows with a null id count as sites' lines and are cut too. An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseek.llm.common import durable, join_hot

MIN_SITES = 10
LOG_REGISTERS = 12
BAND = 0.1
_ENDS = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def _key(line: Column) -> Column:
    """A digest of the line without white space at its ends; null for a blank line."""
    bare = F.btrim(line, F.lit(_ENDS))
    return F.when(bare != "", F.unhex(F.md5(bare.cast("binary"))))


def keyed(docs: DataFrame, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text") -> DataFrame:
    """id, site, keys: the digests of a document's lines, blank ones left out."""
    site = F.coalesce(F.concat(F.lit("s"), F.col(site_col)), F.lit("n"))
    keys = F.filter(F.transform(_lines(F.col(text_col)), _key), lambda k: k.isNotNull())
    return docs.select(F.col(id_col).alias("id"), site.alias("site"), keys.alias("keys"))


def boilerplate(keys: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """key, n: the digests of lines on at least min_sites sites, and how often they occur. keys: as of keyed()."""
    lines = keys.select("site", F.explode("keys").alias("key"))
    spread = lines.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_REGISTERS)).alias("sites"), F.count("*").alias("n"))
    spread = durable(spread.where(F.col("sites") >= min_sites * (1 - BAND)))
    sure = F.col("sites") > min_sites * (1 + BAND)
    near = spread.where(~sure).select("key", F.col("n").alias("near_n"))
    # only lines near the threshold are counted exactly: they are joined first
    salt = F.encode(F.rpad(F.col("site"), 40, "."), "UTF-8")  # longer than any digest
    total = near.agg(F.sum("near_n")).first()[0] or 0
    sites = join_hot(lines.select("key", "site"), near, "key", F.col("near_n"), total, salt).distinct().groupBy("key", "near_n").agg(F.count("*").alias("exact"))
    counted = sites.where(F.col("exact") >= min_sites).select("key", F.col("near_n").alias("n"))
    return spread.where(sure).select("key", "n").unionByName(counted)


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_lines, n_removed, kept (the lines that stay, joined by newlines)."""
    keys = durable(keyed(docs, id_col, site_col, text_col))
    found = durable(boilerplate(keys, min_sites))
    own = keys.select("id", F.explode("keys").alias("key"))
    spread = F.encode(F.rpad(F.coalesce(F.col("id").cast("string"), F.lit("")), 40, "."), "UTF-8")  # longer than any digest
    total = found.agg(F.sum("n")).first()[0] or 0
    gone = join_hot(own, found, "key", F.col("n"), total, spread).groupBy("id").agg(F.collect_set("key").alias("gone"))
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = docs.join(gone.withColumnRenamed("id", "_id"), F.col("id").eqNullSafe(F.col("_id")), "left")
    lines = _lines(F.col("text"))
    kept = F.when(F.col("gone").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("gone"), _key(x)), F.lit(False))))
    out = out.select("id", F.size(lines).cast("long").alias("n_lines"), kept.alias("kept"))
    return out.select(F.col("id").alias(id_col), "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_removed"), F.array_join("kept", "\n").alias("kept"))
