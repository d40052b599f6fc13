"""The six aggregations. Each is one partial and one final aggregation; buckets come back as numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("count", "value_counts", "time_histogram", "numeric_histogram", "geo_grid", "percentiles")
#: Accuracy of approximate percentiles: relative rank error 1 / ACCURACY.
ACCURACY = 10_000


def _width(interval: float | None) -> float:
    return float(interval) if interval and interval > 0 else 1.0


def bucket(value: Column, interval: float | None) -> Column:
    """The lower end of the value's bucket; an interval that is not positive counts as 1, and -0 as 0."""
    w = _width(interval)
    return F.floor(value / w).cast("double") * w + F.lit(0.0)


def count(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("count"))


def value_counts(docs: DataFrame, value: Column) -> DataFrame:
    """value, count; rows without a value are left out."""
    return docs.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("count"))


def time_histogram(docs: DataFrame, millis: Column, interval: float | None) -> DataFrame:
    w = int(_width(interval)) or 1
    own = millis.cast("long")
    return docs.select((own - F.pmod(own, F.lit(w))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("count"))


def numeric_histogram(docs: DataFrame, value: Column, interval: float | None) -> DataFrame:
    return docs.select(bucket(value, interval).alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("count"))


def geo_grid(docs: DataFrame, lat: Column, lon: Column, interval: float | None) -> DataFrame:
    return docs.select(bucket(lat, interval).alias("lat"), bucket(lon, interval).alias("lon")).groupBy("lat", "lon").agg(F.count("*").alias("count"))


def _finite(value: Column) -> Column:
    infinite = (value == F.lit(float("inf"))) | (value == F.lit(float("-inf")))
    return F.when(~F.isnan(value) & ~infinite, value)


def percentiles(docs: DataFrame, value: Column, percents: Sequence[float], exact: bool = False) -> DataFrame:
    """p, value; no rows if there are no finite samples. Percents outside 0 to 100 count as the nearer end."""
    ps = [float(p) for p in percents]
    at = F.array(*(F.lit(min(1.0, max(0.0, p / 100))) for p in ps))
    own = docs.select(_finite(value).alias("v")).where("v is not null")
    found = own.agg((F.percentile("v", at) if exact else F.percentile_approx("v", at, ACCURACY)).alias("values"))
    zipped = F.arrays_zip(F.array(*map(F.lit, ps)).alias("p"), F.col("values"))
    return found.where("values is not null").select(F.explode(zipped).alias("r")).select(F.col("r")["p"].alias("p"), F.col("r")["values"].alias("value"))


def top_buckets(buckets: DataFrame, n: int, key: str = "value") -> DataFrame:
    return buckets.orderBy(F.desc("count"), key).limit(n)


def bucket_label(b: Column) -> Column:
    """A bucket as text: no decimal point for whole numbers, never an exponent."""
    whole = b == F.floor(b).cast("double")
    return F.when(whole, b.cast("decimal(38,0)").cast("string")).otherwise(b.cast("string"))
