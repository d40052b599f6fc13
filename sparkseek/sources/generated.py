"""Two generated feeds, each document a function of its number, as DataFrames and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from sparkseek.plans.schema import DOCUMENT, normalize

# fixed values: the vocabulary of the feeds
CRAFTS = ["TestJet", "MockLiner", "StubProp", "FixtureWing"]
CATEGORIES = ["auth_fail", "port_scan", "malware", "exfil", "privilege_escalation"]
ACTORS = ["alice", "bob", "carol", "dave", "svc-account"]
ADDRESSES = ["10.0.0.5", "10.0.0.9", "192.168.1.20", "172.16.0.4"]


def _hash(n):
    """FNV-1a of the number's four little-endian bytes, as (hi, lo)."""
    from sparkseek.functions.hashing import _LOW, _LOW40, _PRIME_LOW, OFFSET

    hi, lo = F.lit(OFFSET >> 32).cast("long"), F.lit(OFFSET & _LOW).cast("long")
    for i in range(4):
        low = lo.bitwiseXOR(F.shiftright(n, 8 * i).bitwiseAND(F.lit(255)))
        product = low * _PRIME_LOW
        hi = (hi * _PRIME_LOW + F.shiftleft(low, 8).bitwiseAND(F.lit(_LOW40)) + F.shiftright(product, 32)).bitwiseAND(F.lit(_LOW))
        lo = product.bitwiseAND(F.lit(_LOW))
    return hi, lo


def _shifted(hi, lo, by: int, modulo: int):
    """(hash >> by) % modulo."""
    if by >= 32:
        return F.shiftright(hi, by - 32) % modulo
    low = F.shiftright(lo, by)
    return ((hi % modulo) * (2 ** (32 - by) % modulo) + low % modulo) % modulo


def _numbered(spark: SparkSession, start: int, n: int, numbers: DataFrame | None) -> DataFrame:
    rows = spark.range(start, start + n).select(F.col("id").alias("s")) if numbers is None else numbers
    hi, lo = _hash(F.col("s"))
    rows = rows.withColumn("hi", hi)
    return rows.withColumn("lo", lo)


def _key(prefix: str, seed: int):
    return F.concat(F.lit(f"{prefix}{seed:04x}"), F.lpad(F.lower(F.hex("s")), 6, "0"))


def _pick(values: list[str], at):
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def synthetic(spark: SparkSession, n: int, seed: int = 0, start: int = 0, numbers: DataFrame | None = None) -> DataFrame:
    """Flights of one origin, with spread positions, altitudes and speeds; observed_at is the number."""
    rows = _numbered(spark, start, n, numbers)
    h = lambda by, m: _shifted(F.col("hi"), F.col("lo"), by, m)
    spread = lambda by, span, base: h(by, 1000) / 1000.0 * span + base
    out = rows.select(
        _key("", seed).alias("doc_key"),
        F.concat(F.lit("SYN"), F.col("s")).alias("callsign"),
        F.lit("Synthetica").alias("origin"),
        _pick(CRAFTS, h(8, len(CRAFTS))).alias("aircraft_type"),
        F.col("s").alias("observed_at"),
        spread(16, 140.0, -60.0).alias("latitude"),
        spread(26, 360.0, -180.0).alias("longitude"),
        spread(36, 12000.0, 0.0).alias("altitude"),
        spread(44, 300.0, 0.0).alias("velocity"),
    )
    return normalize(out)


def security(spark: SparkSession, n: int, seed: int = 0, start: int = 0, numbers: DataFrame | None = None) -> DataFrame:
    """Security events, each with a key of its own: origin is the address, destination the host, aircraft_type the category, callsign the actor, altitude the severity."""
    rows = _numbered(spark, start, n, numbers)
    h = lambda by, m: _shifted(F.col("hi"), F.col("lo"), by, m)
    out = rows.select(
        _key("evt-", seed).alias("doc_key"),
        _pick(ADDRESSES, h(4, len(ADDRESSES))).alias("origin"),
        F.concat(F.lit("host-"), h(20, 8)).alias("destination"),
        _pick(CATEGORIES, h(28, len(CATEGORIES))).alias("aircraft_type"),
        _pick(ACTORS, h(12, len(ACTORS))).alias("callsign"),
        h(36, 128).cast("double").alias("altitude"),
        F.col("s").alias("observed_at"),
    )
    return normalize(out)


def generated_stream(spark: SparkSession, kind: str = "synthetic", rows_per_second: int = 5, seed: int = 0) -> DataFrame:
    """The feed as a stream, at a rate that bounds what is in flight."""
    numbers = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(F.col("value").alias("s"))
    return {"synthetic": synthetic, "security": security}[kind](spark, 0, seed, numbers=numbers)


class CounterSource(DataSource):
    """spark.readStream.format("sparkseek_counter"): numbers s in batches of ``batch`` up to ``total``, for deterministic streams."""

    @classmethod
    def name(cls) -> str:
        return "sparkseek_counter"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("s", T.LongType())])

    def simpleStreamReader(self, schema: T.StructType) -> SimpleDataSourceStreamReader:
        batch, total = int(self.options.get("batch", "5")), int(self.options.get("total", "100"))

        class Reader(SimpleDataSourceStreamReader):
            def initialOffset(self) -> dict:
                return {"s": 0}

            def read(self, start: dict):
                end = min(total, start["s"] + batch)
                return iter([(i,) for i in range(start["s"], end)]), {"s": end}

            def readBetweenOffsets(self, start: dict, end: dict):
                return iter([(i,) for i in range(start["s"], end["s"])])

        return Reader()


__all__ = ["DOCUMENT", "CounterSource", "generated_stream", "security", "synthetic"]
