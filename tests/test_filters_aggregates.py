from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from sparkseek.operators import aggregate as agg
from sparkseek.operators import tdigest
from sparkseek.operators.tdigest import TDigest
from sparkseek.plans.filters import Equals, Is, Range, matches, parse_args, parse_json, to_column, validate
from sparkseek.plans.schema import DOCUMENT, Fields, normalize

DOC = {"doc_key": "abc123", "callsign": "UAL231", "origin": "France", "altitude": 2500.0, "observed_at": 1_000_000, "on_ground": False, "text": {"severity_label": "high", "name": "É"}, "number": {"latency_ms": 42.0, "bad": math.nan}}

CASES = [
    ([Equals("origin", "FRANCE")], True),
    ([Equals("doc_key", "ABC123")], True),
    ([Equals("severity_label", "High")], True),
    ([Equals("name", "é")], False),  # only A-Z fold
    ([Equals("missing", "")], True),
    ([Equals("missing", "x")], False),
    ([Range("altitude", 2500, 2500)], True),
    ([Range("altitude", 2501)], False),
    ([Range("observed_at", None, 999_999)], False),
    ([Range("latency_ms", 40, 50)], True),
    ([Range("missing", 0)], False),
    ([Range("bad", 5)], False),
    ([Range("missing")], True),
    ([Is("on_ground", False)], True),
    ([Is("on_ground", False), Equals("origin", "Spain")], False),
    ([], True),
]


@pytest.mark.parametrize(("conditions", "expected"), CASES)
def test_filter(spark, conditions, expected):
    df = normalize(spark.createDataFrame([DOC], "doc_key string, callsign string, origin string, altitude double, observed_at long, on_ground boolean, text map<string,string>, number map<string,double>"))
    assert (df.where(to_column(conditions)).count() == 1) is expected
    assert matches(conditions, DOC) is expected


@pytest.mark.parametrize("bad", [Equals("altitude", "x"), Range("origin", 1), Is("origin", True), Range("altitude", 2, 1), Equals("on_ground", "true"), Range("on_ground", 1), Is("unknown", True)])
def test_wrong_types_are_errors(bad):
    with pytest.raises(ValueError, match="."):
        validate([bad])


def test_filters_reach_the_scan(spark, tmp_path):
    normalize(spark.createDataFrame([DOC], "doc_key string, altitude double")).write.parquet(str(tmp_path / "d"))
    plan = spark.read.parquet(str(tmp_path / "d")).where(to_column([Range("altitude", 1, 2)])).select("doc_key")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(altitude,1.0)" in plan


def test_parsers():
    assert parse_args(["a=x", "b=1..2", "c=..5", "d=true"]) == [Equals("a", "x"), Range("b", 1, 2), Range("c", None, 5), Is("d", True)]
    for bad in ("novalue", "a=x..y"):
        with pytest.raises(ValueError, match="."):
            parse_args([bad])
    items = [{"field": "a", "equals": "x"}, {"field": "b", "min": 1}, {"field": "on_ground", "is": False}]
    assert parse_json(items) == [Equals("a", "x"), Range("b", 1.0), Is("on_ground", False)] and parse_json(None) == []
    with pytest.raises(ValueError, match="'q' needs"):
        parse_json([{"field": "q"}])
    with pytest.raises(ValueError, match="field"):
        parse_json([{"equals": "q"}])


def corpus(spark, n=2000, seed=42):
    r = random.Random(seed)
    rows = [(f"k{i}", r.choice(["France", "USA", "Spain", "", "Italy", "Japan"]), r.choice("ABCD"), r.random() * 12000, float(r.randrange(-90, 90)), float(r.randrange(-180, 180)), r.randrange(10**7)) for i in range(n)]
    return normalize(spark.createDataFrame(rows, "doc_key string, origin string, aircraft_type string, altitude double, latitude double, longitude double, observed_at long"))


def test_results_do_not_depend_on_partitions(spark):
    whole = corpus(spark).cache()
    runs = []
    for n in (1, 3, 8):
        d = whole.repartition(n)
        runs.append(
            [
                sorted(map(tuple, x.collect()))
                for x in (
                    agg.count(d),
                    agg.value_counts(d, Fields.count_text("origin")),
                    agg.time_histogram(d, F.col("observed_at"), 1_000_000),
                    agg.numeric_histogram(d, Fields.number("altitude"), 1000),
                    agg.geo_grid(d, F.col("latitude"), F.col("longitude"), 10),
                    agg.percentiles(d, Fields.number("altitude"), [50, 99], exact=True),
                )
            ]
        )
    assert runs[0] == runs[1] == runs[2]
    assert dict(runs[0][1])[""] > 0  # an empty built-in value is counted
    values = sorted(r.altitude for r in whole.collect())
    for n in (1, 4):
        for r in tdigest.digest_percentiles(whole.repartition(n), Fields.number("altitude"), [50.0, 95.0, 99.0]).collect():
            assert abs(r.value - values[round(r.p / 100 * (len(values) - 1))]) < 0.03 * 12000


def test_edges(spark):
    d = normalize(spark.createDataFrame([("a", {"x": -0.5}), ("b", {}), ("c", {"x": math.inf}), ("d", {"x": 0.0})], "doc_key string, number map<string,double>"))
    assert agg.count(d).first()["count"] == 4
    finite = d.where("doc_key <> 'c'")
    assert {r.bucket: r["count"] for r in agg.numeric_histogram(finite, Fields.number("x"), 0).collect()} == {-1.0: 1, 0.0: 1}
    assert agg.percentiles(d, Fields.number("y"), [50]).count() == 0
    assert [r.value for r in agg.percentiles(d, Fields.number("x"), [-5, 200], exact=True).orderBy("p").collect()] == [-0.5, 0.0]
    assert agg.value_counts(d, Fields.count_text("doc_key")).count() == 0  # the key is no field to count
    labels = spark.createDataFrame([(30.0,), (-30.0,), (1.7e12,), (0.5,)], "b double").select(agg.bucket_label(F.col("b")).alias("l")).collect()
    assert [r.l for r in labels] == ["30", "-30", "1700000000000", "0.5"]
    empty = spark.createDataFrame([], DOCUMENT)
    assert tdigest.digest_percentiles(empty, Fields.number("altitude"), [50.0]).count() == 0


def test_tdigest():
    d = TDigest()
    for x in [*range(10_000), math.nan, math.inf]:
        d.add(float(x))
    assert all(abs(d.quantile(q) - q * 9999) < 200 for q in (0.01, 0.5, 0.99)) and d.count == 10_000
    parts = []
    for k in range(3):
        t = TDigest()
        for i in range(3000):
            t.add((i * 3 + k) * 1.7 % 5000)
        parts.append(t)
    merged = parts[0].merge(parts[1]).merge(parts[2])
    assert all(abs(merged.quantile(q) - q * 5000) < 150 for q in (0.1, 0.5, 0.9)) and len(merged.centroids) < 300
    again = TDigest.of(*zip(*merged.centroids))
    assert again.quantile(0.5) == merged.quantile(0.5) and math.isnan(TDigest().quantile(0.5))
    assert merged.quantile(-1) == merged.centroids[0][0] and merged.quantile(2) == merged.centroids[-1][0]
