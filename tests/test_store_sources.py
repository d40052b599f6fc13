"""Mutation, placement, sources and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sparkseek.functions.hashing import fnv1a
from sparkseek.operators import merge, store
from sparkseek.operators.merge import Hit, Manifest, Omitted, merge_hits
from sparkseek.operators.placement import Placement, owned_modulo
from sparkseek.operators.store import DocumentStore
from sparkseek.plans.schema import DOCUMENT, normalize
from sparkseek.sources import generated, records
from sparkseek.streaming.ingest import evict_unowned, ingest, owned_by, windowed_counts


def docs(spark, rows):
    return normalize(spark.createDataFrame(rows, "doc_key string, origin string, observed_at long"))


def state(s):
    return {r.doc_key: r.origin for r in s.read().collect()}


def test_store(spark, tmp_path):
    s = DocumentStore(spark, str(tmp_path / "s"), DOCUMENT)
    assert s.version == -1 and s.read().count() == 0
    s.upsert(docs(spark, [("a", "new", 200), ("b", "x", 1)]))
    s.upsert(docs(spark, [("a", "late", 100)]))  # the last to arrive wins, whatever its time
    assert state(s) == {"a": "late", "b": "x"}
    s.upsert(docs(spark, [("c", "1", 0), ("c", "2", 0)]).coalesce(1))
    assert state(s)["c"] == "2"
    assert s.delete(["b", "nobody"]) == 1 and s.delete(["b"]) == 0
    s.snapshot(str(tmp_path / "snap"))
    v = fnv1a("a") % 4
    assert s.evict(v, 0) == 0 and s.evict(v, 4) >= 1 and "a" not in state(s)
    s.restore(str(tmp_path / "snap"))
    assert state(s) == {"a": "late", "c": "2"}
    before = s.version
    s.upsert(docs(spark, [("z", "z", 0)]), batch=3)
    s.upsert(docs(spark, [("z", "again", 0)]), batch=3)  # a batch that was committed counts once
    assert s.version == before + 1 and state(s)["z"] == "z"
    changed = store.changed_texts(s.read(), docs(spark, [("z", "z", 9), ("c", "3", 0), ("n", "", 0)]), F.col("origin"))
    assert {r.doc_key for r in changed.collect()} == {"c", "n"}


def test_placement(spark, tmp_path):
    p = Placement.round_robin(8, 3)
    q = p.reassign(2, 0)
    assert (q.version, q.vshards[2], p.vshards[2]) == (1, 0, 2)
    for bad in ((8, 0), (0, 3)):
        with pytest.raises(ValueError, match="not in"):
            p.reassign(*bad)
    q.save(str(tmp_path / "p.json"))
    assert Placement.load(str(tmp_path / "p.json")) == q
    d = docs(spark, [(f"k{i}", "", 0) for i in range(100)])
    parts = [{r.doc_key for r in q.owned(d, g).collect()} for g in range(3)]
    assert sum(map(len, parts)) == 100 and all(q.owner(k) == g for g, part in enumerate(parts) for k in part)
    assert Placement(2).owned(d, 0).count() == 0 and Placement(2).owner("x") == -1
    assert sum(owned_modulo(d, s, 4).count() for s in range(4)) == 100


def hit(key, score, at=0):
    return Hit({"doc_key": key, "observed_at": at}, score)


def test_merge(spark):
    hits, dropped = merge_hits([[hit("aaa", 1.0), hit("bbb", 3.0)], [hit("ccc", 2.0)]], 2)
    assert [h.key for h in hits] == ["bbb", "ccc"] and dropped == 0
    hits, dropped = merge_hits([[hit("x", 9.0, 100)], [hit("x", 2.0, 200)]], 0)
    assert dropped == 1 and hits[0].observed_at == 200  # the freshest, not the best
    assert merge_hits([[hit("x", 1.0, 5), hit("b", 1.0)], [hit("x", 2.0, 5)]], 0)[0][0].score == 2.0
    m = Manifest(2, 1, [Omitted("n1", "timeout")], 3, 5000, 1000, 4, 12)
    assert m.summary(65_000) == "answered 1/2 shards · omitted: n1 (timeout) · 3 cross-shard duplicates dropped · freshest 60s old · placement v4 · 12ms"
    table = spark.createDataFrame([("x", 100, 9.0, 0), ("x", 200, 2.0, 1), ("x", 200, 2.0, 2), ("y", 0, 1.0, 0)], "k string, t long, s double, shard int")
    assert {(r.k, r.shard) for r in merge.freshest(table, "k", "t", "s", "shard").collect()} == {("x", 1), ("y", 0)}
    assert merge.freshness(table.withColumnRenamed("t", "observed_at")).first() == (200, 100)


def test_generated_feeds(spark):
    def expected(s):
        h = fnv1a(s.to_bytes(4, "little"))
        return f"{7:04x}{s:06x}", generated.CRAFTS[(h >> 8) % 4], (h >> 36) % 1000 / 1000 * 12000, (h >> 16) % 1000 / 1000 * 140 - 60, (h >> 26) % 1000 / 1000 * 360 - 180

    rows = generated.synthetic(spark, 50, 7).orderBy("observed_at").collect()
    assert [(r.doc_key, r.aircraft_type, r.altitude, r.latitude, r.longitude) for r in rows] == [expected(s) for s in range(50)]
    s = generated.security(spark, 400, 1)
    assert s.select("doc_key").distinct().count() == 400 and s.agg(F.max("altitude")).first()[0] <= 127
    h = fnv1a((3).to_bytes(4, "little"))
    r = s.where("observed_at = 3").first()
    assert (r.callsign, r.origin, r.altitude) == (generated.ACTORS[(h >> 12) % 5], generated.ADDRESSES[(h >> 4) % 4], float(h >> 36 & 0x7F))


def test_records(spark, tmp_path):
    body = {"features": [{"id": "q1", "properties": {"mag": 4.5, "felt": None, "tsunami": True, "deep": {"name": "x"}}, "geometry": {"coordinates": [-122.4, 37.6, 1]}}, {"id": 7, "tags": ["no"]}, 3, {"k": 1}]}
    docs_ = records.json_to_docs(json.dumps(body), "geo", "features")
    assert [d["doc_key"] for d in docs_] == ["geo-q1", "geo-7", "geo-3"]
    assert docs_[0]["text"] == {"id": "q1", "properties.tsunami": "true", "properties.deep.name": "x"} and docs_[0]["number"] == {"properties.mag": 4.5}
    assert (docs_[0]["longitude"], docs_[0]["latitude"]) == (-122.4, 37.6)
    assert records.json_to_docs('{"id": null}', "p")[0]["doc_key"] == "p-null"
    assert records.json_to_docs("no json", "p") == records.json_to_docs('{"a": 1}', "p", "b") == records.json_to_docs("3", "p") == []
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(body["features"]))
    (tmp_path / "in" / "b.txt").write_text("not json")
    rows = records.read_json_files(spark, str(tmp_path / "in")).collect()
    assert {r.doc_key for r in rows} == {"s3:a.json-q1", "s3:a.json-7", "s3:a.json-3"} and rows[0].number["properties.mag"] == 4.5

    def broken(url):
        raise OSError

    assert records.read_http(spark, "http://x", fetch=lambda u: '[{"id": "1"}]').first().doc_key == "http-1" and records.read_http(spark, "http://x", fetch=broken).count() == 0


def test_states(spark):
    states = [["abc123", "UAL231 ", "United States", 1700000000, 1, -122.4, 37.6, 10000.0, False, 250, 90, 5], ["d4", None, None, None, None, None, None, None, None, None, None, None], [None, "x"], ["  ", "y"]]
    rows = {r.doc_key: r for r in records.parse_states(spark.createDataFrame([(json.dumps({"states": states}),), ("[]",)], "body string")).collect()}
    assert set(rows) == {"abc123", "d4"}
    a, d = rows["abc123"], rows["d4"]
    assert (a.callsign, a.observed_at, a.longitude, a.altitude, a.velocity) == ("UAL231", 1_700_000_000_000, -122.4, 10000.0, 250.0)
    assert (d.callsign, d.altitude, d.on_ground) == ("", 0.0, False)
    with pytest.raises(ValueError, match="unknown source"):
        records.select_source(spark, "nope")


def test_stream_into_store_and_restart(spark, tmp_path):
    feed, s = tmp_path / "feed", DocumentStore(spark, str(tmp_path / "s"), DOCUMENT)
    generated.synthetic(spark, 20).coalesce(1).write.parquet(str(feed))
    stream = lambda: spark.readStream.schema(DOCUMENT).parquet(str(feed))
    p = Placement.round_robin(4, 2)
    ingest(stream(), s, str(tmp_path / "c"), owned_by(lambda: p, 0)).awaitTermination()
    first = set(state(s))
    assert first == {r.doc_key for r in p.owned(generated.synthetic(spark, 20), 0).collect()}
    generated.synthetic(spark, 30).coalesce(1).write.mode("append").parquet(str(feed))
    ingest(stream(), s, str(tmp_path / "c"), owned_by(lambda: p, 0)).awaitTermination()  # from where it was
    assert set(state(s)) == {r.doc_key for r in p.owned(generated.synthetic(spark, 30), 0).collect()}
    moved = p.reassign(0, 1)
    evict_unowned(s, moved, 0)
    assert all(moved.owner(k) == 0 for k in state(s))


def test_counter_stream(spark, tmp_path):
    spark.dataSource.register(generated.CounterSource)
    numbers = spark.readStream.format("sparkseek_counter").option("batch", 5).option("total", 12).load()
    s = DocumentStore(spark, str(tmp_path / "s"), DOCUMENT)
    q = ingest(generated.security(spark, 0, numbers=numbers), s, str(tmp_path / "c"), poll="0 seconds")
    try:
        for _ in range(4):
            q.processAllAvailable()
    finally:
        q.stop()
    assert s.read().count() == 12


def test_windows(spark):
    e = spark.sql("SELECT timestamp_ntz'2024-01-01 00:10:00' ts, 'a' k UNION ALL SELECT timestamp_ntz'2024-01-01 00:50:00', 'a' UNION ALL SELECT timestamp_ntz'2024-01-01 01:00:00', 'a'")
    assert sorted(r["count"] for r in windowed_counts(e, "ts", "1 hour", "k").collect()) == [1, 2]
