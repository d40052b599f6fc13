from __future__ import annotations

import io
import json
import time

import pytest

from sparkseek.operators.placement import Placement
from sparkseek.plans.filters import Equals, Range
from sparkseek.plans.schema import normalize
from sparkseek.services import briefing, mcp, memory
from sparkseek.services.auth import Auth, PermissionDenied, Unauthenticated
from sparkseek.services.engine import Engine
from sparkseek.services.federation import federated_search
from sparkseek.services.memory import Malformed, MemoryStore, QuotaExceeded
from sparkseek.services.metrics import Metrics
from sparkseek.services.nlq import Call, KeywordModel, Say, ScriptedModel, ask, grade
from sparkseek.services.tools import ToolError, Tools, definitions, label
from sparkseek.sources import generated

ROWS = [("a", "France", 1000.0, 100), ("b", "France", 5000.0, 300), ("c", "USA", 2000.0, 0), ("d", "France", 2500.0, 200), ("e", "USA", 900.0, 0)]


def docs(spark, rows=ROWS):
    return normalize(spark.createDataFrame(rows, "doc_key string, origin string, altitude double, observed_at long"))


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(docs(spark), slices=2, placement=Placement.round_robin(4, 2)).cache()


def keys(result):
    return [h.key for h in result.hits]


def test_search(engine):
    r = engine.search("france", 10, [Range("altitude", None, 3000)])
    assert keys(r) == ["a", "d"] and r.total_matched == 2
    assert (r.manifest.freshest_observed_at, r.manifest.stalest_observed_at) == (200, 100)
    assert r.hits[0].vshard == engine.placement_of("a") and r.hits[0].index == "keyword"
    assert engine.search("france", 1).total_matched == 3 and keys(engine.search("", 10)) == []
    with pytest.raises(ValueError, match="numeric"):
        engine.search("france", 10, [Range("origin", 1)])


def test_stream_ends_as_the_whole(engine):
    updates = list(engine.search_stream("france usa", 3))
    assert len(updates) == 3 and updates[-1].complete and not updates[0].complete
    assert keys(updates[-1]) == keys(engine.search("france usa", 3)) and updates[-1].total_matched == 5


def test_vector_and_hybrid(engine):
    r = engine.vector_search(engine.embed("USA"), 2)
    assert keys(r) == ["c", "e"] and all(h.index == "vector" for h in r.hits)
    assert keys(engine.vector_search(engine.embed("USA"), 2, [Equals("origin", "France")])) == ["a", "b"]
    assert keys(engine.hybrid_search("usa", 2)) == ["c", "e"]
    with pytest.raises(ValueError, match="dimensions"):
        engine.vector_search([1.0], 2)


def test_quantized_mode(spark):
    e = Engine(docs(spark), vector_mode="quantized")
    assert keys(e.vector_search(e.embed("USA"), 2)) == ["c", "e"]


def test_another_embedder(spark):
    from pyspark.sql import functions as F

    class Length:
        dimensions = 2

        def embed(self, text):
            return [1.0, float(len(text))]

        def column(self, text):
            return F.array(F.lit(1.0), F.length(text).cast("double"))

    e = Engine(docs(spark, [("a", "x", 1.0, 1), ("b", "xxxxxxxx", 1.0, 1)]), embedder=Length())
    assert keys(e.vector_search(e.embed("xx"), 1)) == ["b"] and keys(e.hybrid_search("x", 2)) == ["a", "b"]


def test_aggregates(engine):
    assert engine.aggregate().count == 5 and engine.aggregate(query="!!!").count == 0 and engine.aggregate(query="usa").count == 2
    assert engine.aggregate("value_counts", "origin").buckets == {"France": 3, "USA": 2}
    assert engine.aggregate("value_counts", "origin", conditions=[Range("altitude", 2000)]).buckets == {"France": 2, "USA": 1}
    assert engine.aggregate("numeric_histogram", "altitude", 1000).buckets == {0.0: 1, 1000.0: 1, 2000.0: 2, 5000.0: 1}
    missing = engine.aggregate("numeric_histogram", "nothing", 1)
    assert missing.count == 5 and missing.buckets == {}
    assert engine.aggregate("percentiles", "altitude", percentiles=[50], sketch="exact").percentiles == [(50.0, 2000.0)]
    assert engine.aggregate("percentiles", "altitude", percentiles=[50], sketch="tdigest").percentiles[0][1] == 2000.0
    with pytest.raises(ValueError, match="unknown"):
        engine.aggregate("median")


def test_slow_and_broken_slices(spark):
    e = Engine(docs(spark), slices=2, slice_timeout_ms=20_000, fault={1: None}).cache()
    r = e.search("france usa", 10)
    assert (r.manifest.slices_answered, r.manifest.omitted[0].reason) == (1, "unreachable")
    start = time.time()
    e.fault, e.slice_timeout_ms = {0: 30.0, 1: 30.0}, 500
    r = e.search("france", 10)
    assert time.time() - start < 5 and r.hits == [] and {o.reason for o in r.manifest.omitted} == {"timeout"}


def test_state_and_scopes(spark):
    auth = Auth.parse("# tokens\nr read\no operator\n")
    e = Engine(docs(spark), slices=2, placement=Placement.round_robin(4, 2), auth=auth)
    with pytest.raises(Unauthenticated):
        e.search("x")
    with pytest.raises(Unauthenticated):
        e.search("x", token="who")
    with pytest.raises(PermissionDenied):
        e.reassign_vshard(0, 1, token="r")
    assert e.reassign_vshard(0, 1, token="o") == 1
    state = e.cluster_state("o")
    assert state["vshard_group"] == [1, 1, 0, 1] and sum(n["documents"] for n in state["nodes"]) == 5
    for bad in ("", "tok", "tok admin"):
        with pytest.raises(ValueError, match="."):
            Auth.parse(bad)
    Auth().require(None, "operator")


def test_federation(spark):
    us = Engine(docs(spark, [("us1", "synthetica", 1.0, 5), ("us2", "synthetica", 1.0, 5)]), name="us")
    eu = Engine(docs(spark, [("eu1", "synthetica", 1.0, 5), ("us1", "synthetica", 1.0, 9)]), name="eu")
    r = federated_search([us, eu], "synthetica", timeout_ms=60_000)
    assert set(keys(r)) == {"us1", "us2", "eu1"} and r.manifest.deduped == 1 and r.manifest.placement_version == 0
    eu.fault = {0: None}

    r = federated_search([us, eu], "synthetica", timeout_ms=60_000)
    assert set(keys(r)) == {"us1", "us2"} and [o.address for o in r.manifest.omitted] == ["eu"]


def test_memory(spark):
    m = MemoryStore(2)
    assert m.remember("n", "the storm over Paris", "w", 10, 1000) == 0 and m.remember("n", "storm storm", "w", 0, 2000) == 1
    with pytest.raises(QuotaExceeded):
        m.remember("n", "third", "w", 0, 3000)
    for bad in ((" ", "t", "w"), ("n", " ", "w"), ("n", "t", "")):
        with pytest.raises(Malformed):
            m.remember(*bad, 0, 0)
    assert m.remember("other", "storm", "w", 0, 3000) == 2  # refused writes take no id
    assert [e.id for e in m.recall("n", "storm paris", 0, 5000)] == [0, 1] and [e.id for e in m.recall("n", "", 1, 5000)] == [1]
    assert m.remember("n", "fourth", "w", 0, 11_000) == 3  # the first has expired at 11 s, which frees quota
    assert m.count("n", 11_000) == 2 and m.recall("nobody", "x", 0, 0) == [] and m.sweep(10**9) == 0
    rows = [(e.id, e.namespace, e.text, e.writer, e.created_ms, e.ttl_secs) for es in m.by_namespace.values() for e in es]
    table = spark.createDataFrame(rows, "id long, namespace string, text string, writer string, created_ms long, ttl_secs long")
    assert [r.id for r in memory.recalled(table, "storm", 20_000, "n").orderBy("rank").collect()] == [e.id for e in m.recall("n", "storm", 0, 20_000)]


def test_tools(engine):
    t = Tools(engine)
    text = t.call("search_flights", {"query": "france", "limit": 1})
    assert text.startswith("3 matched across 2/2 shards\n- a") and "provenance: answered 2/2 shards" in text
    assert "both" not in t.call("hybrid_search_flights", {"query": "usa"}) and "- c" in t.call("semantic_search_flights", {"query": "USA", "limit": 2})
    assert t.call("aggregate_flights", {}).startswith("count: 5\n")
    assert t.call("aggregate_flights", {"kind": "value_counts", "field": "origin"}).startswith("France: 3\nUSA: 2\n(5 matched)")
    assert t.call("aggregate_flights", {"kind": "percentiles", "field": "altitude", "percentiles": [50]}).startswith("p50: ")
    assert "2 shard group(s)" in t.call("cluster_state")
    for name, args in (("search_flights", {}), ("aggregate_flights", {"kind": "x"}), ("nope", {}), ("search_flights", {"query": "x", "filters": [{"field": "origin", "min": 1}]})):
        with pytest.raises(ToolError):
            t.call(name, args)
    assert len(definitions()) == 5 and label((10.0, -0.5)) == "10,-0.5" and label(1.7e12) == "1700000000000"


QUESTIONS = [
    ("how many flights are there right now?", "aggregate_flights", ""),
    ("which origin countries are flying?", "aggregate_flights", ""),
    ("what's the breakdown of aircraft types?", "aggregate_flights", ""),
    ("find the flight with callsign SYN0", "search_flights", "SYN0"),
    ("what are the p50 and p99 altitudes?", "aggregate_flights", ""),
    ("is the cluster healthy? how many shards answered?", "cluster_state", ""),
]


def test_questions(spark):
    t = Tools(Engine(generated.synthetic(spark, 30)).cache())
    for question, tool, text in QUESTIONS:
        a = ask(KeywordModel(), t.call, question)
        assert grade(a, [tool], [text]) and a.tool_calls == 1, question
    assert "— evidence —" in ask(KeywordModel(), t.call, "how many?").render()


def test_question_loop():
    run = lambda name, args: "x\nprovenance: p1\n"
    a = ask(ScriptedModel([Call("t"), Say("done")]), run, "q")
    assert (a.text, a.provenance, a.tools) == ("done", ["p1"], ["t"])
    a = ask(ScriptedModel([]), run, "q")
    assert a.budget_exhausted and a.tool_calls == 6 and a.text.startswith("[partial answer — tool-call budget of 6 reached]\nx")

    def fail(*_):
        raise ToolError("down")

    assert "tool 't' error: down" in ask(ScriptedModel([Call("t"), Call("t")]), fail, "q", 1).text

    class Broken:
        def next_step(self, *_):
            raise RuntimeError("no model")

    assert ask(Broken(), run, "q").text == "could not complete the query: no model"


def test_mcp(engine):
    t = Tools(engine)
    lines = ["", "no json", json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"})]
    asked = [("initialize", {"protocolVersion": "v"}), ("ping", None), ("tools/list", None), ("tools/call", {"name": "cluster_state"}), ("tools/call", {"name": "nope"}), ("other", None)]
    lines += [json.dumps({"jsonrpc": "2.0", "id": i, "method": m, "params": p}) for i, (m, p) in enumerate(asked)]
    out = io.StringIO()
    mcp.serve(t, io.StringIO("\n".join(lines)), out)
    answers = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [a["id"] for a in answers] == list(range(6))
    assert answers[0]["result"]["protocolVersion"] == "v" and answers[1]["result"] == {} and len(answers[2]["result"]["tools"]) == 5
    assert not answers[3]["result"]["isError"] and answers[4]["result"]["isError"] and answers[5]["error"]["code"] == -32601


def test_briefing():
    b = briefing.compose(ScriptedModel([Call("t"), Say("four")]), lambda n, a: "provenance: p", ["how many?"])
    assert "Q: how many?\nfour" in b.body and b.provenance == ["p"]
    dry = briefing.DryRun()
    delivered, errors = briefing.send(b, ["Ops@X.org", "evil@y.org"], briefing.Allowlist("ops@x.org, "), dry)
    assert delivered == ["Ops@X.org"] and errors == ["recipient not allowlisted: evil@y.org"] and len(dry.sent) == 1
    assert briefing.send(b, ["a@b"], briefing.Allowlist())[0] == []


def test_metrics(engine):
    m = Metrics()
    m.record_query(7)
    m.record_query(700, ok=False)
    m.record_aggregate()
    text = m.render(3)
    assert 'latency_ms_bucket{le="10"} 1\n' in text and 'le="+Inf"} 2' in text and "query_errors_total 1" in text and "sparkseek_slices 3" in text
    panels = engine.dashboard_snapshot()
    assert panels["v"] == 1 and panels["aggregate"]["by_origin"][0] == {"origin": "France", "count": 3}
