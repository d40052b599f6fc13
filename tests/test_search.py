"""Keyword, vector and hybrid search."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek.functions.hashing import fnv1a, fnv1a_limbs, shard_of
from sparkseek.functions.text import query_terms, tokenize, tokens
from sparkseek.functions.vectors import correction, hash_embed, hash_embed_array, quantized_bytes
from sparkseek.operators import hybrid, store, vector
from sparkseek.operators.keyword import KeywordIndex
from sparkseek.plans.schema import DOCUMENT, normalize, searchable_text
from sparkseek.services.evaluation import ndcg, ndcg_table

THREE = [("a1", "UAL231", "SFO", "JFK", "Boeing 737"), ("b2", "DAL45", "ATL", "LAX", "Airbus A320"), ("c3", "UAL900", "ORD", "SFO", "Boeing 777")]


def docs(spark, rows):
    return normalize(spark.createDataFrame(rows, "doc_key string, callsign string, origin string, destination string, aircraft_type string"))


def index(spark, rows, **more):
    return KeywordIndex.build(docs(spark, rows), "doc_key", searchable_text(), **more)


def keys(hits):
    return [r.doc_key for r in hits.collect()]


def test_tokens_agree_in_both_worlds(spark):
    texts = ["Boeing-737, Éa x_y!", "", "!!!", "naïve  ÀB12", "中文 字"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(tokens(F.col("t")).alias("k")).collect()
    assert [r.k for r in rows] == [tokenize(t) for t in texts]
    assert query_terms("The the TION") == ["the", "tion"]


def test_any_term_matches_and_limit(spark):
    i = index(spark, THREE)
    assert set(keys(i.search("boeing lax", 0))) == {"a1", "b2", "c3"}
    assert keys(i.search("boeing", 1)) == ["a1"]  # equal scores: by key
    assert i.matches("boeing").count() == 2
    assert keys(i.search("", 10)) == keys(i.search("!!!", 10)) == []


def test_scores_are_bm25(spark):
    i = index(spark, THREE)
    n, avg = 3, 5.0  # each document has five tokens
    idf = math.log(1 + (n - 2 + 0.5) / 2.5)
    expected = idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 5 / avg))
    assert i.search("boeing boeing", 1).first().score == pytest.approx(expected, abs=1e-6)


def test_rare_terms_and_short_documents_win(spark):
    many = [(f"k{i:02}", "", "", "", "Boeing 737") for i in range(20)] + [("zz", "", "", "", "Concorde Boeing")]
    assert keys(index(spark, many).search("boeing concorde", 1)) == ["zz"]
    lengths = [("long", "", "SFO " + "x y z " * 20, "", ""), ("short", "", "SFO", "", "")]
    assert keys(index(spark, lengths).search("sfo", 2)) == ["short", "long"]


def test_statistics_by_shard(spark):
    rows = [("a", "x", "", "", ""), ("b", "x", "", "", ""), ("c", "x", "y", "", "")]
    one = {r.doc_key: r.score for r in index(spark, rows).search("x", 0).collect()}
    two = {r.doc_key: r.score for r in index(spark, rows, scope=F.when(F.col("doc_key") == "c", 1).otherwise(0)).search("x", 0).collect()}
    assert one != two and two["c"] == pytest.approx(math.log(1 + 0.5 / 1.5) * 2.2 / 2.2, abs=1e-6)


def test_index_on_disk_and_many(spark, tmp_path):
    i = index(spark, THREE)
    i.write(str(tmp_path))
    again = KeywordIndex.read(spark, str(tmp_path))
    assert keys(again.search("boeing sfo", 0)) == keys(i.search("boeing sfo", 0))
    many = {(r.query_id, r.rank): r.doc_key for r in i.search_many([(1, "boeing"), (2, "lax"), (3, "")], 2).collect()}
    assert many == {(1, 1): "a1", (1, 2): "c3", (2, 1): "b2"}


def test_updates_equal_a_fresh_index(spark):
    rng, state = random.Random(17), {}
    current = docs(spark, THREE).limit(0)
    for step in range(3):
        batch = {f"k{rng.randrange(10)}": f"t{rng.randrange(5)} t{rng.randrange(5)}" for _ in range(8)}
        gone = [f"k{rng.randrange(10)}" for _ in range(3)]
        state = {k: v for k, v in (state | batch).items() if k not in gone}
        new = docs(spark, [(k, v, "", "", "") for k, v in batch.items()])
        current = store.deleted(store.upserted(current, new), spark.createDataFrame([(k,) for k in gone], "doc_key string"))
        current = spark.createDataFrame(current.collect(), DOCUMENT)
    a = KeywordIndex.build(current, "doc_key", searchable_text()).search("t1 t3", 0).collect()
    b = index(spark, [(k, v, "", "", "") for k, v in state.items()]).search("t1 t3", 0).collect()
    assert a == b and a


def test_hash(spark):
    assert fnv1a("") == 0xCBF29CE484222325 and fnv1a("a") == 0xAF63DC4C8601EC8C
    words = ["", "a", "boeing", "é7", "x" * 200]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", fnv1a_limbs(F.col("w")).alias("h"), shard_of(F.col("w"), 7).alias("s")).collect()
    assert all((r.h.hi << 32 | r.h.lo) == fnv1a(r.w) and r.s == fnv1a(r.w) % 7 for r in rows)
    spread = np.bincount([fnv1a(f"{i:06x}") % 8 for i in range(10_000)])
    assert spread.min() > 1000


def test_embedder(spark):
    v = hash_embed_array("Boeing 737 boeing")
    assert np.linalg.norm(v) == pytest.approx(1, abs=1e-6) and not hash_embed_array("!!!").any()
    row = spark.createDataFrame([("Boeing 737 boeing",), (None,)], "t string").select(hash_embed()(F.col("t")).alias("v")).collect()
    assert np.allclose(row[0].v, v) and not any(row[1].v)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 64))
    x = centres[rng.integers(0, 20, 600)] + 0.25 * rng.normal(size=(600, 64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_knn_paths_agree(spark, clustered):
    table = spark.createDataFrame([(f"v{i:03}", x.tolist()) for i, x in enumerate(clustered)], "doc_key string, vector array<double>")
    q = clustered[7].tolist()
    order = sorted(range(600), key=lambda i: (-round(float(clustered[i] @ clustered[7]), 6), i))[:10]
    expected = [f"v{i:03}" for i in order]
    assert keys(vector.knn(table, q)) == expected == keys(vector.knn_expression(table, q))
    many = vector.knn_many(table, spark.createDataFrame([(7, q)], "i long, v array<double>"), 10).orderBy("rank")
    assert keys(many) == expected
    assert keys(vector.knn(table, q, 0)) == []
    with pytest.raises(ValueError, match="dimensions"):
        vector.knn(table, [1.0], 3)


def test_quantized(spark, clustered):
    table = spark.createDataFrame([(f"v{i:03}", x.tolist()) for i, x in enumerate(clustered)], "doc_key string, vector array<double>")
    q = vector.quantize(table, 64).cache()
    hits = [len(set(keys(vector.knn_quantized(q, x.tolist()))) & set(keys(vector.knn(table, x.tolist())))) for x in clustered[:5]]
    assert sum(hits) / 50 >= 0.85
    small = spark.createDataFrame([([0.5, -0.5, 0.25, -0.25],)], "vector array<double>")
    row = vector.quantize(small.withColumn("doc_key", F.lit("a")), 4).select("bits", correction(F.col("vector")).alias("c")).first()
    assert row.bits == [0b0101] and row.c == pytest.approx(0.375)
    top_bit = spark.createDataFrame([([0.0] * 63 + [1.0],)], "vector array<double>").withColumn("doc_key", F.lit("a"))
    assert vector.quantize(top_bit, 64).first().bits == [-(2**63)]
    assert spark.range(1).select(quantized_bytes(F.array_repeat(F.lit(0), 6)).alias("n")).first().n == 52  # 384 dimensions: 1536 / 52 > 29


def ranked_table(spark, names):
    return spark.createDataFrame([(k, float(-i)) for i, k in enumerate(names)], "doc_key string, score double")


def test_fusion(spark):
    out = hybrid.fuse(ranked_table(spark, ["a", "b", "c"]), ranked_table(spark, ["b", "d"]), 0).collect()
    assert out[0].doc_key == "b" and out[0]["index"] == "both" and {r.doc_key for r in out} == {"a", "b", "c", "d"}
    # an empty key takes a rank but is no result
    out = hybrid.fuse(ranked_table(spark, ["", "x"]), ranked_table(spark, ["y"]), 1).collect()
    assert [(r.doc_key, r.score) for r in out] == [("y", pytest.approx(1 / 61, abs=1e-9))]


def test_fusion_is_no_worse_than_either_ranking(spark):
    rows = [(f"b{i}", "", "", "", f"Boeing 737 fleet{i}") for i in range(8)] + [(f"a{i}", "", "", "", f"Airbus A320 fleet{i}") for i in range(6)]
    rows += [("c0", "", "", "", "Concorde supersonic"), ("c1", "", "", "", "Concorde"), ("trap", "", "Boeing", "", "museum of everything else")]
    table = docs(spark, rows)
    embedded = table.select("doc_key", hash_embed()(searchable_text()).alias("vector")).cache()
    i = index(spark, rows)
    judged = {"boeing 737": {f"b{i}": 1.0 for i in range(8)}, "airbus a320": {f"a{i}": 1.0 for i in range(6)}, "concorde": {"c0": 1.0, "c1": 1.0}}
    scores = {"keyword": [], "vector": [], "both": []}
    for q, rel in judged.items():
        words, near = i.search(q, 10), vector.knn(embedded, [float(x) for x in hash_embed_array(q)], 10)
        for name, hits in (("keyword", words), ("vector", near), ("both", hybrid.fuse(words, near, 10))):
            scores[name].append(ndcg(keys(hits), rel))
    mean = {k: sum(v) / 3 for k, v in scores.items()}
    assert mean["both"] >= max(mean["keyword"], mean["vector"]) - 1e-9
    assert ndcg(["x"], {}) == 0
    ranked = spark.createDataFrame([(0, "b", 1), (0, "a", 2)], "query_id long, doc string, rank int")
    relevance = spark.createDataFrame([(0, "a", 1.0)], "query_id long, doc string, relevance double")
    assert ndcg_table(ranked, relevance).first().ndcg == pytest.approx(1 / math.log2(3), abs=1e-6)


def shuffled(df):
    """Rows that a query's jobs put into shuffles, and rows that they read from tables."""
    context = df.sparkSession.sparkContext
    store, bus = context._jsc.sc().statusStore(), context._jsc.sc().listenerBus()

    def stages():
        bus.waitUntilEmpty(30_000)
        found = store.stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): (x.shuffleWriteRecords(), x.inputRecords()) for x in (found.apply(i) for i in range(found.size()))}

    before = stages()
    df.collect()
    new = [v for k, v in stages().items() if k not in before]
    return sum(v[0] for v in new), sum(v[1] for v in new)


@pytest.fixture(scope="module")
def many_words(spark, tmp_path_factory):
    """Four hundred documents of a hundred words each, of which few are asked for."""
    folder = tmp_path_factory.mktemp("words")
    rows = [(i, " ".join(["the" if i % 5 == 0 else "a", "tion" if i % 7 == 0 else "b", *(f"w{i}x{j}" for j in range(98))]), "en" if i % 2 else "de", f"s{i % 3}", 500 + i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    docs.write.parquet(str(folder / "documents.parquet"))
    docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).write.parquet(str(folder / "labels.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", ["progressive_final_equals_unary", "bm25_filtered", "ndcg_eval", "federated_topk", "agg_keyword_scoped", "bm25_sharded_stats", "search_many", "bm25_topk"])
def test_a_query_shuffles_its_own_terms_only(spark, many_words, name):
    from sparkseek import queries as core

    rows, read = shuffled(core.queries()[name](spark, many_words))
    assert 0 < rows < 4000  # there are 40,000 tokens
    assert read < 5 * 400  # the documents for terms (again where a join leaves out null ids), scopes and what the query itself joins


def test_plain_and_kept_index_agree(spark):
    i = index(spark, THREE)
    kept = i.keep()
    for q in ("boeing sfo", "lax", "", "nothing"):
        assert i.search(q, 0).collect() == kept.search(q, 0).collect() == i.keep_scopes().search(q, 0).collect()
    many = [(1, "boeing"), (2, "lax sfo")]
    assert sorted(i.search_many(many, 0).collect()) == sorted(kept.search_many(many, 0).collect())
    kept.drop()


def test_one_index_for_all_queries_of_a_session(spark, tmp_path):
    from sparkseek import queries as core

    rows = [(1, "alpha beta"), (2, "beta"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    first, again = core.index(spark, str(tmp_path)), core.index(spark, str(tmp_path))
    assert first is again and first is not core.index(spark, str(tmp_path), F.col("doc_id") % 2)
    assert [r.doc_key for r in first.search("beta").collect()] == [2, 1]
    assert "InMemoryTableScan" in first.search("beta")._jdf.queryExecution().toString()
    spark.createDataFrame([(4, "beta beta")], "doc_id long, text string").write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_key for r in core.index(spark, str(tmp_path)).search("beta").collect()} == {1, 2, 4}
    for k in range(2, 8):
        core.index(spark, str(tmp_path), F.col("doc_id") % k)
    assert len(core._KEPT) == core.KEPT_INDEXES
