"""Every operator over the synthetic tables, and the SQL that gives the same rows."""

from __future__ import annotations

import os
import tempfile
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkseek.functions.hashing import fnv1a_limbs, shard_of
from sparkseek.functions.text import tokens
from sparkseek.functions.vectors import DIMENSIONS, dot, hash_embed, hash_embed_array
from sparkseek.operators import aggregate as agg
from sparkseek.operators import hybrid, ivf, merge, store, tdigest, vector
from sparkseek.operators.keyword import KeywordIndex, top
from sparkseek.operators.placement import Placement
from sparkseek.plans.filters import Equals, Is, Range, to_column
from sparkseek.plans.schema import Fields, normalize
from sparkseek.services import memory
from sparkseek.services.evaluation import ndcg_table
from sparkseek.sources import generated, records
from sparkseek.streaming.ingest import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Words that the queries look for; vectors with these ids are asked for their neighbours.
WORDS, MANY, ASKED = "the tion", ["the", "queoi", "und der", "thtion and", "de la"], [0, 1, 2, 3, 7]
DAY, HOUR = 86_400_000, 3_600_000


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def millis(c) -> F.Column:
    return F.expr(f"unix_micros(cast({c} as timestamp)) div 1000")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table in the document model."""
    d = read(spark, sf_dir, "documents")
    text = F.create_map(F.lit("body"), F.coalesce("text", F.lit("")), F.lit("lang"), F.coalesce("lang", F.lit("")), F.lit("source"), F.coalesce("source", F.lit("")))
    return normalize(d.select(F.col("doc_id").cast("string").alias("doc_key"), text.alias("text"), F.create_map(F.lit("n_chars"), F.col("n_chars").cast("double")).alias("number")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    text = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("user_id"), F.col("user_id").cast("string"))
    k = F.get_json_object("props", "$.k").cast("double")
    number = F.map_filter(F.create_map(F.lit("value"), F.col("value"), F.lit("k"), k), lambda _, v: v.isNotNull())
    return normalize(e.select(F.col("event_id").cast("string").alias("doc_key"), millis("ts").alias("observed_at"), text.alias("text"), number.alias("number")))


#: Indexes that the session holds, by application, files and scope; the least recently used go first.
_KEPT: OrderedDict[tuple, KeywordIndex] = OrderedDict()
KEPT_INDEXES = 4


def index(spark: SparkSession, sf_dir: str, scope=None) -> KeywordIndex:
    """The index of the documents, one for all queries of a session; other files in the folder make another index.

    A query asks for a few words of a corpus of any size, so that only the statistics of scopes are held.
    """
    docs = read(spark, sf_dir, "documents")
    key = (spark.sparkContext.applicationId, tuple(sorted(docs.inputFiles())), str(scope))
    if key not in _KEPT:
        _KEPT[key] = KeywordIndex.build(docs, "doc_id", F.col("text"), scope).keep_scopes()
        while len(_KEPT) > KEPT_INDEXES:
            old, gone = _KEPT.popitem(last=False)
            if old[0] == key[0]:
                gone.drop()
    _KEPT.move_to_end(key)
    return _KEPT[key]


# keyword search

_TOKENS = r"list_transform(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda x: x <> ''), lambda x: lower(x))"


def _bm25_sql(terms: list[str], scope: str = "0") -> str:
    """CTEs up to s(doc_id, score)."""
    words = ", ".join(f"'{t}'" for t in terms)
    return rf"""
d AS (SELECT doc_id, {scope} AS scope, {_TOKENS} AS toks FROM documents),
n AS (SELECT scope, count(*) AS n, greatest(sum(len(toks)) / count(*), 1.0) AS avgdl FROM d GROUP BY scope),
p AS (SELECT doc_id, scope, dl, term, count(*) AS tf FROM (SELECT doc_id, scope, len(toks) AS dl, unnest(toks) AS term FROM d) WHERE term IN ({words}) GROUP BY ALL),
f AS (SELECT scope, term, count(*) AS df FROM p GROUP BY ALL),
w AS (SELECT p.doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS part
      FROM p JOIN f USING (scope, term) JOIN n USING (scope)),
s AS (SELECT doc_id, round(sum(part), 6) AS score FROM w GROUP BY doc_id)"""


@query(f"WITH {_bm25_sql(['tion'])} SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 10")
def bm25_topk(spark, sf_dir):
    return index(spark, sf_dir).search("tion", 10).withColumnRenamed("doc_key", "doc_id")


@query(f"WITH {_bm25_sql(['the', 'tion'])} SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 10")
def bm25_multi_term(spark, sf_dir):
    return index(spark, sf_dir).search(WORDS, 10).withColumnRenamed("doc_key", "doc_id")


@query(f"WITH {_bm25_sql(['the', 'tion'])} SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 10")
def bm25_repeated_term(spark, sf_dir):
    return index(spark, sf_dir).search("The the TION the", 10).withColumnRenamed("doc_key", "doc_id")


@query(f"WITH {_bm25_sql(['the', 'tion'], 'doc_id % 4')} SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 10")
def bm25_sharded_stats(spark, sf_dir):
    return index(spark, sf_dir, F.col("doc_id") % 4).search(WORDS, 10).withColumnRenamed("doc_key", "doc_id")


_FILTERED = "lang = 'en' AND n_chars BETWEEN 500 AND 2000"


def _filtered(spark, sf_dir):
    d = documents(spark, sf_dir).where(to_column([Equals("lang", "EN"), Range("n_chars", 500, 2000)]))
    return d.select(F.col("doc_key").cast("long").alias("doc_key"))


@query(f"WITH {_bm25_sql(['the', 'tion'])} SELECT doc_id, score FROM s SEMI JOIN (SELECT doc_id FROM documents WHERE {_FILTERED}) USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10")
def bm25_filtered(spark, sf_dir):
    return index(spark, sf_dir).search(WORDS, 10, _filtered(spark, sf_dir)).withColumnRenamed("doc_key", "doc_id")


@query(f"WITH {_bm25_sql(['the', 'tion'])} SELECT count(*) AS total_matched FROM s SEMI JOIN (SELECT doc_id FROM documents WHERE {_FILTERED}) USING (doc_id)")
def search_total_matched(spark, sf_dir):
    found = KeywordIndex._kept(index(spark, sf_dir).matches(WORDS), _filtered(spark, sf_dir))
    return found.agg(F.count("*").alias("total_matched"))


def _many_sql() -> str:
    rows = ", ".join(f"({i}, '{t}')" for i, q in enumerate(MANY) for t in q.split())
    words = sorted({t for q in MANY for t in q.split()})
    return f"""WITH {_bm25_sql(words)}, q AS (SELECT * FROM (VALUES {rows}) v(query_id, term)),
h AS (SELECT query_id, doc_id, round(sum(part), 6) AS score FROM w JOIN q USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h)
SELECT query_id::BIGINT AS query_id, doc_id, score, rank::INT AS rank FROM r WHERE rank <= 5"""


@query(_many_sql())
def search_many(spark, sf_dir):
    return index(spark, sf_dir).search_many(list(enumerate(MANY)), 5).withColumnRenamed("doc_key", "doc_id")


@query(rf"WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY term ORDER BY df DESC, term LIMIT 50")
def index_term_stats(spark, sf_dir):
    stats = index(spark, sf_dir).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    return stats.orderBy(F.desc("df"), "term").limit(50)


@query(f"WITH {_bm25_sql(['the', 'tion'])} SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 10")
def index_on_disk(spark, sf_dir):
    """Written, read again, searched."""
    from sparkseek.operators.keyword import KeywordIndex as K

    folder = _shared(spark)
    index(spark, sf_dir).write(folder)
    return K.read(spark, folder).search(WORDS, 10).withColumnRenamed("doc_key", "doc_id")


def _shared(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        return tempfile.mkdtemp(prefix="sparkseek-")
    return f"{base.rstrip('/')}/sparkseek-{os.urandom(8).hex()}"


# filters


@query("SELECT p_partkey, p_brand, p_type FROM part WHERE lower(p_brand) = 'brand#13'")
def filter_equals_ci(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    own = p.withColumn("text", F.create_map(F.lit("brand"), F.col("p_brand")))
    return own.where(to_column([Equals("brand", "bRAND#13")])).select("p_partkey", "p_brand", "p_type")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 11")
def filter_range(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").withColumn("number", F.create_map(F.lit("quantity"), F.col("l_quantity")))
    return li.where(to_column([Range("quantity", 10, 11)])).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice <= 50000")
def filter_bool(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("on_ground", F.col("o_orderstatus") == "F").withColumnRenamed("o_totalprice", "altitude")
    return o.where(to_column([Is("on_ground", True), Range("altitude", None, 50000)])).select("o_orderkey")


@query("SELECT event_id FROM events WHERE event_id % 3 <> 0 AND value >= 100")
def filter_missing_number(spark, sf_dir):
    """Documents without the number are in no bounded range."""
    has = F.col("event_id") % 3 != 0
    e = read(spark, sf_dir, "events").withColumn("number", F.when(has, F.create_map(F.lit("v"), F.col("value"))).otherwise(F.create_map().cast("map<string,double>")))
    return e.where(to_column([Range("v", 100)])).where(to_column([Range("other")])).select("event_id")


# aggregations


@query("SELECT count(*) AS count FROM events")
def agg_count(spark, sf_dir):
    return agg.count(events(spark, sf_dir))


@query("SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1")
def agg_value_counts(spark, sf_dir):
    return agg.value_counts(events(spark, sf_dir), Fields.count_text("event_type"))


@query("SELECT event_type AS value, count(*) AS count FROM events WHERE value >= 50 AND value <= 150 GROUP BY 1")
def agg_value_counts_filtered(spark, sf_dir):
    return agg.value_counts(events(spark, sf_dir).where(to_column([Range("value", 50, 150)])), Fields.count_text("event_type"))


@query(f"SELECT (epoch_us(ts) // 1000) // {DAY} * {DAY} AS bucket, count(*) AS count FROM events GROUP BY 1")
def agg_time_histogram(spark, sf_dir):
    return agg.time_histogram(events(spark, sf_dir), F.col("observed_at"), DAY)


@query("SELECT floor(l_extendedprice / 5000) * 5000 AS bucket, count(*) AS count FROM lineitem GROUP BY 1")
def agg_numeric_histogram(spark, sf_dir):
    return agg.numeric_histogram(read(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), 5000)


@query("SELECT floor((props->>'$.k')::DOUBLE / 10) * 10 AS bucket, count(*) AS count FROM events WHERE props->>'$.k' IS NOT NULL GROUP BY 1")
def agg_numeric_histogram_generic(spark, sf_dir):
    return agg.numeric_histogram(events(spark, sf_dir), Fields.number("k"), 10)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select((k * 37 % 180 - 90).cast("double").alias("latitude"), (k * 91 % 360 - 180).cast("double").alias("longitude"))


@query("SELECT floor((c_custkey * 37 % 180 - 90) / 10.0::DOUBLE) * 10 AS lat, floor((c_custkey * 91 % 360 - 180) / 10.0::DOUBLE) * 10 AS lon, count(*) AS count FROM customer GROUP BY 1, 2")
def agg_geo_grid(spark, sf_dir):
    return agg.geo_grid(places(spark, sf_dir), F.col("latitude"), F.col("longitude"), 10)


@query("SELECT unnest([50.0::DOUBLE, 90.0::DOUBLE, 99.0::DOUBLE]) AS p, unnest(list_transform(quantile_cont(value, [0.5, 0.9, 0.99]), lambda x: round(x, 6))) AS value FROM events")
def agg_percentiles_exact(spark, sf_dir):
    return agg.percentiles(events(spark, sf_dir), Fields.number("value"), [50, 90, 99], exact=True).withColumn("value", F.round("value", 6))


@query()
def agg_percentiles_approx(spark, sf_dir):
    return agg.percentiles(read(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), [50, 90, 99])


@query()
def agg_percentiles_tdigest(spark, sf_dir):
    return tdigest.digest_percentiles(events(spark, sf_dir), Fields.number("value"), [50, 90, 99])


@query("SELECT user_id::VARCHAR AS value, count(*) AS count FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY count DESC, value LIMIT 10")
def agg_entity_pivot(spark, sf_dir):
    own = events(spark, sf_dir).where(to_column([Equals("event_type", "error")]))
    return agg.top_buckets(agg.value_counts(own, Fields.count_text("user_id")), 10)


@query(f"WITH {_bm25_sql(['tion'])} SELECT source AS value, count(*) AS count FROM documents SEMI JOIN s USING (doc_id) GROUP BY 1")
def agg_keyword_scoped(spark, sf_dir):
    found = index(spark, sf_dir).matches("tion").select(F.col("doc_key").alias("doc_id"))
    return agg.value_counts(read(spark, sf_dir, "documents").join(found, "doc_id", "left_semi"), F.col("source"))


@query("SELECT 'type' AS panel, event_type AS name, count(*) AS count FROM events GROUP BY ALL UNION ALL SELECT 'value', (floor(value / 50) * 50)::BIGINT::VARCHAR, count(*) FROM events GROUP BY ALL")
def dashboard_panels(spark, sf_dir):
    e = events(spark, sf_dir)
    types = agg.top_buckets(agg.value_counts(e, Fields.count_text("event_type")), 8).select(F.lit("type").alias("panel"), F.col("value").alias("name"), "count")
    values = agg.numeric_histogram(e, Fields.number("value"), 50).select(F.lit("value").alias("panel"), agg.bucket_label(F.col("bucket")).alias("name"), "count")
    return types.unionByName(values)


# mutation and placement


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def upsert_latest_arrival(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    first, second = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    arrived = lambda d: store.last_arrival(d, "user_id", F.col("event_id"))
    late = arrived(first).join(arrived(second).select("user_id", F.col("event_id").alias("_id")), "user_id", "left").where("_id is null or event_id > _id").drop("_id")
    return store.upserted(arrived(second), late, "user_id")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC, event_id) AS r FROM events) WHERE r = 1")
def dedup_freshest(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return merge.freshest(e, "user_id", "ts", "value", "event_id").select("user_id", "event_id", "value")


@query("SELECT event_id FROM events WHERE event_type <> 'click'")
def delete_anti(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "event_type")
    return store.deleted(e, e.where("event_type = 'click'"), "event_id").select("event_id")


def _fnv_sql(text: str) -> str:
    byte = f"list_transform(range(1, strlen({text}) + 1), lambda i: ascii(substr({text}, i, 1))::HUGEINT)"
    return f"list_reduce(list_prepend(14695981039346656037::HUGEINT, {byte}), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"


@query(f"SELECT doc_id FROM documents WHERE {_fnv_sql('doc_id::VARCHAR')} % 16 <> 5")
def evict_vshard(spark, sf_dir):
    return store.evicted(documents(spark, sf_dir), 5, 16).select(F.col("doc_key").cast("long").alias("doc_id"))


@query(f"SELECT c_custkey, ({_fnv_sql('c_custkey::VARCHAR')} % 7)::INT AS shard FROM customer")
def shard_assignment(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", shard_of(F.col("c_custkey").cast("string"), 7).alias("shard"))


_PLACED = Placement.round_robin(16, 3)


@query(f"WITH v AS (SELECT c_custkey, ({_fnv_sql('c_custkey::VARCHAR')} % 16)::INT AS vshard FROM customer) SELECT c_custkey, vshard, CASE WHEN vshard = 4 THEN 2 ELSE vshard % 3 END::INT AS \"group\" FROM v")
def vshard_reassign(spark, sf_dir):
    moved = _PLACED.reassign(4, 2)
    own = read(spark, sf_dir, "customer").select("c_custkey", moved.vshard_column(F.col("c_custkey").cast("string")).alias("vshard"))
    return own.join(F.broadcast(moved.table(spark)), "vshard")  # a row a virtual shard


@query(f"SELECT ({_fnv_sql('c_custkey::VARCHAR')} % 16 % 3)::INT AS \"group\", count(*) AS count FROM customer GROUP BY 1")
def placement_counts(spark, sf_dir):
    own = read(spark, sf_dir, "customer").select(_PLACED.vshard_column(F.col("c_custkey").cast("string")).alias("vshard"))
    return own.join(F.broadcast(_PLACED.table(spark)), "vshard").groupBy("group").agg(F.count("*").alias("count"))


# vectors

_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"


def _vector_of(spark: SparkSession, sf_dir: str, id_: int) -> list[float]:
    return list(read(spark, sf_dir, "embeddings").where(F.col("vec_id") == id_).first().embedding)


_KNN = f"WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round({_DOT.format(a='embedding', b='e')}, 6) AS score FROM embeddings, q"


@query(f"{_KNN} ORDER BY score DESC, vec_id LIMIT 10")
def knn_exact(spark, sf_dir):
    return vector.knn(read(spark, sf_dir, "embeddings"), _vector_of(spark, sf_dir, 0), 10, "vec_id", "embedding")


@query(f"{_KNN} ORDER BY score DESC, vec_id LIMIT 10")
def knn_expression(spark, sf_dir):
    return vector.knn_expression(read(spark, sf_dir, "embeddings"), _vector_of(spark, sf_dir, 0), 10, "vec_id", "embedding")


@query(f"{_KNN} WHERE label = 1 ORDER BY score DESC, vec_id LIMIT 10")
def knn_filtered(spark, sf_dir):
    return vector.knn(read(spark, sf_dir, "embeddings").where("label = 1"), _vector_of(spark, sf_dir, 0), 10, "vec_id", "embedding")


@query(f"""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id IN ({', '.join(map(str, ASKED))})),
s AS (SELECT query_id, vec_id, round({_DOT.format(a='embedding', b='e')}, 6) AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) SELECT * FROM r WHERE rank <= 5""")
def knn_multi_query(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    asked = e.where(F.col("vec_id").isin(ASKED)).select("vec_id", "embedding")
    return vector.knn_many(e, asked, 5, "vec_id", "embedding")


_BITS = "list_reduce(list_prepend(0::HUGEINT, list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN (1::HUGEINT << (i - 1)::INT) ELSE 0::HUGEINT END)), lambda a, b: a + b)"
_SIGNED = "(CASE WHEN b >= 9223372036854775808 THEN b - 18446744073709551616 ELSE b END)::BIGINT"


@query(f"WITH q AS (SELECT vec_id, {_BITS} AS b, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) / len(embedding), 6) AS correction FROM embeddings) SELECT vec_id, {_SIGNED} AS word, correction, 12 AS bytes FROM q")
def quantize_bits(spark, sf_dir):
    q = vector.quantize(read(spark, sf_dir, "embeddings"), 64, "vec_id", "embedding")
    return q.select("vec_id", F.col("bits")[0].alias("word"), F.round("correction", 6).alias("correction"), (F.size("bits") * 8 + 4).alias("bytes"))


@query(f"""WITH b AS (SELECT vec_id, embedding, {_BITS} AS b FROM embeddings), q AS (SELECT b AS qb, embedding AS e FROM b WHERE vec_id = 0),
c AS (SELECT vec_id, embedding, e, bit_count(xor(b, qb)) AS distance FROM b, q ORDER BY distance, vec_id LIMIT 40)
SELECT vec_id, round({_DOT.format(a='embedding', b='e')}, 6) AS score FROM c ORDER BY score DESC, vec_id LIMIT 10""")
def knn_quantized(spark, sf_dir):
    q = vector.quantize(read(spark, sf_dir, "embeddings"), 64, "vec_id", "embedding")
    return vector.knn_quantized(q, _vector_of(spark, sf_dir, 0), 10, "vec_id", "embedding")


@query()
def quant_recall(spark, sf_dir):
    """Of the ten nearest to vector 0, the share that the two-tier search finds."""
    exact, quick = knn_exact(spark, sf_dir), knn_quantized(spark, sf_dir)
    return exact.join(quick.select("vec_id", F.lit(1).alias("hit")), "vec_id", "left").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))


@query()
def knn_ivf_recall(spark, sf_dir):
    """Of the ten nearest to every vector whose id is divisible by 50, the share that the inverted file finds, and the share of lists that it reads."""
    e = read(spark, sf_dir, "embeddings")
    index = ivf.IvfIndex.build(e, f"{_shared(spark)}/ivf", "vec_id", "embedding")
    asked = e.where("vec_id % 50 = 0").select("vec_id", F.col("embedding").cast("array<double>").alias("q"))
    true = vector.knn_many(e, asked, 10, "vec_id", "embedding").select("query_id", "vec_id")
    probed = index.probed(asked).withColumn("hit", F.lit(1))
    held = true.join(index.rows.select("vec_id", "list"), "vec_id").join(probed, ["query_id", "list"], "left")
    return held.agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall")).withColumn("lists_read", F.lit(index.probes / len(index.centres)))


@query(rf"""WITH t AS (SELECT DISTINCT unnest({_TOKENS}) AS term FROM documents), h AS (SELECT {_fnv_sql('hex(term)')} AS h FROM t)
SELECT (h % 128)::BIGINT AS place, (h // 9223372036854775808)::BIGINT AS sign, count(*) AS terms FROM h GROUP BY 1, 2""")
def hash_embed_bucket(spark, sf_dir):
    """Terms by place and sign; the hash is of the term's hexadecimal form, which SQL can take byte by byte."""
    terms = read(spark, sf_dir, "documents").select(F.explode(tokens(F.col("text"))).alias("term")).distinct()
    h = terms.select(fnv1a_limbs(F.hex(F.encode("term", "UTF-8"))).alias("h"))
    return h.groupBy((F.col("h.lo") % DIMENSIONS).alias("place"), F.shiftright("h.hi", 31).alias("sign")).agg(F.count("*").alias("terms"))


@query()
def hash_embed_similarity(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", hash_embed()(F.col("text")).alias("v"))
    asked = F.array(*(F.lit(float(x)) for x in hash_embed_array(WORDS)))
    return top(d.select(F.col("doc_id").alias("doc_key"), dot(F.col("v"), asked).alias("score")), 10)


@query(f"""WITH {_bm25_sql(['the', 'tion'])},
kw AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 20)),
qv AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
sc AS (SELECT vec_id AS doc_id, round({_DOT.format(a='embedding', b='e')}, 6) AS score FROM embeddings, qv),
vw AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM (SELECT * FROM sc ORDER BY score DESC, doc_id LIMIT 20)),
fused AS (SELECT doc_id, round(coalesce(1.0::DOUBLE / (60 + kw.r), 0) + coalesce(1.0::DOUBLE / (60 + vw.r), 0), 9) AS score,
  CASE WHEN vw.r IS NULL THEN 'keyword' WHEN kw.r IS NULL THEN 'vector' ELSE 'both' END AS index FROM kw FULL JOIN vw USING (doc_id))
SELECT doc_id, score, index FROM fused ORDER BY score DESC, doc_id LIMIT 10""")
def hybrid_rrf(spark, sf_dir):
    """Keyword ranking of documents and ranking of the vectors with the same ids."""
    words = index(spark, sf_dir).search(WORDS, 20).withColumnRenamed("doc_key", "doc_id")
    near = vector.knn(read(spark, sf_dir, "embeddings"), _vector_of(spark, sf_dir, 0), 20, "vec_id", "embedding").withColumnRenamed("vec_id", "doc_id")
    return hybrid.fuse(words, near, 10, "doc_id")


@query(f"""WITH {_bm25_sql(['the', 'tion'])}, r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s),
j AS (SELECT doc_id, max(quality) AS rel FROM labels GROUP BY 1), i AS (SELECT rel, row_number() OVER (ORDER BY rel DESC) AS rank FROM j)
SELECT 0::BIGINT AS query_id, round((SELECT sum(coalesce(rel, 0) / log2(rank + 1)) FROM r LEFT JOIN j USING (doc_id) WHERE rank <= 10) / (SELECT sum(rel / log2(rank + 1)) FROM i WHERE rank <= 10), 6) AS ndcg""")
def ndcg_eval(spark, sf_dir):
    ranked = index(spark, sf_dir).search_many([(0, WORDS)], 10).select("query_id", F.col("doc_key").alias("doc"), "rank")
    judged = read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("doc")).agg(F.max("quality").cast("double").alias("relevance")).withColumn("query_id", F.lit(0).cast("long"))
    return ndcg_table(ranked, judged)


# merging


@query("WITH h AS (SELECT epoch_us(ts) // 1000 AS t FROM events WHERE event_type = 'error' ORDER BY value DESC, event_id LIMIT 10) SELECT coalesce(max(t) FILTER (WHERE t > 0), 0) AS freshest, coalesce(min(t) FILTER (WHERE t > 0), 0) AS stalest FROM h")
def manifest_freshness(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("event_type = 'error'").orderBy(F.desc("value"), "event_id").limit(10)
    return merge.freshness(e.select(millis("ts").alias("observed_at")))


@query(rf"""WITH {_bm25_sql(['the', 'tion'], 'lang')}, k AS (SELECT s.doc_id, score, lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, s.doc_id) AS r FROM s JOIN documents USING (doc_id))
SELECT doc_id, score, lang FROM k WHERE r <= 5 ORDER BY score DESC, doc_id LIMIT 10""")
def federated_topk(spark, sf_dir):
    """Each language is a cluster with statistics of its own; their best five are merged."""
    d = read(spark, sf_dir, "documents")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), "doc_key")
    hits = index(spark, sf_dir, F.col("lang")).matches(WORDS).withColumn("score", F.round("score", 6))
    own = hits.join(d.select(F.col("doc_id").alias("doc_key"), "lang"), "doc_key").withColumn("r", F.row_number().over(best)).where("r <= 5")
    return top(own.select("doc_key", "score", "lang"), 10).withColumnRenamed("doc_key", "doc_id")


@query(f"WITH {_bm25_sql(['the', 'tion'])} SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 10")
def progressive_final_equals_unary(spark, sf_dir):
    """The last of the growing results over four slices, whose best are found in one job."""
    best = Window.partitionBy("slice").orderBy(F.desc("score"), "doc_key")
    hits = index(spark, sf_dir).matches(WORDS).select("doc_key", F.round("score", 6).alias("score"), shard_of(F.col("doc_key").cast("string"), 4).alias("slice"))
    parts = hits.withColumn("r", F.row_number().over(best)).where("r <= 10").persist()  # forty rows
    found = None
    for s in range(4):
        part = parts.where(F.col("slice") == s).select("doc_key", "score")
        found = part if found is None else top(found.unionByName(part), 10)
    return found.withColumnRenamed("doc_key", "doc_id")


# sources


@query("SELECT event_id, (props->>'$.k')::DOUBLE AS k FROM events")
def json_flatten(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", F.from_json("props", "k double").alias("props"))).alias("body"), F.lit("e").alias("prefix"))
    docs = records.parse_bodies(e, id_field="event_id")
    return docs.select(F.substring_index("doc_key", "-", -1).cast("long").alias("event_id"), F.try_element_at("number", F.lit("props.k")).alias("k"))


def _feed_hash_sql() -> str:
    byte = "list_transform(range(0, 4), lambda i: ((s >> (8 * i)::INT) & 255)::HUGEINT)"
    return f"list_reduce(list_prepend(14695981039346656037::HUGEINT, {byte}), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"


@query(f"""WITH h AS (SELECT s, {_feed_hash_sql()} AS h FROM (SELECT unnest(range(0, 1000))::BIGINT AS s))
SELECT printf('%04x%06x', 7, s) AS doc_key, 'SYN' || s AS callsign, ['TestJet', 'MockLiner', 'StubProp', 'FixtureWing'][((h // 256) % 4)::INT + 1] AS aircraft_type,
  round(((h // 68719476736) % 1000)::DOUBLE / 1000 * 12000, 6) AS altitude, s AS observed_at FROM h""")
def source_synthetic(spark, sf_dir):
    return generated.synthetic(spark, 1000, 7).select("doc_key", "callsign", "aircraft_type", F.round("altitude", 6).alias("altitude"), "observed_at")


@query(f"""WITH h AS (SELECT s, {_feed_hash_sql()} AS h FROM (SELECT unnest(range(0, 1000))::BIGINT AS s))
SELECT ['auth_fail', 'port_scan', 'malware', 'exfil', 'privilege_escalation'][((h // 268435456) % 5)::INT + 1] AS category, count(*) AS count, sum(((h // 68719476736) % 128)::DOUBLE) AS severity FROM h GROUP BY 1""")
def source_security(spark, sf_dir):
    s = generated.security(spark, 1000, 7)
    return s.groupBy(F.col("aircraft_type").alias("category")).agg(F.count("*").alias("count"), F.sum("altitude").alias("severity"))


# memory

_ENTRIES = "SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS id, conv_id::VARCHAR AS namespace, text, role AS writer, turn * 1000 AS created_ms, (turn % 3) * 2 AS ttl_secs FROM conversations"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    id_ = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long") - 1
    return c.select(id_.alias("id"), F.col("conv_id").cast("string").alias("namespace"), "text", F.col("role").alias("writer"), (F.col("turn") * 1000).alias("created_ms"), (F.col("turn") % 3 * 2).alias("ttl_secs"))


_MEM = rf"""WITH e AS (SELECT row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS id, conv_id::VARCHAR AS namespace, {_TOKENS} AS toks, role AS writer, turn * 1000 AS created_ms, turn % 3 * 2 AS ttl_secs FROM conversations)"""


@query(rf"""{_MEM}, o AS (SELECT *, list_contains(toks, 'the')::INT + list_contains(toks, 'tion')::INT AS overlap FROM e WHERE ttl_secs = 0 OR created_ms + ttl_secs * 1000 > 4000),
r AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY overlap DESC, created_ms DESC, id) AS rank FROM o WHERE overlap > 0)
SELECT namespace, id, overlap, rank::INT AS rank FROM r WHERE rank <= 3""")
def memory_recall(spark, sf_dir):
    return memory.recalled(entries(spark, sf_dir), WORDS, 4000, limit=3).select("namespace", "id", "overlap", "rank")


@query(rf"{_MEM}, r AS (SELECT *, row_number() OVER (PARTITION BY namespace, writer ORDER BY id) AS n FROM e) SELECT namespace, writer, count(*) AS held FROM r WHERE n <= 2 GROUP BY ALL")
def memory_quota(spark, sf_dir):
    return memory.admitted(entries(spark, sf_dir), 2).groupBy("namespace", "writer").agg(F.count("*").alias("held"))


@query(rf"{_MEM} SELECT namespace, count(*) AS live FROM e WHERE ttl_secs = 0 OR created_ms + ttl_secs * 1000 > 4000 GROUP BY ALL")
def memory_live_count(spark, sf_dir):
    return memory.live(entries(spark, sf_dir), 4000).groupBy("namespace").agg(F.count("*").alias("live"))


# streaming


@query("SELECT (epoch_us(ts) // 3600000000) * 3600000 AS window_start_ms, event_type, count(*) AS count FROM events GROUP BY 1, 2")
def windowed_stream_counts(spark, sf_dir):
    """A stream over the events folder, drained at once into memory in complete mode."""
    e = read(spark, sf_dir, "events")
    name = f"windowed_{os.urandom(6).hex()}"
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "*.parquet").parquet(_as_folder(spark, e))
    counts = windowed_counts(stream, "ts", "1 hour", "event_type", late="40 days")
    q = counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select((F.unix_millis("window_start")).alias("window_start_ms"), "event_type", "count")


def _as_folder(spark: SparkSession, df: DataFrame) -> str:
    """A folder of Parquet files with df's rows: a file stream reads folders."""
    path = f"{_shared(spark)}/rows"
    df.write.parquet(path)
    return path


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
