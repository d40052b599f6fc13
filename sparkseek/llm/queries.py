"""Queries over the synthetic tables, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm import chroma, exact_dedup, jaccard_join, langid, line_spread, mixing, packing, quality, repeated_phrases, url_filter

Query = Callable[[SparkSession, str], DataFrame]

#: The rules that the URL query judges by, and terms that label a host as spam for training (short ones only as whole words).
URL_RULES = [
    url_filter.Rule("com/en/", "block"),
    url_filter.Rule("example.com/en/7", "allow"),
    url_filter.Rule("net/de/", "allow"),
    url_filter.Rule("example.net/de/8", "block"),
    url_filter.Rule("org/es/", "block"),
]
SPAM_TERMS = r"spam|pills|casino|viagra|poker|replica|payday|xxx|(^|[.-])(bets|ads|adult)([.-]|$)"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio: each document's UTF-8 bytes are read as a recording of unsigned 8-bit samples at 4 kHz."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("audio"))
    return chroma.shared_audio(docs, chroma.samples_of_bytes)


def op2_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_phrases.remove_repeated(read(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))
    return out.select("doc.doc_id", "text_score", "metadata_score", "quality_score", "kept")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = word_tokenizer_path()
    return packing.pack(read(spark, sf_dir, "documents"), lambda: packing.word_tokenizer(path).encode)


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read(spark, sf_dir, "documents"))
    first = F.round(F.try_element_at("positions", F.lit(1)), 9)
    return out.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position")).orderBy("first_position", "doc_id")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_groups(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_spread.remove_boilerplate(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def labelled_urls(pages: DataFrame) -> DataFrame:
    """The tables hold no labels of URLs: a host with a listed term is labelled as spam, the others as clean."""
    host, _ = url_filter.host_and_path(F.col("url"))
    return pages.where(F.col("url").isNotNull()).select("url", host.rlike(SPAM_TERMS).cast("int").alias("label"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, URL_RULES, url_filter.UrlModel().fit(labelled_urls(pages)))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    out = langid.identify(docs, langid.learn(docs.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark)
    found = index.ingest(read(spark, sf_dir, "documents"))
    index.drop()  # a query leaves no table behind; a pipeline over batches keeps it
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def queries() -> dict[str, Query]:
    return {
        "op1_chroma": op1_chroma,
        "op2_repeated_phrases": op2_repeated_phrases,
        "op3_quality": op3_quality,
        "op4_pack": op4_pack,
        "op5_mix": op5_mix,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_line_spread": op7_line_spread,
        "op8_url_filter": op8_url_filter,
        "op9_language": op9_language,
        "op10_exact_dedup": op10_exact_dedup,
    }


_MIX_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR) AS turn
  FROM documents),
sources AS (SELECT key, source, sum(size)::BIGINT AS source_size FROM rows GROUP BY key, source),
placed AS (SELECT *, (row_number() OVER (ORDER BY key) - 1) AS place FROM sources),
weighed AS (SELECT *, (place % 3 + 1)::DOUBLE AS weight, (source_size * 3)::DOUBLE AS cap FROM placed),
levelled AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
level AS (SELECT level FROM levelled WHERE level * weight <= cap ORDER BY cap / weight, place LIMIT 1),
targets AS (
  SELECT key, source_size, weight, place, least(cap, coalesce((SELECT level FROM level) * weight, cap)) AS target FROM levelled),
started AS (
  SELECT r.*, t.source_size, t.target, t.weight, t.place,
         coalesce(sum(r.size) OVER (PARTITION BY r.key ORDER BY turn, doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM rows r JOIN targets t USING (key)),
quota AS (SELECT *, floor(target)::BIGINT AS quota, CASE WHEN place % 2 = 0 THEN -0.5 ELSE 0.5 END::DOUBLE AS slope FROM started),
timed AS (
  SELECT *, weight * (1 - slope) AS w0, (weight * (1 + slope) - weight * (1 - slope)) / 1.0::DOUBLE AS dw,
         weight * start / target AS c FROM quota)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, quota - start)) + greatest(0, least(size, quota - start - source_size)) + greatest(0, least(size, quota - start - 2 * source_size)))::BIGINT AS taken,
  CASE WHEN size > 0 AND start < quota THEN round(least(2 * c / (w0 + sqrt(greatest(w0 * w0 + 2 * dw * c, 0))), 1.0), 9) END AS first_position
FROM timed
"""

_LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, source, i, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
        FROM documents WHERE text IS NOT NULL)),
b AS (SELECT bare FROM l WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT 's' || source) + max((source IS NULL)::INT) >= 10),
k AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE bare IN (SELECT bare FROM b)) AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE bare NOT IN (SELECT bare FROM b)), '') AS kept
      FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""

_EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS n
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256)::BIGINT AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_mix": _MIX_SQL, "op7_line_spread": _LINES_SQL, "op10_exact_dedup": _EXACT_SQL}
