"""Documents from JSON: flattened records with open fields, and positional state vectors."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.plans.schema import DOCUMENT, normalize
from sparkseek.shipping import ship


def flatten(value: dict, prefix: str = "") -> tuple[dict[str, str], dict[str, float], tuple[float, float] | None]:
    """Text fields, number fields and (longitude, latitude) of a record.

    Nested objects get dotted names, flags become text, and ``coordinates`` with two numbers or more is the place.
    Other arrays and nulls are left out.
    """
    text: dict[str, str] = {}
    number: dict[str, float] = {}
    place = None
    for k, v in value.items():
        name = f"{prefix}{k}"
        if isinstance(v, bool):
            text[name] = "true" if v else "false"
        elif isinstance(v, str):
            text[name] = v
        elif isinstance(v, int | float):
            number[name] = float(v)
        elif isinstance(v, dict):
            t, n, p = flatten(v, f"{name}.")
            text |= t
            number |= n
            place = p or place
        elif isinstance(v, list) and k == "coordinates" and len(v) >= 2 and all(isinstance(x, int | float) and not isinstance(x, bool) for x in v[:2]):
            place = float(v[0]), float(v[1])
    return text, number, place


def record_to_doc(record: dict, index: int, prefix: str, id_field: str = "id", time_field: str | None = None) -> dict:
    """The key is ``prefix-id``; an id that is no string is written as JSON, a missing one is the record's place."""
    id_ = record.get(id_field, index) if id_field in record else index
    text, number, place = flatten(record)
    doc = {"doc_key": f"{prefix}-{id_ if isinstance(id_, str) else json.dumps(id_)}", "text": text, "number": number}
    if place:
        doc |= {"longitude": place[0], "latitude": place[1]}
    if time_field and isinstance(record.get(time_field), int | float):
        doc["observed_at"] = int(record[time_field])
    return doc


def json_to_docs(body: str, prefix: str, path: str = "", id_field: str = "id", time_field: str | None = None) -> list[dict]:
    """Documents at a dotted path: of an array one for each object, of an object one, else none."""
    try:
        value = json.loads(body)
    except ValueError:
        return []
    for step in filter(None, path.split(".")):
        if not isinstance(value, dict) or step not in value:
            return []
        value = value[step]
    records = value if isinstance(value, list) else [value]
    return [record_to_doc(r, i, prefix, id_field, time_field) for i, r in enumerate(records) if isinstance(r, dict)]


def parse_bodies(bodies: DataFrame, body: str = "body", prefix: str = "prefix", path: str = "", id_field: str = "id", time_field: str | None = None) -> DataFrame:
    """Documents of a DataFrame (batch or stream) of JSON texts; prefix names a column. Field names are data, hence Python."""

    kinds = {"doc_key": pa.string(), "observed_at": pa.int64(), "latitude": pa.float64(), "longitude": pa.float64(), "text": pa.map_(pa.string(), pa.string()), "number": pa.map_(pa.string(), pa.float64())}
    empty = {"observed_at": 0, "latitude": 0.0, "longitude": 0.0}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = [empty | d for t, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for d in json_to_docs(t or "", p, path, id_field, time_field)]
            values = {k: [list(d[k].items()) if k in ("text", "number") else d[k] for d in docs] for k in kinds}
            yield pa.RecordBatch.from_arrays([pa.array(values[k], t) for k, t in kinds.items()], names=list(kinds))

    ship(bodies.sparkSession)
    schema = "doc_key string, observed_at long, latitude double, longitude double, text map<string,string>, number map<string,double>"
    return normalize(bodies.select(F.col(body).alias("body"), F.col(prefix).alias("prefix")).mapInArrow(run, schema))


def read_json_files(spark: SparkSession, folder: str, prefix: str = "s3", path: str = "", id_field: str = "id", stream: bool = False) -> DataFrame:
    """Each file under a folder (object store or disk) as one JSON text; files that are no JSON give nothing. Keys start with prefix:name."""
    reader = spark.readStream if stream else spark.read
    files = reader.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(folder)
    named = files.select(F.col("value").alias("body"), F.concat(F.lit(f"{prefix}:"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).alias("prefix"))
    return parse_bodies(named, path=path, id_field=id_field)


def fetch_url(url: str, timeout: float = 10.0) -> str:
    """The body at a URL."""
    from urllib.request import urlopen

    with urlopen(url, timeout=timeout) as r:  # noqa: S310
        return r.read().decode()


def read_http(spark: SparkSession, url: str, prefix: str = "http", path: str = "", id_field: str = "id", fetch=fetch_url) -> DataFrame:
    """One fetch of a URL as documents; a fetch that fails gives none."""
    try:
        body = fetch(url)
    except OSError:
        body = "[]"
    return parse_bodies(spark.createDataFrame([(body, prefix)], "body string, prefix string"), path=path, id_field=id_field)


def parse_states(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Documents of texts such as {"states": [[...], ...]}, fields by place; states without a key are left out."""
    rows = bodies.select(F.explode(F.from_json(F.col(body), "states array<string>")["states"]).alias("state")).select(F.try_parse_json("state").alias("v"))
    get = lambda i, kind: F.try_variant_get("v", f"$[{i}]", kind)
    word = lambda i: F.trim(F.coalesce(get(i, "string"), F.lit("")))
    out = rows.select(
        word(0).alias("doc_key"),
        word(1).alias("callsign"),
        word(2).alias("origin"),
        (F.coalesce(get(3, "long"), F.lit(0)) * 1000).alias("observed_at"),
        *(F.coalesce(get(i, "double"), F.lit(0.0)).alias(c) for i, c in ((5, "longitude"), (6, "latitude"), (7, "altitude"), (9, "velocity"), (10, "heading"), (11, "vertical_rate"))),
        F.coalesce(get(8, "boolean"), F.lit(False)).alias("on_ground"),
    )
    return normalize(out.where("doc_key <> ''"))


def select_source(spark: SparkSession, kind: str, **options) -> DataFrame:
    """synthetic, security, http, files or states."""
    from sparkseek.sources.generated import security, synthetic

    if kind == "synthetic":
        return synthetic(spark, **options)
    if kind == "security":
        return security(spark, **options)
    if kind == "http":
        return read_http(spark, **options)
    if kind == "files":
        return read_json_files(spark, **options)
    if kind == "states":
        return parse_states(spark.read.text(options["path"], wholetext=True).withColumnRenamed("value", "body"))
    raise ValueError(f"unknown source {kind!r}")


__all__ = ["DOCUMENT", "fetch_url", "flatten", "json_to_docs", "parse_bodies", "parse_states", "read_http", "read_json_files", "record_to_doc", "select_source"]
