"""The engine: five query shapes over one collection of documents.

The collection is cut into slices by key hash. With statistics over all documents (the default) a query is one Spark
plan. ``search_stream`` and deadlines run the slices apart, each in a thread of its own under a Spark
tag, so that a slice that is late is cancelled alone and the result says what it lacks.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.functions.hashing import shard_of
from sparkseek.functions.text import query_terms
from sparkseek.functions.vectors import HashEmbedder
from sparkseek.operators import aggregate as agg
from sparkseek.operators import hybrid, tdigest, vector
from sparkseek.operators.keyword import B, K1, KeywordIndex
from sparkseek.operators.merge import Hit, Manifest, Omitted, envelope, merge_hits
from sparkseek.operators.placement import Placement
from sparkseek.plans.filters import Condition, to_column, validate
from sparkseek.plans.schema import Fields, searchable_text
from sparkseek.services.auth import Auth
from sparkseek.services.metrics import Metrics

SLICE_TIMEOUT_MS = 2000


@dataclass
class Result:
    hits: list[Hit]
    total_matched: int
    manifest: Manifest
    complete: bool = True


@dataclass
class Aggregate:
    kind: str
    count: int
    buckets: dict
    percentiles: list[tuple[float, float]]
    manifest: Manifest


@dataclass
class Engine:
    docs: DataFrame
    slices: int = 1
    stats_scope: str = "global"  # or "shard": statistics of each slice apart
    bm25_k1: float = K1
    bm25_b: float = B
    vector_mode: str = "exact"  # or "quantized"
    embedder: HashEmbedder = field(default_factory=HashEmbedder)
    slice_timeout_ms: int | None = None
    placement: Placement = field(default_factory=lambda: Placement(1))
    auth: Auth = field(default_factory=Auth)
    metrics: Metrics = field(default_factory=Metrics)
    name: str = "cluster"
    fault: dict[int, float | None] = field(default_factory=dict)  # for tests: seconds that a slice waits, None: it fails

    def __post_init__(self) -> None:
        self.docs = self.docs.withColumn("slice", shard_of(F.col("doc_key"), self.slices))
        scope = F.col("slice") if self.stats_scope == "shard" else None
        self.index = KeywordIndex.build(self.docs, "doc_key", searchable_text(), scope, self.bm25_k1, self.bm25_b)
        self._vectors: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    def cache(self) -> Engine:
        """Keeps documents and index at hand for repeated queries; Spark spills what memory does not hold."""
        self.docs = self.docs.persist()
        self.index = self.index.keep()
        self._vectors = self.vectors.persist()
        return self

    @property
    def vectors(self) -> DataFrame:
        """doc_key, slice, vector and, in the quantized mode, bits and correction."""
        if self._vectors is None:
            own = self.docs.select("doc_key", "slice", self.embedder.column(searchable_text()).alias("vector"))
            if self.vector_mode == "quantized":
                own = own.join(vector.quantize(own, self.embedder.dimensions).drop("vector"), "doc_key")
            self._vectors = own
        return self._vectors

    def embed(self, text: str) -> list[float]:
        return self.embedder.embed(text)

    # plans

    def _filtered(self, conditions: Sequence[Condition] | None, slice_: int | None = None) -> DataFrame | None:
        out = self.docs if slice_ is None else self.docs.where(F.col("slice") == slice_)
        return out.where(to_column(conditions)) if conditions else out if slice_ is not None else None

    def _keyword(self, query: str, conditions: Sequence[Condition] | None, slice_: int | None) -> DataFrame:
        return KeywordIndex._kept(self.index.matches(query), self._filtered(conditions, slice_))

    def _nearest(self, query: Sequence[float], k: int, conditions: Sequence[Condition] | None, slice_: int | None) -> DataFrame:
        """Filters come first, so that k results come back where there are k."""
        own = self.vectors
        if (kept := self._filtered(conditions, slice_)) is not None:
            own = own.join(kept.select("doc_key"), "doc_key", "left_semi")
        return vector.knn_quantized(own, query, k) if self.vector_mode == "quantized" else vector.knn(own, query, k)

    def _hits(self, found: DataFrame, index: str, slice_: int | None) -> list[Hit]:
        """Few rows; only now are they joined with their documents."""
        rows = {r.doc_key: r for r in found.collect()}
        if not rows:
            return []
        docs = self.docs.where(F.col("doc_key").isin(list(rows))).collect()
        out = []
        for d in docs:
            doc, r = d.asDict(recursive=True), rows[d.doc_key]
            slice_no = doc.pop("slice")
            out.append(Hit(doc, r.score, f"{self.name}/slice-{slice_no}", r["index"] if "index" in r else index, self.placement_of(d.doc_key)))
        return sorted(out, key=lambda h: (-h.score, h.key))

    def placement_of(self, key: str) -> int:
        from sparkseek.functions.hashing import fnv1a

        return fnv1a(key) % len(self.placement.vshards) if self.placement.vshards else -1

    # running slices

    def _slice(self, job, slice_: int | None, tag: str):
        self.spark.addTag(tag)
        try:
            if slice_ in self.fault:
                if self.fault[slice_] is None:
                    raise ConnectionError(f"slice {slice_} is unreachable")
                time.sleep(self.fault[slice_])
            return job(slice_)
        finally:
            self.spark.removeTag(tag)

    def _scatter(self, job) -> Iterator[tuple[int, object | None, str]]:
        """(slice, result, reason of omission) as slices end; late ones are cancelled."""
        start, tags = time.time(), {s: f"sparkseek-{threading.get_ident()}-{id(job)}-{s}" for s in range(self.slices)}
        pool = ThreadPoolExecutor(max_workers=min(16, self.slices))
        waiting: dict[Future, int] = {pool.submit(self._slice, job, s, tags[s]): s for s in range(self.slices)}
        try:
            while waiting:
                left = None if self.slice_timeout_ms is None else max(0.0, self.slice_timeout_ms / 1000 - (time.time() - start))
                done, _ = wait(waiting, left, FIRST_COMPLETED)
                if not done:
                    for s in waiting.values():
                        self.spark.interruptTag(tags[s])
                        yield s, None, "timeout"
                    return
                for f in done:
                    s = waiting.pop(f)
                    yield (s, None, "unreachable") if f.exception() else (s, f.result(), "")
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    def _merged(self, job, limit: int) -> Iterator[Result]:
        start = time.time()
        parts: dict[int, tuple[list[Hit], int]] = {}
        omitted: list[Omitted] = []

        def now(complete: bool) -> Result:
            hits, dropped = merge_hits([parts[s][0] for s in sorted(parts)], limit)
            fresh, stale = envelope(hits)
            manifest = Manifest(self.slices, len(parts), list(omitted), dropped, fresh, stale, self.placement.version, int((time.time() - start) * 1000))
            return Result(hits, sum(p[1] for p in parts.values()), manifest, complete)

        for s, part, reason in self._scatter(job):
            if reason:
                omitted.append(Omitted(f"{self.name}/slice-{s}", reason))
            else:
                parts[s] = part
                yield now(False)
        yield now(True)

    def _whole(self, job, limit: int) -> Result:
        """One plan for all slices where nothing asks for slices apart."""
        if self.slice_timeout_ms is not None or self.fault:
            *_, last = self._merged(job, limit)
            return last
        start = time.time()
        hits, total = job(None)
        fresh, stale = envelope(hits)
        return Result(hits, total, Manifest(self.slices, self.slices, [], 0, fresh, stale, self.placement.version, int((time.time() - start) * 1000)))

    # queries

    def _timed(self, run):
        start, ok = time.time(), False
        try:
            out = run()
            ok = True
            return out
        finally:
            self.metrics.record_query(int((time.time() - start) * 1000), ok)

    def _search_job(self, query: str, limit: int, conditions: Sequence[Condition] | None):
        from sparkseek.operators.keyword import top

        def job(slice_: int | None):
            if not query_terms(query):
                return [], 0
            matched = self._keyword(query, conditions, slice_)
            return self._hits(top(matched, limit), "keyword", slice_), matched.count()

        return job

    def search(self, query: str, limit: int = 10, conditions: Sequence[Condition] | None = None, token: str | None = None) -> Result:
        """BM25; limit 0 is all. A query without tokens finds nothing."""
        self.auth.require(token, "read")
        validate(conditions or ())
        return self._timed(lambda: self._whole(self._search_job(query, limit, conditions), limit))

    def search_stream(self, query: str, limit: int = 10, conditions: Sequence[Condition] | None = None, token: str | None = None) -> Iterator[Result]:
        """The merged result after each slice; the last one is complete. Candidates are cut only when they are shown."""
        self.auth.require(token, "read")
        validate(conditions or ())
        return self._merged(self._search_job(query, limit, conditions), limit)

    def vector_search(self, query: Sequence[float], k: int = vector.DEFAULT_K, conditions: Sequence[Condition] | None = None, token: str | None = None) -> Result:
        self.auth.require(token, "read")
        validate(conditions or ())
        if len(query) != self.embedder.dimensions:
            raise ValueError(f"query vector has {len(query)} dimensions, the index has {self.embedder.dimensions}")
        k = k or vector.DEFAULT_K

        def job(slice_: int | None):
            hits = self._hits(self._nearest(query, k, conditions, slice_), "vector", slice_)
            return hits, len(hits)

        return self._timed(lambda: self._whole(job, k))

    def hybrid_search(self, query: str, limit: int = 10, conditions: Sequence[Condition] | None = None, depth: int | None = None, token: str | None = None) -> Result:
        """Reciprocal rank fusion of the best ``depth`` (default: limit) of either kind."""
        self.auth.require(token, "read")
        validate(conditions or ())
        depth = depth or limit or vector.DEFAULT_K

        def run() -> Result:
            from sparkseek.operators.keyword import top

            start = time.time()
            words = top(self._keyword(query, conditions, None), depth)
            near = self._nearest(self.embed(query), depth, conditions, None)
            hits = self._hits(hybrid.fuse(words, near, limit), "both", None)
            fresh, stale = envelope(hits)
            return Result(hits, len(hits), Manifest(self.slices, self.slices, [], 0, fresh, stale, self.placement.version, int((time.time() - start) * 1000)))

        return self._timed(run)

    def matching(self, query: str, conditions: Sequence[Condition] | None = None) -> DataFrame:
        """For aggregations: all documents for a blank query, else those with any of its tokens (none has none)."""
        docs = self.docs if not query.strip() else self.docs.join(self.index.matches(query).select("doc_key"), "doc_key", "left_semi")
        return docs.where(to_column(conditions))

    def aggregate(self, kind: str = "count", field: str = "", interval: float | None = None, percentiles: Sequence[float] = (), query: str = "", conditions: Sequence[Condition] | None = None, sketch: str = "approx", token: str | None = None) -> Aggregate:
        """One of aggregate.KINDS. count is the number of matched documents, also where the field is missing."""
        self.auth.require(token, "read")
        validate(conditions or ())
        if kind not in agg.KINDS:
            raise ValueError(f"unknown aggregation kind: {kind}")
        ok, start = False, time.time()
        try:
            docs = self.matching(query, conditions)
            total = docs.count()
            buckets: dict = {}
            found: list[tuple[float, float]] = []
            if kind == "value_counts":
                buckets = {r.value: r["count"] for r in agg.value_counts(docs, Fields.count_text(field)).toLocalIterator()}
            elif kind == "time_histogram":
                buckets = {r.bucket: r["count"] for r in agg.time_histogram(docs, F.col("observed_at"), interval).toLocalIterator()}
            elif kind == "numeric_histogram":
                buckets = {r.bucket: r["count"] for r in agg.numeric_histogram(docs, Fields.number(field), interval).toLocalIterator()}
            elif kind == "geo_grid":
                buckets = {(r.lat, r.lon): r["count"] for r in agg.geo_grid(docs, F.col("latitude"), F.col("longitude"), interval).toLocalIterator()}
            elif kind == "percentiles" and percentiles:
                rows = tdigest.digest_percentiles(docs, Fields.number(field), list(percentiles)) if sketch == "tdigest" else agg.percentiles(docs, Fields.number(field), percentiles, sketch == "exact")
                found = [(r.p, r.value) for r in rows.collect()]
            ok = True
            manifest = Manifest(self.slices, self.slices, placement_version=self.placement.version, elapsed_ms=int((time.time() - start) * 1000))
            return Aggregate(kind, total, buckets, found, manifest)
        finally:
            self.metrics.record_aggregate(ok)

    # state

    def cluster_state(self, token: str | None = None) -> dict:
        self.auth.require(token, "read")
        counts = {r.slice: r["count"] for r in self.docs.groupBy("slice").count().collect()}
        nodes = [{"shard": s, "node": f"{self.name}/slice-{s}", "role": "Leader", "documents": counts.get(s, 0)} for s in range(self.slices)]
        return {"shard_count": self.slices, "nodes": nodes, "vshard_group": list(self.placement.vshards), "placement_version": self.placement.version}

    def reassign_vshard(self, vshard: int, group: int, token: str | None = None) -> int:
        """The new version of the placement."""
        self.auth.require(token, "operator")
        self.placement = self.placement.reassign(vshard, group)
        return self.placement.version

    def dashboard_snapshot(self) -> dict:
        """Panels as plain data, version 1."""
        rank = lambda b: sorted(b.items(), key=lambda x: (-x[1], x[0]))[:8]
        state = self.cluster_state()
        histogram = self.aggregate("numeric_histogram", "altitude", 2000.0).buckets
        return {
            "v": 1,
            "shard_count": state["shard_count"],
            "vshard_group": state["vshard_group"],
            "nodes": state["nodes"],
            "query": {"ok": self.metrics.queries - self.metrics.query_errors, "err": self.metrics.query_errors},
            "aggregate": {
                "by_origin": [{"origin": k, "count": v} for k, v in rank(self.aggregate("value_counts", "origin").buckets)],
                "by_aircraft": [{"aircraft_type": k, "count": v} for k, v in rank(self.aggregate("value_counts", "aircraft_type").buckets)],
                "geo_cells": [{"lat": a, "lon": b, "count": v} for (a, b), v in self.aggregate("geo_grid", interval=10.0).buckets.items()],
                "altitude_hist": [{"bucket": k, "count": v} for k, v in sorted(histogram.items())],
                "altitude_pcts": [{"p": p, "value": v} for p, v in self.aggregate("percentiles", "altitude", percentiles=[50, 90, 99]).percentiles],
            },
        }
