"""A governed memory: entries by namespace, with a quota for each writer, a time to live and attribution."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkseek.functions.text import tokenize, tokens


class QuotaExceeded(Exception):
    pass


class Malformed(Exception):
    pass


@dataclass
class Entry:
    id: int
    namespace: str
    text: str
    writer: str
    created_ms: int
    ttl_secs: int = 0

    def expired(self, now_ms: int) -> bool:
        return self.ttl_secs != 0 and now_ms >= self.created_ms + self.ttl_secs * 1000


class MemoryStore:
    """The service: one writer at a time, ids in order; refused writes take no id."""

    def __init__(self, quota_per_writer: int):
        self.quota, self.next_id, self.by_namespace = quota_per_writer, 0, {}

    def remember(self, namespace: str, text: str, writer: str, ttl_secs: int, now_ms: int) -> int:
        for value, name in ((namespace, "namespace"), (text, "text"), (writer, "writer attribution")):
            if not value.strip():
                raise Malformed(f"{name} is required")
        self._sweep(namespace, now_ms)  # first, so that what has expired frees quota
        own = self.by_namespace.get(namespace, [])
        if sum(e.writer == writer for e in own) >= self.quota:
            raise QuotaExceeded(f"{writer} holds {self.quota} entries")
        entry = Entry(self.next_id, namespace, text, writer, now_ms, ttl_secs)
        self.next_id += 1
        self.by_namespace.setdefault(namespace, []).append(entry)
        return entry.id

    def recall(self, namespace: str, query: str, limit: int, now_ms: int) -> list[Entry]:
        """By tokens of the query that the entry has (all entries for none), then freshest, then id; limit 0 is all."""
        terms = tokenize(query)
        found = []
        for e in self.by_namespace.get(namespace, []):
            own = set(tokenize(e.text))
            overlap = sum(t in own for t in terms)
            if not e.expired(now_ms) and (overlap or not terms):
                found.append((-overlap, -e.created_ms, e.id, e))
        out = [f[3] for f in sorted(found, key=lambda f: f[:3])]
        return out[:limit] if limit else out

    def _sweep(self, namespace: str, now_ms: int) -> int:
        own = self.by_namespace.get(namespace, [])
        live = [e for e in own if not e.expired(now_ms)]
        self.by_namespace[namespace] = live
        return len(own) - len(live)

    def sweep(self, now_ms: int) -> int:
        return sum(self._sweep(n, now_ms) for n in list(self.by_namespace))

    def count(self, namespace: str, now_ms: int) -> int:
        return sum(not e.expired(now_ms) for e in self.by_namespace.get(namespace, []))


# the same over a table (id, namespace, text, writer, created_ms, ttl_secs)


def live(entries: DataFrame, now_ms: int) -> DataFrame:
    """Without what has expired."""
    ends = F.col("created_ms") + F.col("ttl_secs") * 1000
    return entries.where((F.col("ttl_secs") == 0) | (ends > now_ms))


def recalled(entries: DataFrame, query: str, now_ms: int, namespace: Column | str | None = None, limit: int = 0) -> DataFrame:
    """Entries of a namespace (or of each) with overlap, in order; limit is for each namespace."""
    terms = tokenize(query)
    own = live(entries, now_ms)
    own = own if namespace is None else own.where(F.col("namespace") == namespace)
    overlap = sum((F.array_contains(F.col("_tokens"), t).cast("int") for t in terms), F.lit(0))
    own = own.withColumn("_tokens", tokens(F.col("text"))).withColumn("overlap", overlap).drop("_tokens")
    own = own.where(F.col("overlap") > 0) if terms else own
    order = Window.partitionBy("namespace").orderBy(F.desc("overlap"), F.desc("created_ms"), "id")
    out = own.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= limit) if limit else out


def admitted(entries: DataFrame, quota: int) -> DataFrame:
    """Of entries that never expire, those that the quota lets in, in order of id."""
    order = Window.partitionBy("namespace", "writer").orderBy("id")
    return entries.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= quota).drop("_n")
