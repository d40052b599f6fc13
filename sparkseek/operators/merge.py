"""Merging hits of several slices: freshest document first, then score and key, with a manifest of what was asked."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Omitted:
    address: str
    reason: str  # timeout or unreachable


@dataclass
class Manifest:
    """What a stranger needs to judge a result: coverage, omissions, duplicates, freshness, placement."""

    slices_queried: int = 1
    slices_answered: int = 1
    omitted: list[Omitted] = field(default_factory=list)
    deduped: int = 0
    freshest_observed_at: int = 0
    stalest_observed_at: int = 0
    placement_version: int = 0
    elapsed_ms: int = 0

    def summary(self, now_ms: int | None = None) -> str:
        parts = [f"answered {self.slices_answered}/{self.slices_queried} shards"]
        if self.omitted:
            parts.append("omitted: " + ", ".join(f"{o.address} ({o.reason})" for o in self.omitted))
        if self.deduped:
            parts.append(f"{self.deduped} cross-shard duplicates dropped")
        if self.freshest_observed_at > 0:
            now = int(time.time() * 1000) if now_ms is None else now_ms
            parts.append(f"freshest {max(0, now - self.freshest_observed_at) // 1000}s old")
        return " · ".join([*parts, f"placement v{self.placement_version}", f"{self.elapsed_ms}ms"])


@dataclass
class Hit:
    """One result with where it came from."""

    doc: dict
    score: float
    source_group: str = "slice-0"
    index: str = "keyword"
    vshard: int = -1

    @property
    def key(self) -> str:
        return self.doc.get("doc_key", "")

    @property
    def observed_at(self) -> int:
        return int(self.doc.get("observed_at", 0))


def freshest(rows: DataFrame, key: str, observed_at: str, score: str, tie: str) -> DataFrame:
    """One row for each key: the latest, then the best scored, then the least ``tie``."""
    rank = F.struct(F.col(observed_at), F.col(score), -F.col(tie))
    return rows.groupBy(key).agg(F.max_by(F.struct(*(F.col(c) for c in rows.columns if c != key)), rank).alias("_r")).select(key, "_r.*")


def freshness(hits: DataFrame, observed_at: str = "observed_at") -> DataFrame:
    """freshest, stalest of positive times, 0 without any."""
    positive = F.when(F.col(observed_at) > 0, F.col(observed_at))
    return hits.agg(F.coalesce(F.max(positive), F.lit(0)).alias("freshest"), F.coalesce(F.min(positive), F.lit(0)).alias("stalest"))


def merge_hits(parts: list[list[Hit]], limit: int) -> tuple[list[Hit], int]:
    """The merged top hits (limit 0: all) and how many duplicates were dropped. Of equal keys the freshest stays, then the best, then the first slice's."""
    best: dict[str, Hit] = {}
    dropped = 0
    for part in parts:
        for h in part:
            known = best.get(h.key)
            if known is None:
                best[h.key] = h
                continue
            dropped += 1
            if (h.observed_at, h.score) > (known.observed_at, known.score):
                best[h.key] = h
    out = sorted(best.values(), key=lambda h: (-h.score, h.key))
    return (out[:limit] if limit else out), dropped


def envelope(hits: list[Hit]) -> tuple[int, int]:
    times = [h.observed_at for h in hits if h.observed_at > 0]
    return (max(times), min(times)) if times else (0, 0)
