"""Search over several independent engines, each of which counts as one slice."""

from __future__ import annotations

import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor, wait

from sparkseek.operators.merge import Manifest, Omitted, envelope, merge_hits
from sparkseek.plans.filters import Condition
from sparkseek.services.engine import Engine, Result

TIMEOUT_MS = 3000


def federated_search(engines: Sequence[Engine], query: str, limit: int = 10, conditions: Sequence[Condition] | None = None, timeout_ms: int | None = TIMEOUT_MS) -> Result:
    """Merged hits; an engine that fails or is late is named in the manifest. Placement versions of different clusters mean nothing together: 0."""
    start = time.time()
    pool = ThreadPoolExecutor(max_workers=max(1, len(engines)))
    jobs = [pool.submit(e.search, query, limit, conditions) for e in engines]
    wait(jobs, None if timeout_ms is None else timeout_ms / 1000)
    pool.shutdown(wait=False, cancel_futures=True)
    parts, omitted, total = [], [], 0
    for engine, job in zip(engines, jobs, strict=True):
        if not job.done():
            omitted.append(Omitted(engine.name, "timeout"))
        elif job.exception() or not job.result().manifest.slices_answered:
            omitted.append(Omitted(engine.name, "unreachable"))
        else:
            parts.append(job.result().hits)
            total += job.result().total_matched
    hits, dropped = merge_hits(parts, limit)
    fresh, stale = envelope(hits)
    return Result(hits, total, Manifest(len(engines), len(parts), omitted, dropped, fresh, stale, 0, int((time.time() - start) * 1000)))
