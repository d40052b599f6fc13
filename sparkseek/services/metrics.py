"""Counters and a latency histogram in the Prometheus text format."""

from __future__ import annotations

import threading

BOUNDS_MS = (1, 5, 10, 50, 100, 500)


class Metrics:
    def __init__(self) -> None:
        self._lock = threading.Lock()
        self.queries = self.query_errors = self.aggregates = self.aggregate_errors = self.latency_sum = 0
        self.buckets = [0] * len(BOUNDS_MS)

    def record_query(self, elapsed_ms: int, ok: bool = True) -> None:
        with self._lock:
            self.queries += 1
            self.query_errors += not ok
            self.latency_sum += elapsed_ms
            for i, bound in enumerate(BOUNDS_MS):
                self.buckets[i] += elapsed_ms <= bound

    def record_aggregate(self, ok: bool = True) -> None:
        with self._lock:
            self.aggregates += 1
            self.aggregate_errors += not ok

    def render(self, slices: int = 1) -> str:
        counters = [
            ("queries_total", "Search queries handled.", self.queries),
            ("query_errors_total", "Search queries that failed.", self.query_errors),
            ("aggregates_total", "Aggregate queries handled.", self.aggregates),
            ("aggregate_errors_total", "Aggregate queries that failed.", self.aggregate_errors),
        ]
        out = []
        for name, text, value in counters:
            out += [f"# HELP sparkseek_{name} {text}", f"# TYPE sparkseek_{name} counter", f"sparkseek_{name} {value}"]
        name = "sparkseek_query_latency_ms"
        out += [f"# HELP {name} Search latency in milliseconds.", f"# TYPE {name} histogram"]
        out += [f'{name}_bucket{{le="{b}"}} {n}' for b, n in zip(BOUNDS_MS, self.buckets, strict=True)]
        out += [f'{name}_bucket{{le="+Inf"}} {self.queries}', f"{name}_sum {self.latency_sum}", f"{name}_count {self.queries}"]
        out += ["# HELP sparkseek_slices Slices of the collection.", "# TYPE sparkseek_slices gauge", f"sparkseek_slices {slices}"]
        return "\n".join(out) + "\n"
