"""Read-only tools for agents: definitions, calls, and results as text."""

from __future__ import annotations

import json
import math

from sparkseek.operators.aggregate import KINDS
from sparkseek.plans.filters import parse_json
from sparkseek.services.engine import Aggregate, Engine, Result

#: Bounds on results, the tools' names, and the lines of their output.
DEFAULT_LIMIT, MAX_LIMIT, MAX_BUCKETS = 5, 50, 25
SEARCH, SEMANTIC, HYBRID, STATE, AGGREGATE = "search_flights", "semantic_search_flights", "hybrid_search_flights", "cluster_state", "aggregate_flights"
MATCHED_LINE = "{} matched across {}/{} shards"
HIT_LINE = "- {} {} ({} -> {}) {} score={:.3f} [via {}{}]"
PROVENANCE_LINE = "\n\nprovenance: {}\n"


class ToolError(Exception):
    """An error that the caller of a tool can read and mend."""


def _tool(name: str, text: str, properties: dict, required: tuple[str, ...] = ()) -> dict:
    schema: dict = {"type": "object", "properties": properties}
    return {"name": name, "description": text, "inputSchema": schema | ({"required": list(required)} if required else {})}


def definitions() -> list[dict]:
    query = {"type": "string", "description": "words to look for"}
    limit = {"type": "integer", "minimum": 1, "maximum": MAX_LIMIT, "description": f"results at most (default {DEFAULT_LIMIT})"}
    filters = {"type": "array", "items": {"type": "object"}, "description": "conditions that all must hold: {field, equals}, {field, min?, max?} or {field, is}"}
    search = {"query": query, "limit": limit, "filters": filters}
    summary = {
        "kind": {"type": "string", "enum": list(KINDS), "description": "which summary"},
        "query": {"type": "string", "description": "words that documents must match; empty for all"},
        "field": {"type": "string", "description": "field of value_counts, numeric_histogram or percentiles"},
        "interval": {"type": "number", "description": "bucket width: milliseconds, units or degrees"},
        "percentiles": {"type": "array", "items": {"type": "number"}, "description": "such as [50, 95, 99]"},
        "filters": filters,
    }
    return [
        _tool(SEARCH, "Finds single records by keywords. For counts and breakdowns use aggregate_flights.", search, ("query",)),
        _tool(SEMANTIC, "Finds records by the meaning of a text.", search, ("query",)),
        _tool(HYBRID, "Finds records by keywords and by meaning, and fuses both rankings.", search, ("query",)),
        _tool(STATE, "Shards and placement, as the engine sees them.", {}),
        _tool(AGGREGATE, "Counts, breakdowns, histograms and percentiles over all matching records.", summary, ("kind",)),
    ]


def format_hits(result: Result) -> str:
    m = result.manifest
    lines = [MATCHED_LINE.format(result.total_matched, m.slices_answered, m.slices_queried)]
    for h in result.hits:
        d = h.doc
        how = f" {h.index}" if h.index in ("keyword", "vector") else ""
        place = (d.get(f, "") for f in ("callsign", "origin", "destination", "aircraft_type"))
        lines.append(HIT_LINE.format(h.key, *place, h.score, h.source_group, how))
    return "\n".join(lines) + PROVENANCE_LINE.format(m.summary())


def label(key) -> str:
    """A bucket's name: numbers without needless decimals or exponents."""
    if isinstance(key, tuple):
        return ",".join(map(label, key))
    if isinstance(key, float):
        return str(int(key)) if math.isfinite(key) and key == int(key) else repr(key)
    return str(key)


def format_aggregate(a: Aggregate) -> str:
    if a.kind == "count":
        lines = [f"count: {a.count}"]
    elif a.kind == "percentiles":
        lines = [f"p{label(float(p))}: {v:.2f}" for p, v in a.percentiles]
    else:
        named = sorted(((label(k), v) for k, v in a.buckets.items()), key=lambda x: (-x[1], x[0]))
        lines = [f"{k}: {v}" for k, v in named[:MAX_BUCKETS]] + [f"({a.count} matched)"]
    return "\n".join(lines) + PROVENANCE_LINE.format(a.manifest.summary())


def format_state(state: dict) -> str:
    lines = [f"{state['shard_count']} shard group(s)"]
    lines += [f"- shard {n['shard']} · {n['node']} · {n['role']}" for n in state["nodes"]]
    if state["vshard_group"]:
        lines.append(f"virtual shards -> groups: {state['vshard_group']}")
    return "\n".join(lines) + "\n"


class Tools:
    def __init__(self, engine: Engine, token: str | None = None):
        self.engine, self.token = engine, token

    def call(self, name: str, args: dict | None = None) -> str:
        args = args or {}
        try:
            return self._call(name, args)
        except ToolError:
            raise
        except Exception as e:
            raise ToolError(str(e)) from e

    def _call(self, name: str, args: dict) -> str:
        run = {SEARCH: self._search, SEMANTIC: self._search, HYBRID: self._search, AGGREGATE: self._aggregate, STATE: self._state}.get(name)
        if run is None:
            raise ToolError(f"there is no tool named {name}")
        return run(name, args)

    def _search(self, name: str, args: dict) -> str:
        query, limit = args.get("query"), args.get("limit")
        if not isinstance(query, str):
            raise ToolError(f"{name} needs the argument query, a text")
        limit = min(MAX_LIMIT, max(1, limit)) if isinstance(limit, int) and not isinstance(limit, bool) else DEFAULT_LIMIT
        of = {SEARCH: self.engine.search, SEMANTIC: lambda q, *more, **by: self.engine.vector_search(self.engine.embed(q), *more, **by), HYBRID: self.engine.hybrid_search}
        return format_hits(of[name](query, limit, parse_json(args.get("filters")), token=self.token))

    def _aggregate(self, name: str, args: dict) -> str:
        kind = args.get("kind", "count")
        if kind not in KINDS:
            raise ToolError(f"{name} has no kind {kind}; it has {', '.join(KINDS)}")
        numbers = [float(p) for p in args.get("percentiles") or () if isinstance(p, int | float)]
        found = self.engine.aggregate(kind, args.get("field", ""), args.get("interval"), numbers, args.get("query", ""), parse_json(args.get("filters")), token=self.token)
        return format_aggregate(found)

    def _state(self, name: str, args: dict) -> str:
        return format_state(self.engine.cluster_state(self.token))

    def definitions_json(self) -> str:
        return json.dumps(definitions())
