"""Structured filters: an AND of text equality, numeric ranges and flags, checked before any plan is made."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkseek.functions.text import ascii_lower
from sparkseek.plans.schema import Fields


@dataclass(frozen=True)
class Equals:
    """Equal but for the case of A-Z."""

    field: str
    value: str


@dataclass(frozen=True)
class Range:
    """Inclusive; either end may be open. A missing number is in no bounded range."""

    field: str
    min: float | None = None
    max: float | None = None


@dataclass(frozen=True)
class Is:
    field: str
    value: bool


Condition = Equals | Range | Is


def validate(conditions: Sequence[Condition]) -> None:
    """ValueError for a built-in field of another type, or an empty range. Unknown names are generic fields."""
    for c in conditions:
        if not isinstance(c, Equals | Range | Is):
            raise ValueError(f"filter on {getattr(c, 'field', c)!r} has no test")
        text, number, flag = c.field in Fields.FILTER_TEXT, c.field in Fields.FILTER_NUMBER, c.field in Fields.BOOLEAN
        if isinstance(c, Equals) and (number or flag):
            raise ValueError(f"field {c.field!r} is not a text field")
        if isinstance(c, Range):
            if text or flag:
                raise ValueError(f"field {c.field!r} is not a numeric field")
            if c.min is not None and c.max is not None and c.min > c.max:
                raise ValueError(f"range on {c.field!r}: min {c.min} is above max {c.max}")
        if isinstance(c, Is) and not flag:
            raise ValueError(f"field {c.field!r} is not a boolean field")


def _column(c: Condition) -> Column:
    if isinstance(c, Equals):
        folded = c.value.translate({i: i + 32 for i in range(65, 91)})
        return ascii_lower(Fields.filter_text(c.field)) == folded
    if isinstance(c, Is):
        return F.col(c.field) == F.lit(c.value)
    value = Fields.number(c.field)
    tests = [value >= float(c.min)] if c.min is not None else []
    tests += [value <= float(c.max)] if c.max is not None else []
    if not tests:
        return F.lit(True)
    if c.field in Fields.FILTER_NUMBER:  # never null; a test that Parquet can evaluate
        present = F.lit(True) if c.field == "observed_at" else ~F.isnan(value)
        return reduce(lambda a, b: a & b, tests) & present
    # Spark orders NaN above all numbers
    return F.coalesce(reduce(lambda a, b: a & b, tests) & ~F.isnan(value), F.lit(False))


def to_column(conditions: Sequence[Condition] | None) -> Column:
    """The predicate; no conditions pass everything."""
    conditions = list(conditions or ())
    validate(conditions)
    return reduce(lambda a, b: a & b, map(_column, conditions), F.lit(True)) if conditions else F.lit(True)


def matches(conditions: Sequence[Condition] | None, doc: dict) -> bool:
    """The same for one document as a dict."""
    conditions = list(conditions or ())
    validate(conditions)
    fold = lambda s: s.translate({i: i + 32 for i in range(65, 91)})
    for c in conditions:
        if isinstance(c, Equals):
            own = doc.get(c.field, "") if c.field in Fields.FILTER_TEXT else doc.get("text", {}).get(c.field, "")
            ok = fold(own) == fold(c.value)
        elif isinstance(c, Is):
            ok = bool(doc.get(c.field, False)) == c.value
        else:
            own = float(doc.get(c.field, 0.0)) if c.field in Fields.FILTER_NUMBER else doc.get("number", {}).get(c.field, math.nan)
            ok = (c.min is None or own >= c.min) and (c.max is None or own <= c.max)
        if not ok:
            return False
    return True


def parse_args(args: Sequence[str]) -> list[Condition]:
    """``field=value``, ``field=low..high`` (either may be empty), ``field=true|false``."""
    out: list[Condition] = []
    for arg in args:
        field, sign, value = arg.partition("=")
        if not sign:
            raise ValueError(f"filter {arg!r} must look like field=value or field=low..high")
        low, dots, high = value.partition("..")
        if dots:
            try:
                out.append(Range(field, float(low) if low else None, float(high) if high else None))
            except ValueError:
                raise ValueError(f"no number in {arg!r}") from None
        elif value in ("true", "false"):
            out.append(Is(field, value == "true"))
        else:
            out.append(Equals(field, value))
    return out


def parse_json(items: str | Sequence[dict] | None) -> list[Condition]:
    """Objects with a field and one of: equals, min and max, is."""
    items = json.loads(items) if isinstance(items, str) else items
    out: list[Condition] = []
    for item in items or ():
        field = item.get("field")
        if not isinstance(field, str):
            raise ValueError("each filter needs a 'field'")
        if isinstance(item.get("equals"), str):
            out.append(Equals(field, item["equals"]))
        elif "min" in item or "max" in item:
            ends = [float(v) if isinstance(v := item.get(k), int | float) and not isinstance(v, bool) else None for k in ("min", "max")]
            out.append(Range(field, *ends))
        elif isinstance(item.get("is"), bool):
            out.append(Is(field, item["is"]))
        else:
            raise ValueError(f"filter on {field!r} needs 'equals', 'min'/'max', or 'is'")
    return out
