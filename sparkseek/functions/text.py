"""Tokens: runs of Unicode letters and numbers, lower-cased. The same rule as a column and in Python."""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

_GAP = r"[^\p{IsAlphabetic}\p{N}]+"
_PY_GAP = regex.compile(r"[^\p{Alphabetic}\p{N}]+")


def tokens(text: Column) -> Column:
    """All tokens of a text, with repeats; none for a null text."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), _GAP), lambda t: t != "")
    return F.transform(parts, F.lower)


def tokenize(text: str) -> list[str]:
    return [t.lower() for t in _PY_GAP.split(text) if t]


def query_terms(query: str) -> list[str]:
    """A query's distinct terms in order: a repeated term counts once."""
    return list(dict.fromkeys(tokenize(query)))


def ascii_lower(c: Column) -> Column:
    """A-Z only, so that equality tests keep É and é apart."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
