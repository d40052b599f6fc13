"""Vectors as arrays: products, sign bits, and the hashing embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sparkseek.shipping import ship

DIMENSIONS = 128


def dot(a: Column, b: Column) -> Column:
    """Inner product, added up in order, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    size = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(0.0))


def sign_bits(v: Column, dimensions: int) -> Column:
    """array<bigint>: bit i of word i / 64 is set if element i is positive."""

    def word(w: int) -> Column:
        part = F.slice(v, 64 * w + 1, 64)
        bits = F.transform(part, lambda x, i: F.when(x > 0, F.expr("1L").cast("long")).otherwise(F.lit(0).cast("long")))
        placed = F.zip_with(bits, F.array(*(F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64))), lambda b, p: F.when(b == 1, p).otherwise(F.lit(0).cast("long")))
        return F.aggregate(placed, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.coalesce(x, F.lit(0).cast("long"))))

    return F.array(*(word(w) for w in range(-(-dimensions // 64))))


def correction(v: Column) -> Column:
    """The mean absolute element: the length of a sign."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x).cast("double")) / F.size(v)


def hamming(a: Column, b: Column) -> Column:
    """How many bits differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def quantized_bytes(bits: Column) -> Column:
    """What a quantized vector takes: its words and one 32-bit correction."""
    return F.size(bits) * 8 + 4


def hash_embed_array(text: str | None, cache: dict[str, tuple[int, float]] | None = None) -> np.ndarray:
    """Each token adds +1 or -1, by its hash's highest bit, to one of DIMENSIONS places; then unit length."""
    from sparkseek.functions.hashing import fnv1a
    from sparkseek.functions.text import tokenize

    cache = {} if cache is None else cache
    out = np.zeros(DIMENSIONS, np.float64)
    for t in tokenize(text or ""):
        at = cache.get(t)
        if at is None:
            h = fnv1a(t)
            at = cache[t] = (h % DIMENSIONS, 1.0 if h >> 63 else -1.0)
        out[at[0]] += at[1]
    size = np.sqrt((out * out).sum())
    return (out / size if size > 0 else out).astype(np.float32)


def hash_embed() -> Callable[[Column], Column]:
    """The embedder as a column function over Arrow batches; hashes of tokens are kept for the task."""

    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, tuple[int, float]] = {}
        for texts in parts:
            if len(cache) > 500_000:
                cache.clear()
            yield pd.Series([hash_embed_array(t, cache) for t in texts])

    return embed


class HashEmbedder:
    """The default embedder. Another one needs the same three members: a length, one text's vector, and a column function."""

    dimensions = DIMENSIONS

    def embed(self, text: str) -> list[float]:
        return [float(x) for x in hash_embed_array(text)]

    def column(self, text: Column) -> Column:
        return hash_embed()(text)


def topk_dot(query: np.ndarray, k: int, key: str, vector: str) -> Callable[[Iterator], Iterator]:
    """For mapInArrow: each batch's k best rows by inner product, by one matrix product."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.schema.get_field_index(vector))
            matrix = np.asarray(column.flatten(), np.float64).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, len(query)))
            score = matrix @ query
            keys = b.column(b.schema.get_field_index(key))
            if len(score) > k > 0:
                least = np.partition(score, len(score) - k)[len(score) - k]
                keep = np.flatnonzero(score >= least - 1e-9)  # ties are settled by key later
            else:
                keep = np.arange(len(score))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(keep)), pa.array(score[keep])], names=[key, "score"])

    return run
