"""A mergeable sketch of quantiles: Dunning's t-digest with the arcsine scale."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseek.shipping import ship

DELTA = 100.0


class TDigest:
    """Centroids (mean, weight). Finite samples only; a buffer is compressed once it is ten times delta long."""

    def __init__(self, delta: float = DELTA):
        self.delta, self.centroids, self.buffer = delta, [], []

    @classmethod
    def of(cls, means: Iterable[float], weights: Iterable[float], delta: float = DELTA) -> TDigest:
        out = cls(delta)
        out.centroids = sorted((float(m), float(w)) for m, w in zip(means, weights, strict=True))
        return out

    def add(self, x: float, weight: float = 1.0) -> None:
        if math.isfinite(x):
            self.buffer.append((float(x), float(weight)))
            if len(self.buffer) >= 10 * self.delta:
                self.compress()

    def add_all(self, values: np.ndarray) -> None:
        """The finite ones of many samples of weight one. Each slice is sorted and joined into centroids by whole runs, of which each ends where the scale has grown by one."""
        values = np.sort(values[np.isfinite(values)])
        n = len(values)
        if not n:
            return
        sums = np.concatenate(([0.0], np.cumsum(values - values[0])))  # from the least, so that large offsets lose no digits
        start = 0
        while start < n:
            grown = self._k(start / n) + 1
            reach = n if grown >= self.delta / 4 else int(n * (math.sin(grown * 2 * math.pi / self.delta) + 1) / 2)
            stop = min(n, max(start + 1, reach))
            self.buffer.append((float(values[0] + (sums[stop] - sums[start]) / (stop - start)), float(stop - start)))
            start = stop
        self.compress()

    def merge(self, other: TDigest) -> TDigest:
        self.buffer += other.centroids + other.buffer
        self.compress()
        return self

    def _k(self, q: float) -> float:
        return self.delta / (2 * math.pi) * math.asin(min(1.0, max(-1.0, 2 * q - 1)))

    def compress(self) -> None:
        """Neighbours are joined while the scale grows by at most one over the joint centroid."""
        points, self.buffer = sorted(self.centroids + self.buffer), []
        total = sum(w for _, w in points)
        out: list[list[float]] = []
        done = 0.0
        for mean, weight in points:
            if out:
                joint = out[-1][1] + weight
                if self._k((done + joint) / total) - self._k(done / total) <= 1:
                    out[-1][0] += (mean - out[-1][0]) * weight / joint
                    out[-1][1] = joint
                    continue
                done += out[-1][1]
            out.append([mean, weight])
        self.centroids = [(m, w) for m, w in out]

    @property
    def count(self) -> float:
        return sum(w for _, w in self.centroids) + sum(w for _, w in self.buffer)

    def quantile(self, q: float) -> float:
        """Interpolated between the centres of neighbouring centroids; NaN without samples."""
        if self.buffer:
            self.compress()
        if not self.centroids:
            return math.nan
        target = min(1.0, max(0.0, q)) * self.count
        done, last = 0.0, None
        for mean, weight in self.centroids:
            centre = done + weight / 2
            if target <= centre:
                if last is None:
                    return mean
                return last[1] + (mean - last[1]) * (target - last[0]) / (centre - last[0])
            last, done = (centre, mean), done + weight
        return self.centroids[-1][0]


def digest(docs: DataFrame, value: Column, parts: int = 32, delta: float = DELTA) -> DataFrame:
    """One row with means and weights. Each task sketches its rows; ``parts`` sketches merge before the last one, so its input is bounded by the number of parts."""
    schema = "means array<double>, weights array<double>"

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = TDigest(delta)
        for b in batches:
            own.add_all(b["v"].to_numpy(np.float64))
        if own.centroids:
            yield pd.DataFrame({"means": [[m for m, _ in own.centroids]], "weights": [[w for _, w in own.centroids]]})

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = TDigest(delta)
        for means, weights in zip(rows["means"], rows["weights"], strict=True):
            own.merge(TDigest.of(means, weights, delta))
        return pd.DataFrame({"means": [[m for m, _ in own.centroids]], "weights": [[w for _, w in own.centroids]]})

    ship(docs.sparkSession)
    sketches = docs.select(value.cast("double").alias("v")).mapInPandas(sketch, schema)
    some = sketches.groupBy(F.pmod(F.xxhash64("means", "weights"), F.lit(parts)).alias("part")).applyInPandas(merge, schema)
    return some.groupBy(F.lit(0).alias("part")).applyInPandas(merge, schema)


def digest_percentiles(docs: DataFrame, value: Column, percents: list[float]) -> DataFrame:
    """p, value by a t-digest; no rows without samples."""

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for means, weights in zip(b["means"], b["weights"], strict=True):
                own = TDigest.of(means, weights)
                yield pd.DataFrame({"p": [float(p) for p in percents], "value": [own.quantile(p / 100) for p in percents]})

    return digest(docs, value).mapInPandas(resolve, "p double, value double")
