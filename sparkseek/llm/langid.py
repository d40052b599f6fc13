"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle, 1994).

A text's profile is its most frequent letter n-grams of 1 to 3 letters, words padded by one blank on either
side, in order of count. A language's profile is the same over all its training texts. The distance of a text
from a language is the sum over the text's n-grams of how far their ranks differ, or the profile's length
where the language lacks the n-gram; the nearest language wins, of equal ones the first by code point.

Counts go over every training document: tasks count n-grams by language and batch, Spark adds them up. The
profiles that are sent to all tasks have PROFILE rows a language at most.

Defined cases: ``und`` with score 0 for a null text, one without letters, or when no language was learned. A null
language or text does not train. Texts of any length are read whole; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkseek.llm.common import ship

PROFILE = 300
UNKNOWN = "und"
_BITS = 21  # of a code point
_BLANK = 1  # no letter, and not 0, so that "a" and " a" have different codes


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point itself if it is a letter, else 0."""
    return np.array([i if chr(i).isalpha() else 0 for i in range(0x110000)], np.int64)


def ngrams(text: str) -> np.ndarray:
    """Codes of all n-grams of the text, with repeats; empty if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.concatenate(([0], _letters()[points], [0]))
    c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]  # one blank between words
    if len(c) < 3:
        return np.zeros(0, np.int64)
    letter = c != 0
    c = np.where(letter, c, _BLANK)
    two = (c[:-1] << _BITS) | c[1:]
    three = (two[:-1] << _BITS) | c[2:]
    return np.concatenate((c[letter], two, three[letter[1:-1]]))


def _most(codes: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The size most frequent codes, by falling count, then by code."""
    return codes[np.lexsort((codes, -n))[:size]]


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """Profiles: lang, code, rank (from 0)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(ngrams(text))
            for lang, codes in by.items():
                for i in range(0, len(codes), 1000):  # bounds the codes in memory
                    own, n = np.unique(np.concatenate(codes[i : i + 1000]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own, pa.int64()), pa.array(n, pa.int64())], names=["lang", "code", "n"])

    ship(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = known.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # the most frequent of each of 16 parts first, then of what they leave: no language's n-grams all meet in one task
    part = F.pmod(F.xxhash64("code"), F.lit(16))
    first = Window.partitionBy("lang", "part").orderBy(F.desc("n"), "code")
    counts = counts.withColumn("part", part).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= size)
    last = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    return counts.withColumn("rank", F.row_number().over(last) - 1).where(F.col("rank") < size).select("lang", "code", "rank")


class Profiles:
    """Profiles as arrays, to be sent to tasks."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.size, self.langs = size, sorted({r[0] for r in rows})
        self.codes, self.ranks = [], []
        for lang in self.langs:
            own = sorted((code, rank) for of, code, rank in rows if of == lang)
            self.codes.append(np.array([c for c, _ in own], np.int64))
            self.ranks.append(np.array([r for _, r in own], np.int64))

    def distances(self, text: str) -> tuple[np.ndarray, int] | None:
        """The distance from each language and the largest possible one; None for a text without letters."""
        codes, n = np.unique(ngrams(text), return_counts=True)
        if not len(codes):
            return None
        top = _most(codes, n, self.size)
        rank, out = np.arange(len(top)), []
        for codes, ranks in zip(self.codes, self.ranks, strict=True):
            at = np.minimum(np.searchsorted(codes, top), len(codes) - 1)
            out.append(int(np.where(codes[at] == top, np.abs(ranks[at] - rank), self.size).sum()))
        return np.array(out), self.size * len(top)

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs or (found := self.distances(text)) is None:
            return UNKNOWN, 0.0
        best = int(np.argmin(found[0]))
        return self.langs[best], 1 - float(found[0][best]) / found[1]


def identify(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """One row for each document: id, lang_pred, score (1: the profile itself, 0: nothing in common)."""
    ship(docs.sparkSession)
    own = docs.sparkSession.sparkContext.broadcast(Profiles([tuple(r) for r in profiles.select("lang", "code", "rank").collect()], size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [own.value.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["id", "lang_pred", "score"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
