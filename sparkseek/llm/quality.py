"""Quality by co-training: a classifier of text content and one of page metadata teach each other.

Blum and Mitchell, "Combining labeled and unlabeled data with co-training" (1998). Each view starts from the
labelled documents. In every round each view scores all unlabelled documents and hands those of which it is
surest, a twentieth (``SHARE``) as many as there are labels and in their ratio, to the other view as training rows; a view that is sure of none hands over none.
Each view's score is then calibrated on labelled rows that trained neither (Platt scaling), and the calibrated log odds
of both views are added, less the prior that both contain. All documents are scored in one pass over the data, without a
shuffle.

At most ``MAX_LABELLED`` labelled documents, those with the least hash of their id, are used for the fit: a bounded sample
of the labels. The unlabelled documents are not sampled: their features are computed once and kept in the
checkpoint folder, every round reads them all, each task finds its surest rows, and of these the surest of all are taken.

Text view: hashed words and character trigrams; the share of each ASCII digit and symbol, of upper-case letters among
letters, of the commonest word, of words that repeat the one before and that start with no letter; the mean word length,
how fast distinct words grow, repeated lines. Metadata view: language and source by hash, and the length that the row states.

Defined cases: a null text is scored as an empty one; null metadata, or a missing column of it, is a value of its own; null
labels do not train; of several labels of one document the mean counts (a half is no label); of rows that share a labelled id
the one whose text has the least hash trains. With labels of one class, or none, all documents are kept and the score
is 1. Null ids are scored like others, and take part as unlabelled rows. An empty table gives no rows. Other columns of
docs and labels are carried along or ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.llm.common import durable, ship
from sparkseek.llm.textscan import mixed, scan, slices

MAX_LABELLED = 10_000
#: Rounds, how many rows a view hands over in one, as a share of the labelled rows, and the calibrated probability that it needs.
ROUNDS, SHARE, SURE = 5, 0.05, 0.95
#: Documents whose calibrated probability of being good is below this go.
THRESHOLD = 0.5
LANG_SLOTS, SOURCE_SLOTS = 32, 256
#: Slots of hashed words and of hashed character trigrams.
WORD_SLOTS, GRAM_SLOTS = 256, 128
#: Penalties of dense and of hashed features.
RIDGE, HASHED_RIDGE = 1.0, 10.0

#: ASCII characters that are no letters; letters differ by language, not by quality.
_SYMBOLS = [i for i in range(33, 127) if not chr(i).isalpha()]
_DENSE = len(_SYMBOLS) + 8
_HASHED = WORD_SLOTS + GRAM_SLOTS
_TEXT = _DENSE + _HASHED
_META = LANG_SLOTS + SOURCE_SLOTS + 3


def hashed_features(texts: pa.Array) -> np.ndarray:
    """For each text the square roots of the shares of its words and character trigrams by slot, as bytes (255 is all)."""
    texts = texts.fill_null("")
    found, n = scan(texts), len(texts)
    words = np.bincount(np.repeat(np.arange(n), np.diff(found.first)) * WORD_SLOTS + (found.hashes() % np.uint64(WORD_SLOTS)).astype(np.int64), minlength=n * WORD_SLOTS).reshape(n, WORD_SLOTS)
    sizes = np.asarray(pa.compute.binary_length(texts), np.int64)
    d = found.data.astype(np.uint32)
    code = (mixed((d[:-2] | d[1:-1] << np.uint32(8) | d[2:] << np.uint32(16)).astype(np.uint64)) % np.uint64(GRAM_SLOTS)).astype(np.int64)
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(n), sizes)
    within = np.arange(len(code)) + 2 < ends[of[: len(code)]]
    grams = np.bincount(of[: len(code)][within] * GRAM_SLOTS + code[within], minlength=n * GRAM_SLOTS).reshape(n, GRAM_SLOTS)
    return np.hstack([np.rint(255 * np.sqrt(x / np.maximum(1, x.sum(1, keepdims=True)))).astype(np.uint8) for x in (words, grams)])


def text_features(text: str | None) -> np.ndarray:
    """The dense features."""
    raw = (text or "").encode()
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    words = raw.split()
    lines = raw.split(b"\n")
    total, letters = max(1.0, n.sum()), max(1.0, n[65:91].sum() + n[97:123].sum())
    counts = Counter(words)
    many = max(1, len(words))
    more = (
        n[65:91].sum() / letters,
        min(20.0, len(raw) / many) / 20,
        np.log1p(len(counts)) / np.log1p(many),  # falls little with the length, much with repetition
        max(counts.values(), default=0) / many,
        1 - len(set(lines)) / len(lines),
        np.log1p(len(words)) / 10,
        sum(a == b for a, b in zip(words, words[1:])) / many,
        sum(v for w, v in counts.items() if not (w[:1].isalpha() or w[:1] >= b"\x80")) / many,
    )
    return np.concatenate((np.sqrt(n[_SYMBOLS] / total), more))


def _meta_slots(lang: str | None, source: str | None, n_chars: int | None) -> tuple[int, int, bool, float]:
    """The slots of language and source, whether no length is stated, and its logarithm."""
    slots = (zlib.crc32(("s" + x if x is not None else "n").encode()) % n for x, n in ((lang, LANG_SLOTS), (source, SOURCE_SLOTS)))
    return *slots, n_chars is None, float(np.log1p(max(0, n_chars or 0)) / 10)


def _logit(p: np.ndarray | float):
    return np.log(p) - np.log1p(-p)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: np.ndarray | float = RIDGE, start: np.ndarray | None = None) -> np.ndarray:
    """Weights with the intercept last: Newton's method on the penalised likelihood."""
    width = x.shape[1] + 1
    penalty = np.full(width, 1e-3)
    penalty[:-1] = ridge
    w = np.zeros(width) if start is None or len(start) != width else start.copy()
    for _ in range(25):
        curve, slope = np.diag(penalty), penalty * w
        for k in range(0, len(x), 1000):  # bounds the copies in memory
            some = np.hstack((x[k : k + 1000], np.ones((len(x[k : k + 1000]), 1))))
            p = _sigmoid(some @ w)
            curve += (some.T * (p * (1 - p))) @ some
            slope += some.T @ (p - y[k : k + 1000])
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


@dataclass
class View:
    """Logistic regression over standardised features, and its calibration."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    platt: tuple[float, float] = (1.0, 0.0)
    ridge: np.ndarray | float = RIDGE

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        self.weights = fit_logistic(self._standard(x), y, self.ridge, self.weights)

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self._standard(x) @ self.weights[:-1] + self.weights[-1]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        self.platt = tuple(fit_logistic(self.odds(x)[:, None], y, 1e-2))

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return self.odds(x) * self.platt[0] + self.platt[1]


def surest(view: View, x: np.ndarray, low: int, high: int, free: np.ndarray, tie: np.ndarray) -> list[tuple[int, float, int, int]]:
    """Of the free rows of x, those that the view is sure of: the ``low`` surest bad and ``high`` surest good ones, as (label, log odds, tie, row). Equal odds go by tie."""
    odds, at, bound = view.calibrated(x), np.flatnonzero(free), _logit(SURE)
    out = []
    for label, n, sign in ((0, low, 1), (1, high, -1)):
        sure = at[sign * odds[at] <= -bound]
        out += [(label, float(odds[i]), int(tie[i]), int(i)) for i in sure[np.lexsort((tie[sure], sign * odds[sure]))[:n]]]
    return out


class ArrayPool:
    """Unlabelled rows in memory: one matrix for each view."""

    def __init__(self, x: list[np.ndarray], tie: np.ndarray | None = None):
        self.x, self.free, self.tie = x, np.ones(len(x[0]), bool), np.arange(len(x[0])) if tie is None else tie

    def take(self, views: list[View], low: int, high: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each view the rows (features of the other view, labels) that it hands over; they are free no more."""
        out, gone = [], []
        for v, view in enumerate(views):
            found = surest(view, self.x[v], low, high, self.free, self.tie)
            rows = [r[3] for r in found]
            out.append((self.x[1 - v][rows], np.array([r[0] for r in found], np.float64)))
            gone += rows
        self.free[gone] = False
        return out


class SparkPool:
    """All unlabelled rows of a table of features (x, label, doc_id), which lies in the checkpoint folder."""

    def __init__(self, features: DataFrame):
        self.rows = features.where("label is null").withColumn("row", F.monotonically_increasing_id()).select("x", F.xxhash64("x").alias("tie"), "row")
        self.gone: set[int] = set()

    def take(self, views: list[View], low: int, high: int) -> list[tuple[np.ndarray, np.ndarray]]:
        gone = np.array(sorted(self.gone), np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list[tuple] = []
            for b in batches:
                tie, row = np.asarray(b.column(1)), np.asarray(b.column(2))
                free = ~np.isin(row, gone)
                for v, x in enumerate(_unpacked(b.column(0))):
                    best += [(v, *r, int(row[i])) for *r, i in surest(views[v], x, low, high, free, tie)]
                if len(best) > 8 * (low + high):
                    best = _first(best, low, high)
            columns = list(zip(*_first(best, low, high), strict=True)) or [[]] * 5
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["view", "label", "odds", "tie", "row"])

        found = durable(self.rows.mapInArrow(run, "view int, label int, odds double, tie long, row long"))
        chosen = [r for v in (0, 1) for label, n in ((0, low), (1, high)) for r in found.where((F.col("view") == v) & (F.col("label") == label)).orderBy(F.col("odds") * (1 - 2 * label), "tie", "row").limit(n).collect()]
        self.gone |= {r.row for r in chosen}
        if not chosen:
            return [(np.zeros((0, m)), np.zeros(0)) for m in (_META, _TEXT)]
        # twice SHARE * MAX_LABELLED rows at most
        of = self.rows.sparkSession.createDataFrame([(row,) for row in sorted({r.row for r in chosen})], "row long")
        by_row = {r.row: r.x for r in self.rows.join(F.broadcast(of), "row").collect()}
        out = []
        for v in (0, 1):
            own = [r for r in chosen if r.view == v]
            x = _unpacked(pa.array([by_row[r.row] for r in own], pa.binary()))[1 - v]
            out.append((x, np.array([r.label for r in own], np.float64)))
        return out


def _first(found: list[tuple], low: int, high: int) -> list[tuple]:
    """Of (view, label, odds, tie, row) the surest of each view and label."""
    out = []
    for v in (0, 1):
        for label, n in ((0, low), (1, high)):
            out += sorted((r for r in found if r[:2] == (v, label)), key=lambda r: (r[2] * (1 - 2 * r[1]), *r[3:]))[:n]
    return out


@dataclass
class CoTrained:
    views: list[View] | None = None
    prior: float = 0.0
    handed: list[tuple[int, int]] = field(default_factory=list)

    @classmethod
    def fit(cls, labelled: list[np.ndarray], y: np.ndarray, pool: ArrayPool | SparkPool, rounds: int = ROUNDS, share: float = SHARE, ridges: tuple = (RIDGE, RIDGE)) -> CoTrained:
        """labelled: one matrix for each of the two views. Every fifth labelled row calibrates. ``handed`` tells how many rows each view handed over in each round."""
        if len(set(y.tolist())) < 2:
            return cls()
        held = np.arange(len(y)) % 5 == 4
        if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
            held = np.ones(len(y), bool)  # too few labels to hold any back
        train = ~held if not held.all() else held
        views = [View(x[train].mean(0), x[train].std(0) + 1e-3, ridge=r) for x, r in zip(labelled, ridges, strict=True)]
        rows, labels = [x[train] for x in labelled], [y[train]] * 2
        good = y[train].mean()
        most = max(2, round(share * len(y)))
        low = max(1, round(most * (1 - good)))
        handed = []
        for k in range(rounds + 1):
            for v, view in enumerate(views):
                view.fit(rows[v], labels[v])
                view.calibrate(labelled[v][held], y[held])
            if k == rounds:
                break
            give = pool.take(views, low, max(1, most - low))
            handed.append(tuple(len(pseudo) for _, pseudo in give))
            if not any(handed[-1]):
                break
            for v, (x, pseudo) in enumerate(give):
                rows[1 - v] = np.vstack((rows[1 - v], x))
                labels[1 - v] = np.concatenate((labels[1 - v], pseudo))
        return cls(views, float(_logit(np.clip(y.mean(), 1e-3, 1 - 1e-3))), handed)

    def score(self, x: list[np.ndarray]) -> list[np.ndarray]:
        """Calibrated probabilities by text, by metadata and by both."""
        if self.views is None:
            return [np.ones(len(x[0]))] * 3
        odds = [v.calibrated(m) for v, m in zip(self.views, x, strict=True)]
        return [_sigmoid(z) for z in (*odds, odds[0] + odds[1] - self.prior)]


def _packed(part: pa.RecordBatch) -> list[bytes]:
    """Features of a batch whose first columns are text, lang, source and n_chars: dense ones as 32-bit floats, then bytes, then the metadata's."""
    hashed = hashed_features(part.column(0))
    text, *meta = (part.column(i).to_pylist() for i in range(4))
    out = []
    for t, h, *m in zip(text, hashed, *meta, strict=True):
        out.append(text_features(t).astype("<f4").tobytes() + h.tobytes() + np.array(_meta_slots(*m), "<f4").tobytes())
    return out


def _unpacked(rows: pa.Array) -> list[np.ndarray]:
    """Both views' matrices of packed features."""
    raw = np.frombuffer(b"".join(rows.to_pylist()), np.uint8).reshape(len(rows), 4 * _DENSE + _HASHED + 16)
    dense = raw[:, : 4 * _DENSE].copy().view("<f4").astype(np.float64)
    meta = raw[:, 4 * _DENSE + _HASHED :].copy().view("<f4").astype(np.float64)
    wide = np.zeros((len(rows), _META))
    at = np.arange(len(rows))
    wide[at, meta[:, 0].astype(np.int64)] = 1
    wide[at, LANG_SLOTS + meta[:, 1].astype(np.int64)] = 1
    wide[:, -3], wide[:, -2], wide[:, -1] = meta[:, 2], meta[:, 3], meta[:, 3] ** 2
    return [np.hstack((dense, raw[:, 4 * _DENSE : 4 * _DENSE + _HASHED] / 255)), wide]


def _inputs(docs: DataFrame, *more) -> DataFrame:
    kinds = {"text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(*((F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()), *more)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_labelled: int = MAX_LABELLED, share: float = SHARE) -> CoTrained:
    ship(docs.sparkSession)
    label = F.avg(F.col(label_col).cast("double"))
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(label.alias("label")).where("label <> 0.5")
    known = known.select("id", (F.col("label") > 0.5).cast("double").alias("label"))
    own = _inputs(docs, F.col("doc_id").cast("long").alias("id"))
    present = known.join(own.select("id").distinct(), "id", "left_semi")
    some = present.orderBy(F.xxhash64("id"), "id").limit(max_labelled)  # a bounded table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 0):
                yield pa.RecordBatch.from_arrays([pa.array(_packed(part), pa.binary()), part.column(4), part.column(5)], names=["x", "id", "text_key"])

    rows = _inputs(docs, F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_key")).mapInArrow(run, "x binary, id long, text_key long")
    features = durable(rows)
    trains = durable(features.join(F.broadcast(some), "id").groupBy("id").agg(F.min_by(F.struct("x", "label"), F.struct("text_key", "x")).alias("row")).select("id", "row.*")).orderBy("id").collect()
    if not trains:
        return CoTrained()
    unlabelled = features.join(known.withColumnRenamed("label", "_known"), "id", "left").select("x", F.col("_known").alias("label"))
    x = _unpacked(pa.array([r.x for r in trains], pa.binary()))
    y = np.array([r.label for r in trains])
    ridges = np.concatenate((np.full(_DENSE, RIDGE), np.full(_HASHED, HASHED_RIDGE))), RIDGE
    return CoTrained.fit(x, y, SparkPool(durable(unlabelled)), share=share, ridges=ridges)


def score(docs: DataFrame, model: CoTrained, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of docs as a struct ``doc``, with text_score, metadata_score, quality_score and kept."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 0):
                found = model.score(_unpacked(pa.array(_packed(part), pa.binary())))
                yield pa.RecordBatch.from_arrays([part.column(4), *map(pa.array, found), pa.array(found[2] >= threshold)], names=["doc", "text_score", "metadata_score", "quality_score", "kept"])

    whole = _inputs(docs, F.struct(*(F.col(c) for c in docs.columns)).alias("doc"))
    schema = whole.select("doc").schema.add("text_score", "double").add("metadata_score", "double").add("quality_score", "double").add("kept", "boolean")
    return whole.mapInArrow(run, schema)
