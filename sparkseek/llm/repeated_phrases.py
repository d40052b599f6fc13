"""Removal of passages that repeat across documents, found with sharded Aho-Corasick automata.

A window is 20 consecutive words. A window that also starts earlier (in a document with a smaller id, or further
up in its own) is repeated, and so is every word that it covers.

1. Anchors. Each window names one of its 13 runs of 8 words, the one with the least hash, as its anchor.
   Equal windows have equal anchors, so a window can only recur if its anchor does. Neighbouring windows mostly share
   an anchor, which leaves one for about seven words. They are counted; those seen once are done with.
2. Segments. The windows that share a recurring anchor make one short segment of text, routed by the anchor's
   hash, so that all windows that could be equal meet. Thus each automaton is fed just the parts of all documents that
   can match it, and work grows with the text, not with the text times the number of automata. Anchors that
   recur more than ``hot`` times route each window on its own, by the window's hash; equal windows of a task
   are sent once. So no anchor, however common, brings more than ``hot`` rows or one per task to one place.
3. Automata. Each task reads its segments in order of route and in shards of bounded size. Windows that are
   confirmed to recur, word by word, are compiled into a pyahocorasick automaton with their first occurrence;
   the shard's segments stream through it, and every match but the first occurrence is a repeat.
4. Documents. First occurrences go back to their documents, whose other recurring windows are all repeated.

Defined cases: a null or empty text has no words. A text shorter than a window has none to remove. Rows that share
an id count as one document and must share the text, as repeated rows do. Rows whose id is null are left as they are
and are not compared. Windows do not cross documents. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.llm.common import durable, scratch_table, ship
from sparkseek.llm.textscan import runs, scan, slices

WINDOW, ANCHOR = 20, 8
HOT = 1000
#: Segments in one automaton: at most about 13 windows of 20 words each.
SHARD_SEGMENTS = 4000


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    out, length = values, 1
    while length * 2 <= width:
        out, length = np.minimum(out[:-length], out[length:]), length * 2
    n = len(values) - width + 1
    return np.minimum(out[:n], out[width - length : width - length + n])


def anchored(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For one slice of words: anchor hash, first window and number of windows of each stretch with one anchor.

    Stretches know nothing of documents; split_at_documents() cuts them.
    """
    if len(hashes) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = runs(hashes, anchor)
    width = window - anchor + 1
    least = _least(own, width)
    at, here = np.zeros(len(least), np.int64), np.arange(len(least))
    for k in reversed(range(width)):  # of equal runs the first, whatever the document's length
        at = np.where(own[k : k + len(least)] == least, here + k, at)
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return own[at[starts]], starts, np.diff(np.append(starts, len(at)))


def stretches(texts: pa.Array, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """text number, anchor hash, first window within the text, number of windows: of all the texts' stretches."""
    found = scan(texts)
    hashes = found.hashes()
    out: list[tuple] = []
    for t in np.flatnonzero(np.diff(found.first) >= window):
        h, s, n = anchored(hashes[found.first[t] : found.first[t + 1]], window, anchor)
        out.append((np.full(len(h), t), h, s, n))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _stretch_rows(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1):
                t, h, s, n = stretches(part.column(1).fill_null(""), window, anchor)
                ids = np.asarray(part.column(0))[t]
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(ids, pa.int64()), pa.array(s * 64 + n, pa.int64())], names=["anchor", "id", "place"])

    return docs.mapInArrow(run, "anchor long, id long, place long")


def _segments(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """From (id, text, anchors, places): route, text, windows, id and start of the first of equal segments, how many there are."""
    kept: dict[tuple[int, bytes], list] = {}
    size = 0

    def out() -> pa.RecordBatch:
        rows = [(k, s, *v) for (k, s), v in kept.items()]
        kept.clear()
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["route", "segment", "windows", "id", "start", "times"])

    for b in batches:
        own = zip(_plain(b.column(0)), _plain(b.column(1)), _lists(b.column(2)), _lists(b.column(3)), strict=True)
        for id_, text, anchors, places in own:
            if anchors is None or not len(anchors):
                continue
            anchors, places = anchors.tolist(), places.tolist()
            words = text.encode().split()
            for anchor, place in zip(anchors, places, strict=True):
                hot, place = place & 1, place >> 1
                start, n = place >> 6, place & 63
                pieces = [(start, n)] if not hot else [(start + j, 1) for j in range(n)]
                for at, many in pieces:
                    segment = b" ".join(words[at : at + many + window - 1])
                    key = (xxhash.xxh3_64_intdigest(segment) - 2**63 if hot else anchor, segment)
                    if known := kept.get(key):
                        known[3] += 1
                        if (id_, at) < (known[1], known[2]):
                            known[1:3] = id_, at
                    else:
                        kept[key] = [many, id_, at, 1]
                        size += len(segment) + 200
            if size > 32 << 20:
                yield out()
                size = 0
    yield out()


class Shard:
    """Segments by route, and the automaton of the passages that recur in them.

    Where a route has one segment, seen more than once, the segment is a passage that recurs as a whole. Where it has
    several, the windows that recur in them are the passages.
    """

    def __init__(self, window: int):
        self.window, self.words, self.routes, self.size = window, {}, {}, 0

    def add(self, route: int, segment: bytes, n: int, id_: int, start: int, times: int) -> None:
        """Equal segments count together, at their first occurrence: all windows of the others are repeated."""
        segments = self.routes.setdefault(route, {})
        if known := segments.get(segment):
            known[4] += times
            if (id_, start) < (known[2], known[3]):
                known[2:4] = id_, start
        else:
            words = self.words
            segments[segment] = [tuple([words.setdefault(w, len(words)) for w in segment.split(b" ")]), n, id_, start, times]
            self.size += 1

    def passages(self) -> Iterator[tuple[tuple, tuple[int, int]]]:
        """Words of a passage and where it first occurs."""
        for segments in self.routes.values():
            if len(segments) == 1:
                ((words, _, id_, start, times),) = segments.values()
                if times > 1:
                    yield words, (id_, start)
                continue
            seen: dict[tuple, list] = {}
            for words, n, id_, start, times in segments.values():
                for j in range(n):
                    window, at = words[j : j + self.window], (id_, start + j)
                    if known := seen.get(window):
                        known[0] += times
                        if at < known[1]:
                            known[1] = at
                    else:
                        seen[window] = [times, at]
            yield from ((window, at) for window, (times, at) in seen.items() if times > 1)

    def first_occurrences(self) -> Iterator[tuple[int, int]]:
        """id and place (start * 64 + windows) of windows, at the first of equal segments, that are no repeats."""
        import ahocorasick

        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for words, at in self.passages():
            automaton.add_word(words, (len(words), at))
        if len(automaton):
            automaton.make_automaton()
        for segments in self.routes.values():
            for words, n, id_, start, _ in segments.values():
                repeats = [False] * n
                for end, (length, at) in automaton.iter(words) if len(automaton) else ():
                    first = end - length + 1
                    if at != (id_, start + first):
                        windows = length - self.window + 1
                        repeats[first : first + windows] = [True] * windows
                if not any(repeats):
                    yield id_, start * 64 + n
                    continue
                j = 0
                while j < n:
                    if repeats[j]:
                        j += 1
                        continue
                    k = j
                    while k < n and not repeats[k]:
                        k += 1
                    yield id_, (start + j) * 64 + k - j
                    j = k


def _plain(column: pa.Array) -> list:
    return column.to_numpy(zero_copy_only=False).tolist()


def _lists(column: pa.ListArray) -> Iterator[np.ndarray | None]:
    """Each row's numbers; None for a null."""
    offsets, values = column.offsets.to_numpy().tolist(), column.values.to_numpy()
    for valid, a, b in zip(column.is_valid().to_numpy(zero_copy_only=False).tolist(), offsets, offsets[1:]):
        yield values[a:b] if valid else None


def _match(batches: Iterator[pa.RecordBatch], window: int, shard_segments: int) -> Iterator[pa.RecordBatch]:
    shard, last = Shard(window), None

    def out() -> pa.RecordBatch:
        found = list(shard.first_occurrences())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["id", "place"])

    for b in batches:
        for route, *segment in zip(*map(_plain, b.columns), strict=True):
            if route != last and shard.size >= shard_segments:
                yield out()
                shard = Shard(window)
            shard.add(route, *segment)
            last = route
    yield out()


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """Every row of docs as id, text, stretches (places of windows whose anchor recurs) and firsts (places of those of them that are first occurrences)."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = docs.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    with scratch_table(_stretch_rows(known, window, anchor)) as occurrences:  # read twice, so that texts are hashed once
        recurring = durable(occurrences.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
        own = occurrences.join(recurring.withColumn("hot", (F.col("n") > hot).cast("long")).drop("n"), "anchor")
        own = own.groupBy("id").agg(F.collect_set(F.struct("anchor", (F.col("place") * 2 + F.col("hot")).alias("place"))).alias("own"))
        own = durable(own.select("id", F.col("own.anchor").alias("anchors"), F.col("own.place").alias("places")))
    # both joins with the documents read one and the same shuffle of their texts
    segments = docs.join(own, "id", "left").select("id", "text", "anchors", "places").mapInArrow(lambda b: _segments(b, window), "route long, segment binary, windows long, id long, start long, times long")
    segments = segments.repartition("route").sortWithinPartitions("route")
    firsts = segments.mapInArrow(lambda b: _match(b, window, SHARD_SEGMENTS), "id long, place long")
    firsts = firsts.groupBy("id").agg(F.collect_set("place").alias("firsts"))
    lists = own.select("id", F.transform("places", lambda x: F.shiftright(x, 1)).alias("stretches")).join(firsts, "id", "left")
    return docs.join(lists, "id", "left")


def _within(n: int, places: np.ndarray) -> np.ndarray:
    """For each of n windows whether it is in one of the places."""
    edges = np.zeros(n + 1, np.int32)
    start = places >> 6
    np.add.at(edges, start, 1)
    np.add.at(edges, start + (places & 63), -1)
    return np.cumsum(edges)[:n] > 0


def _covered(n: int, places: np.ndarray, firsts: np.ndarray | None, window: int) -> np.ndarray:
    """For each of n words whether a repeated window covers it."""
    windows = n - window + 1
    repeat = _within(windows, places)
    if firsts is not None:
        repeat &= ~_within(windows, firsts)
    edges = np.zeros(n + 1, np.int32)
    edges[:windows] += repeat
    edges[window:] -= repeat
    return np.cumsum(edges)[:n] > 0


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """One row for each row of docs: id, n_words, n_removed, spans (begin and end, in words, of what is removed), kept_sha256 and, with_text, kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, places, firsts in zip(_plain(b.column(1)), _lists(b.column(2)), _lists(b.column(3)), strict=True):
                words = (text or "").encode().split()
                gone = np.zeros(len(words), bool) if places is None else _covered(len(words), places, firsts, window)
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                if len(edges):
                    ends = [0, *edges.tolist(), len(words)]
                    words_kept = [w for i in range(0, len(ends), 2) for w in words[ends[i] : ends[i + 1]]]
                else:
                    words_kept = words
                kept = b" ".join(words_kept)
                rows.append((len(words), int(gone.sum()), edges.tolist(), hashlib.sha256(kept).hexdigest(), *([kept.decode()] * with_text)))
            columns = list(zip(*rows, strict=True)) or [[]] * (4 + with_text)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=False))], names=["id", "n_words", "n_removed", "spans", "kept_sha256", "kept"][: 5 + with_text])

    out = repeated_windows(docs, id_col, text_col, window).mapInArrow(run, "id long, n_words long, n_removed long, spans array<long>, kept_sha256 string" + ", kept string" * with_text)
    return out.withColumnRenamed("id", id_col)
