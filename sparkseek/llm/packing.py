"""Sum-of-squares online packing of tokenised documents into training sequences.

Each task packs the documents of its input partition, in their order, with no shuffle. A document goes
whole into the open sequence whose fill level minimises the sum of the squared counts of partially
filled sequences (Csirik et al., "On the Sum-of-Squares algorithm for bin packing", 2006); the counts are
an array by fill level. Documents longer than a sequence are cut into full sequences and a rest. At
the end of a partition the open sequences are merged, cutting pieces where one is full, and the last one
is cut into lengths that are powers of two, which need no padding.

Sequence ids are the partition's number times 2**32 plus a running number, so a task that runs again
gives the same ids. Memory: the open sequences of one task, whose number the algorithm keeps low.

Defined cases: a null text is empty; an empty text has one token, the end token; repeated rows are packed
as often as they come, and their pieces are told apart by ``position`` where one is given; a null id is packed like others;
texts of any length are cut into full sequences; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseek.llm.common import ship
from sparkseek.llm.textscan import scan, slices

SEQUENCE_TOKENS = 4096
END_ID = 2
#: Words whose ids a task keeps at hand; beyond it starts anew.
CACHE_WORDS = 350_000
#: New words in one call of the tokenizer.
GROUP = 150
_SPACE = b" \t\n\x0b\x0c\r"
PUNCTUATION = bytes(i for i in range(33, 127) if not chr(i).isalnum())

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordTokenizer:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its
    words, and words that come again are looked up. Texts in which that does not hold (special tokens) are
    encoded whole. New words go to the tokenizer many at a time: each run of letters ends in one token
    with the vocabulary's word end, by which the ids are told apart; where their number is not that of the
    words, these are encoded one by one. ASCII punctuation at the end of a word is a token run of its own. Lower-case
    Latin letters are what normalisation and splitting leave as they are, so their words skip both.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)  # the same model in memory
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = np.uint32(end_id).astype("<u4").tobytes()
        self.words: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: set[bytes]) -> None:
        plain, other, tails = [], [], {}
        heads = list(new)
        known = self.words
        for w in heads:  # grows by heads and tails
            t = w.decode()
            if t.isalpha():
                if t.isascii() and t.islower():
                    plain.append((t, w))
                    continue
                if max(t) < "\u0250" and "\u0130" not in t:
                    plain.append((t.lower(), w))
                    continue
            elif tail := _tail(w):
                tails[w] = tail
                for part in (w[: len(w) - len(tail)], tail):
                    if part not in known and part not in new:
                        new.add(part)
                        heads.append(part)
                continue
            other.append(t)
        for i in range(0, len(plain), 5000):
            groups = [plain[j : j + GROUP] for j in range(i, min(i + 5000, len(plain)), GROUP)]
            for group, found in zip(groups, self.plain.encode_batch_fast([" ".join(t for t, _ in g) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(found.ids, "<u4")
                ends = np.flatnonzero(self.ends_word[ids]) + 1
                if len(ends) != len(group):
                    other.extend(w.decode() for _, w in group)
                    continue
                raw, start = ids.tobytes(), 0
                for (_, word), end in zip(group, (4 * ends).tolist(), strict=True):
                    self.words[word] = raw[start:end]
                    start = end
        for i in range(0, len(other), 5000):
            part = other[i : i + 5000]
            self.words.update(zip((w.encode() for w in part), self._ids(part), strict=True))
        for w, tail in tails.items():  # neither part has such a tail itself
            self.words[w] = self.words[w[: len(w) - len(tail)]] + self.words[tail]

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        texts = texts.fill_null("")
        found = scan(texts)
        raw = found.data.tobytes()
        if any(s in raw for s in self.special):
            return [self._whole(t) for t in texts.to_pylist()]
        # lower case is the tokenizer's own; before it come only compositions, of which combining marks take part
        if b"\xcc" not in raw and b"\xcd" not in raw:
            raw = raw.lower()
        if not len(found.begin):
            return [self.end] * len(texts)
        # each word with the white space after it: neighbours in one buffer, of which Arrow tells the different ones
        offsets = np.append(found.begin, len(raw)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(found.begin), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        different = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        different = [w.rstrip(_SPACE) for w in different]
        ids = list(map(self.words.get, different))
        if None in ids:
            self._learn({w for w, x in zip(different, ids, strict=True) if x is None})
            ids = [self.words[w] if x is None else x for w, x in zip(different, ids, strict=True)]
        length = np.array([len(x) >> 2 for x in ids])
        start = np.cumsum(length) - length
        index = words.indices.to_numpy()
        own = length[index]
        before = np.concatenate(([0], np.cumsum(own)))  # tokens before each word
        tokens = np.frombuffer(b"".join(ids), "<u4")[np.repeat(start[index] - before[:-1], own) + np.arange(before[-1])]
        edges = before[found.first].tolist()
        return [tokens[i:j].tobytes() + self.end for i, j in zip(edges, edges[1:])]

    def _whole(self, text: str) -> bytes:
        return self._ids([text])[0] + self.end


def _tail(word: bytes) -> bytes:
    """ASCII punctuation at the end of a word whose character before is an ASCII letter or digit."""
    head = word.rstrip(PUNCTUATION)
    return word[len(head) :] if head and head[-1] < 128 and chr(head[-1]).isalnum() else b""


@lru_cache(maxsize=4)
def word_tokenizer(path: str, end_id: int = END_ID) -> WordTokenizer:
    """One for each worker process, so that its words serve all the tasks that run there."""
    return WordTokenizer(path, end_id)


class Packer:
    """Places items by the sum-of-squares rule. A sequence is a list of (item, start, length)."""

    def __init__(self, capacity: int = SEQUENCE_TOKENS):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)  # open sequences by fill level
        self.open: list[list[list]] = [[] for _ in range(capacity + 1)]

    def place(self, item, size: int) -> Iterator[list]:
        """Yields the sequences that are full now."""
        full = size - size % self.capacity
        for start in range(0, full, self.capacity):
            yield [(item, start, self.capacity)]
        if rest := size - full:
            level = self._level(rest)
            sequence = self._take(level) if level else []
            sequence.append((item, full, rest))
            if level + rest == self.capacity:
                yield sequence
            else:
                self.count[level + rest] += 1
                self.open[level + rest].append(sequence)

    def _take(self, level: int) -> list:
        self.count[level] -= 1
        return self.open[level].pop()

    def _level(self, size: int) -> int:
        """The level to add size to, 0 for a new sequence. Ties go to the fullest."""
        n, top = self.count, self.capacity - size
        change = 2 * (n[size : self.capacity + 1] - n[: top + 1]) + 2  # N(h) loses one, N(h + size) gains one
        change[top] = 1 - 2 * n[top]  # a full sequence no longer counts
        change[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * n[size] + 1 if top else 0
        return int(top - np.argmin(change[::-1]))

    def close(self) -> Iterator[list]:
        """The open sequences, merged: the emptiest fill up the fullest, pieces cut where one is full; the last is cut into powers of two."""
        rest = [s for level in reversed(self.open) for s in level]
        self.open, self.count = [[] for _ in range(self.capacity + 1)], np.zeros(self.capacity + 1, np.int64)
        sizes = [sum(p[2] for p in s) for s in rest]
        i, j = 0, len(rest) - 1
        while i < j:
            if sizes[i] == self.capacity:
                yield rest[i]
                i += 1
            elif not sizes[j]:
                j -= 1
            else:
                item, start, length = rest[j].pop()
                n = min(length, self.capacity - sizes[i])
                rest[i].append((item, start, n))
                if n < length:
                    rest[j].append((item, start + n, length - n))
                sizes[i] += n
                sizes[j] -= n
        if i == j and sizes[i]:
            pieces, left = rest[i][::-1], sizes[i]
            while left:
                room, sequence = 1 << (left.bit_length() - 1), []
                left -= room
                while room:
                    item, start, length = pieces.pop()
                    n = min(length, room)
                    sequence.append((item, start, n))
                    if n < length:
                        pieces.append((item, start + n, length - n))
                    room -= n
                yield sequence


def pack(docs: DataFrame, tokenizer: Callable[[], Callable[[pa.Array], list[bytes]]], capacity: int = SEQUENCE_TOKENS, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, position: Column | None = None) -> DataFrame:
    """One row for each piece, in the columns of PIECES; with_ids adds the piece's token ids.

    tokenizer() is called in each task and gives a function from texts to their ids as bytes. ``position`` is a long, different for
    each row; tasks then pack their rows in its order, and pieces carry it as ``position``. It tells the pieces of several
    copies of a document apart, and sequences can be read in the order of the first position in them.
    """
    more = [f"{name} {kind}" for name, kind, wanted in (("ids", "array<long>", with_ids), ("position", "long", position is not None)) if wanted]
    schema = ", ".join((PIECES, *more))
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.list_(pa.int64()) if name == "ids" else pa.int64() for name in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = tokenizer(), Packer(capacity)
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        rows: list[tuple] = []

        def put(sequence: list) -> None:
            nonlocal number
            offset = 0
            for (doc_id, place, ids), start, length in sequence:
                own = ids[4 * start : 4 * (start + length)]
                extra = {"ids": np.frombuffer(own, "<u4").astype(np.int64)} if with_ids else {}
                extra["position"] = place
                rows.append((doc_id, start, length, zlib.crc32(own), len(ids) // 4, number, offset, *(extra[name] for name in names[7:])))
                offset += length
            number += 1

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for b in batches:
            for part in slices(b, 1, size=2 << 20):  # bounds the tokens in memory
                for doc in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), encode(part.column(1)), strict=True):
                    for sequence in packer.place(doc, len(doc[2]) // 4):
                        put(sequence)
                if rows:
                    yield batch()
        for sequence in packer.close():
            put(sequence)
            if len(rows) > 10_000:
                yield batch()
        yield batch()

    ship(docs.sparkSession)
    place = F.lit(None).cast("long") if position is None else position.cast("long")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), place.alias("position"))
    if position is not None:
        docs = docs.sortWithinPartitions("position")
    return docs.mapInArrow(run, schema)
