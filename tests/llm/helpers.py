"""Tables with the awkward cases that every operator has to bear."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, size long, start long, kept boolean, n long, whole string"


def docs(spark, rows, schema="doc_id long, text string, lang string, source string"):
    """rows of (doc_id, text[, lang[, source]]), with columns whose names clash with the operators' own."""
    full = [tuple(r) + (None,) * (4 - len(r)) for r in rows]
    df = spark.createDataFrame(full, schema)
    extra = {"n_chars": "length(text)", "id": "7L", "key": "'k'", "size": "1L", "start": "2L", "kept": "false", "n": "3L", "whole": "'w'", "site": "'s'", "counts": "'c'", "turn": "'t'", "bucket": "'b'", "_id": "8L", "digest": "'d'"}
    return df.selectExpr("*", *(f"{v} AS {k}" for k, v in extra.items()))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sentence(r, n, vocabulary=400):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1, n=120):
    """Copies, near copies, shared passages, short, empty, null and long texts."""
    r = random.Random(seed)
    passage = sentence(r, 60)
    rows = []
    for i in range(n):
        kind = i % 8
        own = sentence(r, r.randrange(25, 160))
        if kind == 1 and rows:
            own = words(rows[r.randrange(len(rows))][1])
        elif kind == 2 and rows:
            own = words(rows[r.randrange(len(rows))][1])
            if own:
                own[r.randrange(len(own))] = "changed"
        elif kind == 3:
            own[10:10] = passage
        elif kind == 4:
            own = sentence(r, r.randrange(0, 6), 5)
        rows.append((i, " ".join(own), "en" if i % 3 else None, f"s{i % 4}" if i % 7 else None))
    rows += [(n, None, "en", "s0"), (n + 1, "", None, None), (n + 2, " \n\t ", "fr", "s1"), (n + 3, " ".join(["the"] * 300), "en", "s2"), (n + 4, "\n".join(sentence(r, 3000)), "en", "s0")]
    return rows
