"""Mixing, packing, language, URLs, quality, audio and the pipeline."""

from __future__ import annotations

import io
import math
import random
import re
import wave
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek.llm import chroma, langid, mixing, packing, quality, url_filter
from sparkseek.llm.common import file_order
from sparkseek.llm.queries import SPAM_TERMS, URL_RULES, word_tokenizer_path
from tests.llm.helpers import corpus, docs, words

SF = "/root/testdata/sf0.001"


def targets_brute(sizes):
    """sizes: by source, in order. Water filling by rounds."""
    weight = {s: i % 3 + 1 for i, s in enumerate(sizes)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in capped]
        if not free:
            return capped
        level = (total - sum(capped.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return capped | {s: level * weight[s] for s in free}
        capped |= {s: 3 * sizes[s] for s in over}


def test_mix(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["w"] * r.randrange(0, 60)), None, r.choice(["a"] * 20 + ["b", "c", "é", "Z", None])) for i in range(600)] + [(700, None, None, "empty")]
    out = mixing.mix(docs(spark, rows)).collect()
    sizes = defaultdict(int)
    for _, text, _, s in rows:
        sizes[s] += len(words(text))
    ordered = {s: sizes[s] for s in sorted(sizes, key=lambda s: (s is None, s or ""))}
    target, taken, source = targets_brute(ordered), defaultdict(int), {i: s for i, _, _, s in rows}
    for x in out:
        s = source[x.doc_id]
        assert x.target == pytest.approx(target[s]) and x.source_size == sizes[s] and x.size == len(words(dict((a, b) for a, b, *_ in rows)[x.doc_id]))
        assert 0 <= x.taken <= 3 * x.size and x.taken == sum(x.takes) and len(x.takes) == len(x.positions)
        assert all(0 <= p <= 1 for p in x.positions) and x.positions == sorted(x.positions)
        taken[s] += x.taken
    assert all(taken[s] == math.floor(target[s] + 1e-9) for s in sizes)
    again = mixing.mix(docs(spark, rows).repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_positions_follow_the_schedule(spark):
    """At every time, what is placed before it is the schedule's share of the demand."""
    rows = [(i, "w " * 10, None, "ab"[i % 2]) for i in range(4000)]
    out = mixing.mix(docs(spark, rows)).collect()
    for k, slope in ((0, -0.5), (1, 0.5)):
        own = sorted(p for x in out if x.doc_id % 2 == k for p in x.positions)
        for t in (0.25, 0.5, 0.9):
            assert sum(p <= t for p in own) / len(own) == pytest.approx((1 - slope) * t + slope * t * t, abs=0.01)


def test_curriculum(spark):
    rows = corpus(4, 80)
    mixed = mixing.curriculum(docs(spark, rows))
    assert mixed.columns == docs(spark, rows).columns
    taken = {x.doc_id: x.taken for x in mixing.mix(docs(spark, rows)).collect()}
    got = Counter()
    for x in mixed.collect():
        got[x.doc_id] += len(words(x.text))
    assert {i: n for i, n in taken.items() if n} == dict(got)
    assert mixing.mix(docs(spark, rows).limit(0)).count() == 0
    twice = mixing.mix(docs(spark, [(1, "a b"), (1, "a b"), (None, "c")])).collect()
    assert sorted((str(x.doc_id), x.taken) for x in twice) == [("1", 2), ("1", 2), ("None", 1)]
    # rows that share an id, null ids, whole repeats and a text of megabytes: each row is a document of its own
    rows = [(1, "a b", None, "x"), (1, "c d e", None, "x"), (1, "a b", None, "x"), (None, "f", None, "x"), (None, "g", None, "x"), (2, "w " * 1_000_000, None, "y"), (3, "h", "en", None), (3, "h", "fr", None)]
    got = Counter((x.doc_id, x.text[:9], x.lang) for x in mixing.curriculum(docs(spark, rows).repartition(4)).collect())
    taken = Counter()
    for x in mixing.mix(docs(spark, rows).repartition(2)).collect():
        taken[x.doc_id] += len(x.takes)
    assert sum(got.values()) == sum(taken.values()) and {k: sum(n for g, n in got.items() if g[0] == k) for k in taken if taken[k]} == {k: n for k, n in taken.items() if n}


def test_curriculum_without_adaptive_execution_and_in_small_buckets(spark, monkeypatch):
    rows = corpus(4, 60)
    expected = sorted(map(str, mixing.curriculum(docs(spark, rows), position_col="position").collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 0.001)  # more digits
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = mixing.curriculum(docs(spark, rows).repartition(5), position_col="position").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(map(str, got)) == expected and [x.position for x in got] == sorted(x.position for x in got)


@pytest.fixture(scope="module")
def path():
    pytest.importorskip("public_tokenizers")
    return word_tokenizer_path()


TRICKY = ["Á b", "x\u00a0y", "x\x1cy", "it's 'tis DON'T", "Σ ΣΑΣ", "  ", "", "ﬁ K İ İa", "e\u200bf", "12 3", "<|endoftext|> x", "a\x0bb", "H\u0331 \u1e96", "a.b, …, x\u2019s it\u2019s,", "क़a é, Éa!! %%% '", "\u1112\u1161\u11ab 한", "ÀÉ ŒUVRE straße ß", "a" * 3000]


def test_words_are_tokenised_as_whole_texts(path):
    t = packing.WordTokenizer(path)
    texts = TRICKY + [x[1] for x in corpus(6, 40)]
    for _ in range(2):
        for text, ids in zip(texts, t.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == [*t.tokenizer.encode(text or "", add_special_tokens=False).ids, 2], text


def check_packing(pieces, ids):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        own = ids[p.doc_id]
        assert p.doc_tokens == len(own) and p.ids_crc32 == zlib.crc32(np.array(own[p.start : p.start + p.length], "<u4").tobytes()) and p.length > 0
    for i, own in ids.items():
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(own)
    padding = 0
    for s in by_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding


def test_packing(spark, path):
    rows = corpus(5, 200)
    out = packing.pack(docs(spark, rows).repartition(3), lambda: packing.word_tokenizer(path).encode).collect()
    t = packing.WordTokenizer(path)
    ids = {i: np.frombuffer(t.encode([text])[0], "<u4").tolist() for i, text, *_ in rows}
    assert check_packing(out, ids) == 0
    assert packing.pack(docs(spark, rows).limit(0), lambda: packing.word_tokenizer(path).encode).count() == 0
    whole = packing.pack(docs(spark, rows), lambda: packing.word_tokenizer(path).encode, with_ids=True).where("doc_id = 0").orderBy("start").collect()
    assert [x for p in whole for x in p.ids] == ids[0]


def test_packing_keeps_the_order_of_many_files(spark, path, tmp_path):
    """Copies of a document are told apart, and sequences follow the order that the rows were written in, file by file."""
    r = random.Random(1)
    rows = [(i % 150, " ".join(["word"] * r.randrange(1, 900)), None, None) for i in range(600)] + [(None, "x", None, None)] * 2
    docs(spark, rows).withColumn("place", F.monotonically_increasing_id()).orderBy("place").repartitionByRange(12, "place").sortWithinPartitions("place").write.parquet(str(tmp_path / "mixed"))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")  # several files in a task, the larger ones first
    try:
        mixed = spark.read.parquet(str(tmp_path / "mixed"))
        order = [x.place for x in mixed.withColumn("_o", file_order(mixed)).orderBy("_o").collect()]
        out = packing.pack(mixed, lambda: packing.word_tokenizer(path).encode, position=file_order(mixed)).collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert order == sorted(order) and len({x.position for x in out}) == len(rows)
    for own in defaultdict(list, {k: [p for p in out if p.position == k] for k in {p.position for p in out}}).values():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_id == own[0].doc_id
            at += p.length
        assert at == own[0].doc_tokens
    # a file's rows are packed by one task, in order, so sequences read by first position go through the files in order
    tasks = defaultdict(set)
    for p in out:
        tasks[p.position >> 40].add(p.sequence_id >> 32)
    assert len(tasks) == 12 and all(len(x) == 1 for x in tasks.values()) and 1 < len({p.sequence_id >> 32 for p in out}) < 12
    assert packing.pack(docs(spark, [(1, "a"), (1, "a")]), lambda: packing.word_tokenizer(path).encode, position=file_order(docs(spark, rows))).count() == 2


def test_packing_of_megabytes(spark, path):
    text = " ".join(f"w{i % 977}" for i in range(700_000))
    t = packing.WordTokenizer(path)
    rows = [(1, text, None, None), (1, text, None, None), (None, "a b", None, None)]
    out = packing.pack(docs(spark, rows), lambda: packing.word_tokenizer(path).encode).collect()
    ids = np.frombuffer(t.encode([text])[0], "<u4")
    assert sum(p.length for p in out if p.doc_id == 1) == 2 * len(ids) and all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in out if p.doc_id == 1)


def test_sum_of_squares_rule():
    """The level that a document joins minimises the sum of squared counts."""
    r = random.Random(2)
    p = packing.Packer(16)
    for k in range(500):
        size = r.randrange(1, 16)
        before = p.count.copy()

        def after(level, before=before, size=size):
            n = before.copy()
            if level:
                n[level] -= 1
            if level + size < 16:
                n[level + size] += 1
            return int((n[1:16] ** 2).sum())

        best = min(after(h) for h in range(17 - size) if h == 0 or before[h])
        list(p.place(k, size))
        assert int((p.count[1:16] ** 2).sum()) == best
    left = [s for s in p.close()]
    assert all(sum(x[2] for x in s) in (1, 2, 4, 8, 16) for s in left) and not p.count.any()


def rank_brute(train, text, size=300):
    def grams(t):
        c = Counter()
        for w in "".join(x if x.isalpha() else " " for x in t.lower()).split():
            for ch in w:
                c[ch] += 1
        joined = " " + " ".join("".join(x if x.isalpha() else " " for x in t.lower()).split()) + " "
        if joined.strip():
            for i in range(len(joined) - 1):
                c[joined[i : i + 2]] += 1
            for i in range(len(joined) - 2):
                if joined[i + 1] != " ":
                    c[joined[i : i + 3]] += 1
        return c

    code = lambda g: sum((1 if x == " " else ord(x)) << 21 * (len(g) - 1 - i) for i, x in enumerate(g))
    order = lambda c: [g for _, _, g in sorted((-n, code(g), g) for g, n in c.items())[:size]]
    own = order(grams(text))
    if not own:
        return "und", 0.0
    best = []
    for lang, texts in train.items():
        total = Counter()
        for t in texts:
            total += grams(t)
        rank = {g: i for i, g in enumerate(order(total))}
        best.append((sum(abs(rank[g] - i) if g in rank else size for i, g in enumerate(own)), lang))
    d, lang = min(best)
    return lang, 1 - d / (size * len(own))


def test_language(spark):
    r = random.Random(3)
    syllables = {"en": ["th", "ing", "er", "and"], "fr": ["eau", "é", "ou", "ment"], "de": ["sch", "ein", "ü", "ung"]}
    make = lambda lang, n: " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n)) + ". 12!"
    rows = [(i, make(lang, r.randrange(1, 80)), lang, None) for i, lang in enumerate(["en", "fr", "de"] * 20)]
    test = [(100, "The thing, and", None, None), (101, None, "en", None), (102, "12 %%", "en", None), (103, "Éeau ou", None, None), (104, "x", None, None), (104, "x", None, None)]
    profiles = langid.learn(docs(spark, rows))
    train = {lang: [t for _, t, x, _ in rows if x == lang] for lang in syllables}
    got = [(r_.doc_id, r_.lang_pred, pytest.approx(r_.score)) for r_ in langid.identify(docs(spark, rows + test), profiles).collect()]
    expected = [(i, *(rank_brute(train, t) if t else ("und", 0.0))) for i, t, *_ in rows + test]
    assert sorted(expected) == sorted(got, key=lambda x: x[:2])
    empty = docs(spark, rows).limit(0)
    assert langid.identify(empty, profiles).count() == 0
    assert {x.lang_pred for x in langid.identify(docs(spark, rows), langid.learn(empty)).collect()} == {"und"}


def test_language_held_out(spark):
    from sparkseek.llm.queries import op9_language

    out = op9_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert out and sum(x.lang == x.lang_pred for x in out) / len(out) > 0.9


def rule_brute(host, path):
    best = None
    for rule in URL_RULES:
        own, _, rest = rule.pattern.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest) and (best is None or len(rule.pattern) > len(best.pattern)):
            best = rule
    return (best.pattern, best.verdict) if best else (None, None)


def test_urls(spark):
    urls = ["http://A.Example.COM/en/7?x=1", "https://example.com/en/8#t", "http://com/en/", "http://xcom/en/", "ftp://b.net/de/8", "http://example.net/de/81", "https://c.org/es/?q", "http://d.org/es", "no scheme", None, "", "http://", "http://e.com?/en/", "http://f.com#x/en/", "a://b://c.com/en/x", "http://spam.example.org/x", "http://ok.example.org/fr/1"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("_x", F.lit(1))
    labelled = spark.createDataFrame([(f"http://spam-{i}.example.org/x", 1) for i in range(40)] + [(f"http://good{i}.example.org/fr/{i}", 0) for i in range(200)] + [("http://n.org", None), (None, 0)], "url string, label int")
    model = url_filter.UrlModel().fit(labelled)
    out = url_filter.filter_urls(pages, URL_RULES, model).collect()
    assert len(out) == len(urls) + 1
    for r in out:
        url = urls[r.page_id]
        rest = url.partition("://")[2] if url and "://" in url else ""
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest)
        for stop in "/?#":
            host = host.split(stop)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        rule, verdict = rule_brute(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == (verdict or ("block" if r.block_probability >= 0.5 else "allow"))
    scored = model.score(labelled.where("label is not null").drop("label").withColumn("label", F.col("url").contains("spam").cast("int")))
    assert scored.where((F.col("block_probability") >= 0.5) != (F.col("label") == 1)).count() == 0
    assert {x.verdict for x in url_filter.filter_urls(pages, [], url_filter.UrlModel().fit(labelled.limit(0))).collect()} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0), URL_RULES, model).count() == 0


def url_features_brute(url):
    host, _, path = (url.partition("://")[2]).partition("/")
    host, path = host.lower(), ("/" + path).split("?")[0].split("#")[0]
    entropy = -sum(n / len(host) * math.log2(n / len(host)) for n in Counter(host).values())
    return [len(url), len(host), path.count("/"), sum(c in "0123456789" for c in url) / len(url), sum(c in "0123456789" for c in host), entropy, url.count("?") + url.count("&"), host.count("."), host.count("-")]


def test_url_features_and_splits(spark, monkeypatch):
    """Features by hand, the first split against all splits, and suffixes: common ones by themselves, rare ones as unseen."""
    monkeypatch.setattr(url_filter, "SUFFIX_SHARE", 20)
    r = random.Random(7)
    rows = []
    for i in range(300):
        bad = i % 5 == 0
        name = "".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 9))) + (f"-{r.randrange(99)}" if bad and i % 3 or i % 17 == 0 else "")
        suffix = "rare" if i < 4 else r.choice(["com", "net", "org"])
        rows.append((f"https://{name}.{suffix}/{'x/' * r.randrange(4)}p{i}{'?a=1&b=2' if i % 4 == 0 else ''}", int(bad)))
    rows.append(("https://long.com/" + "a/" * 1_000_000, 0))
    labelled = spark.createDataFrame(rows, "url string, label int")
    model = url_filter.UrlModel().fit(labelled)
    vectors = {x.url: x._x for x in model._vector(model._prepared(labelled, "url")).select("url", "_x").collect()}
    ending = {u: u.partition("://")[2].partition("/")[0].rpartition(".")[2] for u, _ in rows}
    rate = sum(y for _, y in rows) / len(rows)
    for u, _ in rows:
        own = [y for v, y in rows if ending[v] == ending[u]]
        expected = [(sum(own) + 10 * rate) / (len(own) + 10), len(own) / len(rows)] if len(own) * 20 >= len(rows) else [rate, 0.0]
        assert vectors[u] == pytest.approx([*url_features_brute(u), *expected], abs=1e-5)
    assert set(ending.values()) - {x._suffix for x in model.suffixes.collect()} == {"rare"}
    p = 1 / (1 + math.exp(-model.base))
    sums = lambda part: (sum(p - y for _, y in part), len(part) * p * (1 - p))
    gain = lambda part: sums(part)[0] ** 2 / (sums(part)[1] + url_filter.L2)
    sides = {(f, b): ([x for x in rows if sum(vectors[x[0]][f] >= c for c in cuts) < b], [x for x in rows if sum(vectors[x[0]][f] >= c for c in cuts) >= b]) for f, cuts in enumerate(model.cuts) for b in range(1, len(cuts) + 1)}
    best = max(gain(a) + gain(b) for a, b in sides.values() if a and b)
    chosen = sides[model.trees[0][0]]
    assert gain(chosen[0]) + gain(chosen[1]) == pytest.approx(best)
    judged = [url_filter.held_out(labelled, k).first() for k in range(4)]
    assert sum(x.n for x in judged) == len(rows) and sum(x.positive for x in judged) == 60 and sum(x.right for x in judged) > 20


def test_spam_terms_label_every_junk_host():
    junk_hosts = ["casino-win", "cheap-pills", "spam-farm", "free-bets", "ads-track", "adult-x"]
    assert all(re.search(SPAM_TERMS, f"m.{h}.example.net") for h in junk_hosts)
    assert not any(re.search(SPAM_TERMS, f"{h}.example.org") for h in ("downloads", "alphabets", "adulthood", "www.ththon"))


def junk(r, i):
    good = [f"{r.choice('abcdefgh')}{r.choice('aeiou')}{r.choice('lmnr')}{i % 10 and ''}" for _ in range(60)]
    if i % 4 == 0:
        good = [w + "###" for w in good]
    elif i % 8 == 1:
        good = [w for w in good[:6] for _ in range(10)]
    return " ".join(good), int(i % 4 != 0 and i % 8 != 1)


def test_quality(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        text, good = junk(r, i)
        rows.append((i, text, "en", f"s{i % 5}"))
        if i % 2 or i % 3 == 0:
            labels.append((i, good))
    labels += [(3, None), (9999, 1), (None, 0)]
    table = docs(spark, [*rows, (800, None, None, None), (801, "", None, None), (None, "a b c", None, None)])
    model = quality.fit(table, spark.createDataFrame(labels, "doc_id long, quality int"))
    out = quality.score(table, model)
    known = {x[0] for x in labels}
    got = {x.doc_id: x.kept for x in out.select("doc.doc_id", "kept").collect()}
    held = [i for i in range(600) if i not in known]
    truth = {i: junk(random.Random(0), i)[1] for i in range(600)}
    assert held and sum(got[i] == bool(truth[i]) for i in held) / len(held) > 0.97 and len(got) == 603
    assert out.select("doc.*").columns == table.columns
    row = out.first()
    assert all(0 <= row[c] <= 1 for c in ("text_score", "metadata_score", "quality_score"))
    again = quality.fit(table.repartition(5), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert np.array_equal(model.views[0].weights, again.views[0].weights)
    one_class = quality.fit(table, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert quality.score(table, one_class).where("kept").count() == table.count()
    assert quality.score(table.limit(0), model).count() == 0


def test_many_sources_keep_features_of_their_own():
    assert len({quality._meta_slots("en", f"source-{i}", 10) for i in range(200)}) > 100


def test_text_features_are_those_of_words_and_trigrams():
    """Hashed features against a count by hand; equal texts have equal features wherever they stand."""
    import pyarrow as pa

    texts = ["the cat and the dog", "", None, "a\tb  a", "é", "the cat and the dog"]
    got = quality.hashed_features(pa.array(texts))
    assert (got[0] == got[5]).all() and not got[1].any() and not got[2].any()
    assert sorted(x for x in got[0][: quality.WORD_SLOTS] if x) == sorted(round(255 * math.sqrt(n / 5)) for n in (2, 1, 1, 1))
    assert sorted(x for x in got[3][: quality.WORD_SLOTS] if x) == sorted(round(255 * math.sqrt(n / 3)) for n in (2, 1))
    raw = texts[0].encode()
    grams = Counter(raw[i : i + 3] for i in range(len(raw) - 2))
    slot = {g: int(quality.mixed(np.array([g[0] | g[1] << 8 | g[2] << 16], np.uint64))[0] % np.uint64(quality.GRAM_SLOTS)) for g in grams}
    total = np.zeros(quality.GRAM_SLOTS)
    for g, n in grams.items():
        total[slot[g]] += n
    assert (got[0][quality.WORD_SLOTS :] == np.rint(255 * np.sqrt(total / sum(grams.values())))).all()
    row = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en", None] * 3), pa.array(["s"] * 6), pa.array([1, None, 3, 4, 5, 1], pa.int64())], names=list("abcd"))
    text, meta = quality._unpacked(pa.array(quality._packed(row), pa.binary()))
    assert text.shape == (6, quality._TEXT) and meta.shape == (6, quality._META) and np.allclose(text[3, : quality._DENSE], quality.text_features(texts[3]), atol=1e-6)
    assert meta[1, -3] == 1 and meta[0, -3] == 0 and (meta[:, : quality.LANG_SLOTS].sum(1) == 1).all()


def test_quality_exchanges_over_all_unlabelled_documents(spark):
    """One round over 12,000 unlabelled rows hands over what sorting them all does."""
    r = np.random.default_rng(3)
    n = 12_000
    raw = np.zeros((n, 4 * quality._DENSE + quality._HASHED + 16), np.uint8)
    raw[:, : 4 * quality._DENSE] = r.normal(size=(n, quality._DENSE)).astype("<f4").view(np.uint8).reshape(n, -1)
    raw[:, 4 * quality._DENSE : -16] = r.integers(0, 256, (n, quality._HASHED))
    meta = np.c_[r.integers(0, 32, n), r.integers(0, 256, n), np.zeros(n), r.random(n)].astype("<f4")
    raw[:, -16:] = meta.view(np.uint8).reshape(n, 16)
    rows = [(raw[i].tobytes(), None if i % 50 else 1.0) for i in range(n)]
    table = quality.durable(spark.createDataFrame(rows, "x binary, label double").repartition(7))
    pool = quality.SparkPool(table)
    import pyarrow as pa

    own = pool.rows.orderBy("row").collect()
    arrays = quality.ArrayPool(quality._unpacked(pa.array([x.x for x in own], pa.binary())), np.array([x.tie for x in own]))
    views = [quality.View(np.zeros(m), np.ones(m), r.normal(size=m + 1) * k) for m, k in ((quality._TEXT, 1.0), (quality._META, 5.0))]
    for _ in range(2):
        got, expected = pool.take(views, 30, 70), arrays.take(views, 30, 70)
        assert len(own) > 10_000 and all(len(y) for _, y in got)
        for (x, y), (x_, y_) in zip(got, expected, strict=True):
            assert sorted(map(tuple, np.c_[x, y].tolist())) == sorted(map(tuple, np.c_[x_, y_].tolist()))
    everything = quality.surest(views[0], arrays.x[0], 30, 70, np.ones(len(own), bool), arrays.tie)
    odds = views[0].calibrated(arrays.x[0])
    assert [r[3] for r in everything if r[0]] == sorted(np.flatnonzero(odds >= math.log(0.95 / 0.05)), key=lambda i: -odds[i])[:70]


def test_quality_bears_clashing_and_missing_columns(spark):
    r = random.Random(5)
    rows = [(i, junk(r, i)[0], "en", "s") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0 and i % 8 != 1)) for i in range(0, 200, 2)], "doc_id long, quality int").withColumn("label", F.lit(1)).withColumn("id", F.lit("x"))
    table = docs(spark, rows)
    for c in ("_label", "label", "x", "doc", "text_key", "row", "_known", "view", "odds", "text_score"):
        table = table.withColumn(c, F.lit(3))
    twice = table.unionByName(table.limit(20).withColumn("text", F.lit("other words ###")))  # an id with two texts
    for t in (table, twice, table.drop("lang", "source", "n_chars"), table.withColumn("text", F.concat(F.col("text"), F.repeat(F.lit(" word"), F.when(F.col("doc_id") == 7, 600_000).otherwise(0))))):
        out = quality.score(t, quality.fit(t, labels))
        assert out.select("doc.*").columns == t.columns and out.count() == t.count()
        again = quality.score(t.repartition(3), quality.fit(t.repartition(5), labels))
        key = lambda df: sorted((x.doc_id, x.text, x.kept) for x in df.select("doc.doc_id", "doc.text", "kept").collect())
        assert key(out) == key(again)
    assert quality.score(table, quality.fit(table, labels.limit(0))).where("kept").count() == 200
    assert quality.score(table.limit(0), quality.fit(table.limit(0), labels)).count() == 0


def test_views_teach_each_other():
    """A view with few labels learns from the other's sure rows."""
    r = np.random.default_rng(1)
    y = (np.arange(2000) % 2).astype(float)
    views = [np.c_[y + 0.1 * r.normal(size=2000), r.normal(size=2000)], np.c_[r.normal(size=2000), 2 * y + r.normal(size=2000)]]
    model = quality.CoTrained.fit([v[:40] for v in views], y[:40], quality.ArrayPool([v[40:] for v in views]), share=2.5)
    assert sum(a for a, _ in model.handed) > 100
    scores = model.score(views)
    assert ((scores[2] > 0.5) == y).mean() > 0.9


def tone(freq, n, rate=chroma.RATE):
    return np.sin(2 * np.pi * freq * np.arange(n) / rate)


def recording(r, seconds=4):
    notes = [r.choice([220, 247, 262, 294, 330, 349, 392, 440, 523, 587]) for _ in range(seconds * 5)]
    return np.concatenate([tone(f, chroma.RATE // 5) + 0.4 * tone(1.5 * f, chroma.RATE // 5) for f in notes])


def wav(x, rate=chroma.RATE, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.repeat((x * 12000).astype("<i2"), channels).tobytes())
    return out.getvalue()


def test_chroma_is_the_pitch_class():
    c = chroma.chroma(tone(440, 4000).astype(np.float32))
    assert (c.argmax(1) == 0).all()
    c = chroma.chroma(tone(440 * 2 ** (3 / 12), 4000).astype(np.float32))
    assert (c.argmax(1) == 3).all()
    assert len(chroma.chroma(np.zeros(0))) == 0 and chroma.fingerprint(chroma.chroma(np.zeros(10))).shape == (1,)


def test_audio_alignment(spark):
    r, noise = random.Random(8), np.random.default_rng(8)
    base = [recording(r) for _ in range(6)]
    part = base[0][chroma.HOP * 40 : chroma.HOP * 160]
    rows = [(i, wav(x)) for i, x in enumerate(base)]
    rows += [(10, wav(base[1])), (11, wav(base[2] * 0.5 + 0.01 * noise.normal(size=len(base[2])))), (12, wav(np.concatenate((recording(r, 2), part)))), (13, wav(base[3], channels=2)), (14, None), (15, b""), (16, wav(np.zeros(0)))]
    rows += [(10, wav(base[1])), (None, wav(base[1]))]
    table = spark.createDataFrame(rows, "doc_id long, audio binary").withColumn("number", F.lit(1)).withColumn("place", F.lit(1))
    out = {x.doc_id: x for x in chroma.shared_audio(table, min_frames=60, max_error=0.05).collect()}
    assert (out[10].class_id, out[13].class_id) == (1, 3) and out[11].component_id == 2 and out[12].component_id == 0
    assert out[12].match_id == 0 and abs(out[12].match_offset - (40 - 2 * chroma.RATE // chroma.HOP)) <= 1
    assert [out[i].component_id for i in (4, 5, 14, 15, 16)] == [4, 5, 14, 15, 16] and out[14].n_frames == 0
    # recall against all pairs at all offsets
    prints = {i: chroma.fingerprint(chroma.chroma(chroma.samples_of_wav(a))) for i, a in rows if i is not None and a}
    found = total = 0
    for a in prints:
        for b in prints:
            if a < b and min(chroma.best_stretch(chroma.bit_errors(prints[a], prints[b], o), 60) for o in range(-200, 200)) <= 0.05:
                total += 1
                found += out[a].component_id == out[b].component_id
    assert total >= 4 and found / total >= 0.9
    assert chroma.shared_audio(table.limit(0)).count() == 0


def test_audio_recall_with_the_settings_of_the_query(spark):
    """Links of the query against all pairs at all offsets."""
    from sparkseek.llm.queries import op1_chroma

    found = total = 0
    for sf in ("sf0.001", "sf0.01"):
        folder = f"/root/testdata/{sf}"
        out = {x.doc_id: x for x in op1_chroma(spark, folder).collect()}
        texts = {x.doc_id: x.text for x in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
        prints = {i: chroma.fingerprint(chroma.chroma(chroma.samples_of_bytes(t.encode()))) for i, t in texts.items() if t and out[i].class_id == i and out[i].n_frames >= chroma.MIN_FRAMES}
        ids, links = sorted(prints), 0
        for k, b in enumerate(ids):
            for a in ids[:k]:
                errors = np.bitwise_count(prints[a][:, None] ^ prints[b][None, :])
                n, m = errors.shape
                sums = np.zeros((n + 1, m + 1), np.int32)
                for i in range(n):
                    sums[i + 1, 1:] = sums[i, :-1] + errors[i]
                w = chroma.MIN_FRAMES
                links += (sums[w:, w:] - sums[:-w, :-w]).min() <= chroma.MAX_BIT_ERROR * 32 * w
        own = sum(x.n_links for i, x in out.items() if x.class_id == i)
        assert own <= links
        found, total = found + own, total + links
    assert total >= 4 and found / total >= 0.9


def test_audio_shared_past_an_earlier_holder(spark):
    """Two recordings share audio whose numbers an earlier one holds too, at other offsets."""
    r = random.Random(2)
    shared, step = recording(r, 4)[: 240 * chroma.HOP], 48 * chroma.HOP
    cuts = [shared[k:][:step] for start in range(0, step, step // 3) for k in reversed(range(start, len(shared) - step + 1, step))]
    rows = [(0, wav(np.concatenate(cuts)))] + [(i, wav(np.concatenate((recording(r, 2 * i), shared, recording(r, 2))))) for i in (1, 2)]
    out = {x.doc_id: x for x in chroma.shared_audio(spark.createDataFrame(rows, "doc_id long, audio binary"), min_frames=60, max_error=0.05).collect()}
    assert [out[i].component_id for i in range(3)] == [0, 1, 1]
    assert (out[2].n_links, out[2].match_id) == (1, 1) and abs(out[2].match_offset + 2 * chroma.RATE // chroma.HOP) <= 1


def test_chroma_sends_no_block_for_every_pair(spark, monkeypatch):
    r = np.random.default_rng(8)
    rows = [(i, wav(recording(r, 8))) for i in range(40)]
    rows += [(100 + i, wav(chroma.samples_of_wav(a)[chroma.HOP * 40 :])) for i, a in rows[:10]]
    table = spark.createDataFrame(rows, "doc_id long, audio binary").cache()
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty()
        found = context.statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    out, sent = {}, {}
    for blocks in (1, 4, 16):
        monkeypatch.setattr(chroma, "MIN_BLOCKS", blocks)
        before = written()
        out[blocks] = sorted(chroma.shared_audio(table, min_frames=60, max_error=0.05).collect())
        sent[blocks] = written() - before
    assert out[1] == out[4] == out[16] and sum(x.n_links for x in out[1]) >= 10
    assert sent[16] < 1.5 * sent[1]



@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_audio_links_are_those_of_all_holders(monkeypatch, most):
    monkeypatch.setattr(chroma, "MAX_VOTES", most)
    r = np.random.default_rng(4)
    prints = [r.integers(0, 40, r.integers(0, 40)).astype(np.uint32) * np.uint32(0x9E3779B1) for _ in range(24)]
    prints[5][3:20], prints[11] = prints[2][:17] if len(prints[2]) >= 17 else prints[5][3:20], np.concatenate((prints[7], prints[7]))
    ids = r.permutation(len(prints))
    blocks = [chroma._Block(ids[k::2], prints[k::2]) for k in (0, 1)]
    whole = chroma._Block(ids, prints)
    by_id = dict(zip(ids.tolist(), prints, strict=True))
    expected = {}
    for b in by_id:
        for a in range(b):
            voted = Counter(int(i - j) for j, x in enumerate(by_id[b]) for i, y in enumerate(by_id[a]) if x == y)
            error = lambda o, a=a, b=b: chroma.best_stretch(chroma.bit_errors(by_id[a], by_id[b], o), 4)
            tries = {o + d for o, n in voted.items() if n >= 2 for d in ((-1, 0, 1) if error(o) <= chroma.NEIGHBOUR * 0.3 else (0,))}
            found = min((chroma.best_stretch(chroma.bit_errors(by_id[a], by_id[b], o), 4) for o in tries), default=1.0)
            if found <= 0.3:
                expected[b, a] = pytest.approx(found)
    in_one = [x for part in chroma._links(whole, whole, True, 2, 4, 0.3) for x in zip(*part, strict=True)]
    parts = [(blocks[0], blocks[0], True), (blocks[0], blocks[1], False), (blocks[1], blocks[1], True)]
    in_two = [x for p in parts for part in chroma._links(*p, 2, 4, 0.3) for x in zip(*part, strict=True)]
    for got in (in_one, in_two):
        assert len(got) == len(expected) > 10 and {(b, a): e for b, a, _, e in got} == expected
        assert all(chroma.best_stretch(chroma.bit_errors(by_id[a], by_id[b], o), 4) == pytest.approx(e) for b, a, o, e in got)


def test_pipeline(spark):
    import corpus_pipeline as pipeline
    from tests.llm.test_exact_and_text import exact_brute, join_brute

    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    table = read("documents")
    stages = dict(pipeline.STAGES)
    good = stages["quality classifier"](spark, table, SF).cache()
    labels = {x.doc_id: x.quality for x in read("labels").collect()}
    kept = {x.doc_id for x in good.collect()}
    assert good.columns == table.columns and sum((i in kept) == bool(q) for i, q in labels.items()) / len(labels) > 0.95
    once = stages["exact dedup"](spark, good, SF).cache()
    rows = [(x.doc_id, x.text) for x in good.collect()]
    assert {x.doc_id for x in once.collect()} == {k for k, _ in exact_brute(rows).values()}
    apart = stages["n-gram Jaccard join"](spark, once, SF).cache()
    rows = [(x.doc_id, x.text) for x in once.collect()]
    assert {x.doc_id for x in apart.collect()} == {c for _, c in join_brute(rows, 5, 80).values()}
    mixed = stages["mixing sources to target weights"](spark, apart, SF).cache()
    taken = {x.doc_id: x.taken for x in mixing.mix(apart).collect() if x.taken}
    got = Counter()
    for x in mixed.collect():
        got[x.doc_id] += len(words(x.text))
        assert x.n_chars == len(x.text)
    assert dict(got) == taken and mixed.columns == table.columns
    packed = stages["packing"](spark, mixed, SF).collect()
    t = packing.WordTokenizer(word_tokenizer_path())
    assert sum(p.length for p in packed) == sum(len(b) // 4 for b in t.encode([x.text for x in mixed.collect()]))
    assert pipeline.run(spark, SF).agg(F.sum("length")).first()[0] == sum(p.length for p in packed)
