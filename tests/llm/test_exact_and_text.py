"""Exact dedup, repeated phrases, line spread and n-gram join against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkseek.llm import common, components, exact_dedup, jaccard_join, line_spread, repeated_phrases, textscan
from tests.llm.helpers import corpus, docs, words


def exact_brute(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i))
    return {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}


def test_exact(spark):
    rows = corpus() + [(900, "a b\tc", None, None), (901, "abc", None, None), (902, "a bc ", None, None), (903, "x\u00a0y", None, None), (904, "xy", None, None)]
    index = exact_dedup.DigestIndex(spark)
    out = index.ingest(docs(spark, rows)).collect()
    expected = exact_brute(rows)
    assert {r.doc_id: (r.keep_id, r.group_size) for r in out} == expected
    assert {r.doc_id for r in out if r.kept} == {k for k, _ in expected.values()} and len(out) == len(rows)
    # the index persists: what it has is not new again
    more = exact_dedup.exact_dedup(docs(spark, [(2000, "abc"), (2001, "fresh text")]), index)
    assert [r.doc_id for r in more.collect()] == [2001] and index.read().count() == len({k for k, _ in expected.values()}) + 1
    plan = spark.table(index.table)._jdf.queryExecution().toString()
    assert "digest" in plan and spark.sql(f"DESCRIBE EXTENDED {index.table}").where("col_name = 'Bucket Columns'").first().data_type == "[`digest`]"


def test_exact_repeats_nulls_and_empty(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, None), (3, "")]
    out = exact_dedup.DigestIndex(spark).ingest(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in out) == [("1", "1", 3, False), ("1", "1", 3, True), ("2", "2", 2, True), ("3", "2", 2, False), ("None", "1", 3, False), ("None", "None", 1, True)]
    d = docs(spark, rows)
    assert exact_dedup.exact_dedup(d, exact_dedup.DigestIndex(spark)).columns == d.columns
    for rows, left in (
        ([(1, "a"), (None, "a"), (None, "b")], [("1", "a"), ("None", "b")]),
        ([(1, "a b"), (1, "a  b")], [("1", "a  b")]),
        ([(1, "a b"), (1, "a\tb"), (1, "a b")], None),
        ([(1, "a"), (2, "b"), (2, "a")], [("1", "a"), ("2", "b")]),
        ([(None, "x")] * 3, [("None", "x")]),
        ([(1, "é" * 3_000_000), (2, " ".join("é" * 3_000_000)), (3, "é" * 2_999_999)], [("2", None), ("3", None)]),
    ):
        kept = exact_dedup.exact_dedup(docs(spark, rows).repartition(3), exact_dedup.DigestIndex(spark)).collect()
        if left is None:
            assert len(kept) == 1
        else:
            assert sorted((str(r.doc_id), r.text if len(r.text) < 9 else None) for r in kept) == left


def test_exact_again(spark):
    """A batch that comes again keeps the same rows and adds nothing; a batch after it does not get them."""
    index = exact_dedup.DigestIndex(spark)
    first, second = docs(spark, [(1, "a"), (2, "a"), (3, "b")]), docs(spark, [(4, "a"), (5, "c"), (6, "c")])
    kept = lambda d, **k: sorted(r.doc_id for r in exact_dedup.exact_dedup(d, index, **k).collect())
    assert [kept(first), kept(first.repartition(3)), kept(second, batch="two"), kept(first), kept(second, batch="two")] == [[1, 3], [1, 3], [5], [1, 3], [5]]
    assert index.read().count() == 3
    # a batch of which only a part was appended before the job was lost
    index._write(spark.createDataFrame([], index.read().schema), "append")
    partly = exact_dedup.DigestIndex(spark)
    partly._write(spark.createDataFrame([(bytes(index.read().where("keep_id = 1").first().digest), 1, 1, "x")], "digest binary, keep_id long, n_points long, batch string"), "append")
    assert sorted(r.doc_id for r in partly.ingest(first, batch="x").where("kept").collect()) == [1, 3] and partly.read().count() == 2
    found = index.ingest(first)
    index.drop()
    assert found.count() == 3 and not spark.catalog.tableExists(index.table)
    assert exact_dedup.exact_dedup(first.limit(0), exact_dedup.DigestIndex(spark)).count() == 0


def phrases_brute(rows, window=20):
    seen, out = set(), {}
    for i, text, *_ in sorted(r for r in rows if r[0] is not None):
        w = words(text)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            if key in seen:
                gone[j : j + window] = [True] * window
            seen.add(key)
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [1000, 2])  # 2: the common anchors go by window
def test_phrases(spark, hot, monkeypatch):
    monkeypatch.setattr(repeated_phrases.repeated_windows, "__defaults__", (*repeated_phrases.repeated_windows.__defaults__[:-1], hot))
    monkeypatch.setattr(repeated_phrases, "SHARD_SEGMENTS", 7)
    rows = corpus(2, 160)
    out = repeated_phrases.remove_repeated(docs(spark, rows).repartition(5)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == phrases_brute(rows)
    texts = {i: words(t) for i, t, *_ in rows}
    for r in out:
        spans = list(zip(r.spans[::2], r.spans[1::2], strict=True))
        assert sum(b - a for a, b in spans) == r.n_removed
        assert r.kept.split() == [w for j, w in enumerate(texts[r.doc_id]) if not any(a <= j < b for a, b in spans)]


def test_phrases_edges(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (5, text), (None, text), (9, text), (6, None)]
    out = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in repeated_phrases.remove_repeated(docs(spark, rows)).collect())
    assert out == [("5", 30, 0), ("5", 30, 0), ("6", 0, 0), ("9", 30, 30), ("None", 30, 0)]
    assert repeated_phrases.remove_repeated(docs(spark, rows).limit(0)).count() == 0


def test_scan_words_and_runs():
    import pyarrow as pa

    texts = ["a bb\tccc", "", "  x ", "é\u00a0é y", "a bb ccc a bb ccc"]
    s = textscan.scan(pa.array(texts))
    own = [[bytes(s.data[b:e]).decode() for b, e in zip(s.begin[s.first[t] : s.first[t + 1]], s.end[s.first[t] : s.first[t + 1]], strict=True)] for t in range(len(texts))]
    assert own == [words(t) for t in texts]
    h = s.hashes()
    flat = [w for t in own for w in t]
    assert len(set(h.tolist())) == len(set(flat))
    for k in (1, 2, 3, 5):
        r = textscan.runs(h, k)
        assert len(set(r.tolist())) == len({tuple(flat[i : i + k]) for i in range(len(flat) - k + 1)})


def lines_brute(rows, least):
    sites = defaultdict(set)
    trim = lambda s: s.strip(" \t\n\x0b\x0c\r")
    for _, text, _, source in rows:
        for line in (text or "").split("\n"):
            sites[trim(line)].add(source)
    out = {}
    for i, text, _, _ in rows:
        own = [] if text is None else text.split("\n")
        kept = [x for x in own if not trim(x) or len(sites[trim(x)]) < least]
        out[i] = (len(own), len(own) - len(kept), "\n".join(kept))
    return out


def test_lines(spark):
    rows = [(i, f"only {i}\n{' ' * (i % 2)}common\nrare {i % 3}\n\nsite {i % 12}", None, f"s{i % 12}" if i % 12 else None) for i in range(120)] + [(500, None, None, "s1"), (501, "", None, "s1"), (502, "common", None, None)]
    for least in (3, 10, 12):
        out = line_spread.remove_boilerplate(docs(spark, rows), least).collect()
        assert {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in out} == lines_brute(rows, least)
    assert line_spread.remove_boilerplate(docs(spark, rows).limit(0)).count() == 0
    twice = line_spread.remove_boilerplate(docs(spark, [(1, "a", None, "x"), (1, "a", None, "x"), (None, "a", None, "y")]), 2)
    assert [(r.n_lines, r.n_removed) for r in twice.collect()] == [(1, 1)] * 3


def join_brute(rows, n=4, percent=85):
    lower = str.maketrans({i: i + 32 for i in range(65, 91)})
    sets, parent = {}, {}
    for i, text, *_ in rows:
        w = words((text or "").translate(lower))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("n", "percent", "small"), [(4, 85, False), (5, 80, True), (2, 60, False)])
def test_join(spark, n, percent, small, monkeypatch):
    if small:  # large buckets, large groups and buckets of many unlike sets
        for name, value in {"BUCKET_ROWS": 12, "GROUP_ROWS": 3, "LEADERS": 3}.items():
            monkeypatch.setattr(jaccard_join, name, value)
    import random

    r = random.Random(n)
    rows = corpus(3, 40 if small else 120)
    base = [f"q{r.randrange(10**6)}" for _ in range(120)]
    for i in range(20 if small else 60):  # a chain of near copies: ends differ much, neighbours little
        base = list(base)
        base[r.randrange(120)] = f"q{r.randrange(10**6)}"
        rows.append((1000 + i, " ".join(base).upper() if i % 2 else " ".join(base), None, None))
    out = jaccard_join.link_groups(docs(spark, rows).repartition(6), n, percent).collect()
    expected = join_brute(rows, n, percent)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in out} == expected
    kept = jaccard_join.one_of_each_group(docs(spark, rows), n, percent)
    assert {x.doc_id for x in kept.collect()} == {c for _, c in expected.values()} and kept.columns == docs(spark, rows).columns


def test_signatures_miss_no_pair():
    """Any two sets within the threshold share a signature."""
    import random

    import numpy as np

    r = random.Random(4)
    for _ in range(300):
        size = r.choice([7, 12, 13, 30, 77, 200, 703, 708, 1500, 3000])
        a = {r.getrandbits(64) for _ in range(size)}
        b = set(a)
        for _ in range(r.randrange(1, max(2, size // 6))):
            if r.random() < 0.5:
                b.discard(r.choice(sorted(b)))
            else:
                b.add(r.getrandbits(64))
        if b and len(a & b) * 100 >= 85 * len(a | b) and a != b:
            x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
            assert set(jaccard_join.signatures(x, 85).tolist()) & set(jaccard_join.signatures(y, 85).tolist())
            for partition in (1, 2):
                assert set(jaccard_join.signatures(x, 85, partition).tolist()) & set(jaccard_join.signatures(y, 85, partition).tolist())
            p, q = (jaccard_join.Sketch(len(s), jaccard_join.sketch(s)) for s in (x, y))
            assert p.near(q, 85) and q.least_difference(p) <= len(a ^ b)
            assert p.least_difference(jaccard_join.Sketch(3, jaccard_join.sketch(x[:3]))) <= len(x) - 3


def members_of(sets, roots):
    return [(jaccard_join._short(s), root, jaccard_join.Sketch(len(s), jaccard_join.sketch(s))) for s, root in zip(sets, roots, strict=True)]


def test_buckets_put_out_members_not_pairs():
    """A bucket of 1,000 unlike sets is split; one of two families puts out no far pairs, and groups of several parts cover every near pair."""
    import numpy as np

    r = np.random.default_rng(6)
    new = lambda n: np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
    unlike = [new(100) for _ in range(1000)]
    rows = list(jaccard_join.Bucket(1, members_of(unlike, range(1000)), 85, 999).undecided())
    assert len(rows) == 1000 and all(x[4] for x in rows)
    assert list(jaccard_join.Bucket(1, members_of(unlike, range(1000)), 85, None).undecided()) == []
    one, two = new(200), new(200)
    families = [np.unique(np.concatenate((base[:-8], new(8)))) for base in (one, two) for _ in range(600)]
    assert list(jaccard_join.Bucket(1, members_of(families, [0] * 600 + [1] * 600), 85, 256).undecided()) == []
    near = families + [np.unique(np.concatenate((one[:-20], new(20))))]
    rows = list(jaccard_join.Bucket(1, members_of(near, [0] * 600 + [1] * 600 + [2]), 85, 256).undecided())
    assert {x[3] for x in rows} == {0, 2} and len({x[2] for x in rows if x[1]}) == len([x for x in rows if x[1]]) <= 600
    by_short = dict(zip([m[0] for m in members_of(near, range(1201))], near, strict=True))
    import pyarrow as pa

    batch = jaccard_join._batch(sorted((g, m, s, root, by_short[s].tobytes()) for g, m, s, root, _ in rows), "grp long, major boolean, short long, root long, elements binary")
    out = [x for b in jaccard_join._joining(iter([batch]), 85) for x in b.to_pylist()]
    some = any(jaccard_join.linked(near[-1], x, 85) for x in families[:600])
    assert isinstance(batch, pa.RecordBatch) and len(out) == some


def test_repeated_rows_are_verified_once(spark, monkeypatch):
    """300 rows each of two near copies: the groups hold one row for each of the two texts."""
    text = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(text))] * 300 + [(2, " ".join([*text, "more"]))] * 300
    sizes, whole = [], jaccard_join._Join.verified

    def verified(self, groups):
        sizes.append(groups.count())
        return whole(self, groups)

    monkeypatch.setattr(jaccard_join._Join, "verified", verified)
    out = jaccard_join.link_groups(docs(spark, rows)).collect()
    assert {x.component_id for x in out} == {1} and len(out) == 600 and sizes == [2]


def test_join_edges(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (5, text), (None, text), (9, text.upper()), (6, None), (7, "a b"), (8, "A B"), (10, "")]
    out = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.link_groups(docs(spark, rows)).collect())
    assert out == [("10", 0, "10"), ("5", 27, "5"), ("5", 27, "5"), ("6", 0, "6"), ("7", 1, "7"), ("8", 1, "7"), ("9", 27, "5"), ("None", 27, "None")]
    assert jaccard_join.link_groups(docs(spark, rows).limit(0)).count() == 0
    # rows that share an id: each by its own text
    other = " ".join(f"v{i}" for i in range(30))
    rows = [(1, text), (2, text.upper()), (2, other), (3, other + " x"), (4, None), (None, text)]
    out = sorted((str(r.doc_id), str(r.component_id)) for r in jaccard_join.link_groups(docs(spark, rows)).collect())
    assert out == [("1", "1"), ("2", "1"), ("2", "2"), ("3", "2"), ("4", "4"), ("None", "None")]
    kept = jaccard_join.one_of_each_group(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == sorted([("1", text), ("2", other), ("4", ""), ("None", text)])


def test_components(spark):
    import random

    r = random.Random(9)
    links = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(8, 30)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(1, 1)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_keys_join_like_others(spark):
    from sparkseek.llm.common import join_hot

    rows = spark.range(3000).select(F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), F.col("id").alias("v"))
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("most")).where("k <> 'k3'")
    got = join_hot(rows, table, "k", F.col("n"), 3000, F.concat(F.lit("spread"), F.col("v")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(table, "k").select("k", "v", "n", "most").collect()))
    left = join_hot(rows, table, "k", F.col("n"), 3000, F.concat(F.lit("spread"), F.col("v")), how="left")
    assert left.count() == 3000 and left.where("n is null").count() == 20


def _broadcasting(spark, run):
    """How many of the plans that run() executes hold a broadcast join."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    before = store.executionsCount()
    run()
    bus.waitUntilEmpty()
    plans = store.executionsList()
    return sum("BroadcastHashJoin" in plans.apply(i).physicalPlanDescription() for i in range(before, plans.size()))


def test_small_joins_are_not_built_in_the_driver(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 9], "a long, b long")
    assert _broadcasting(spark, lambda: components.components(links)) == 0
    texts = docs(spark, corpus()).selectExpr("doc_id AS id", "text")
    hinted = 2  # join_hot of the stars, and of the components
    assert _broadcasting(spark, lambda: jaccard_join.link_groups(texts, id_col="id")) <= hinted
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


def test_repeated_phrases_reads_texts_twice_and_leaves_no_table(spark):
    rows = corpus(3, 60)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    source = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    tables = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "tables"
    before = set(tables.glob("*"))
    out = repeated_phrases.remove_repeated(source.mapInArrow(counted, source.schema)).collect()
    assert sum(x.n_removed for x in out) > 0 and len(out) == len(rows)
    assert read.value <= 2 * len(rows), read.value  # once for anchors, once for the texts themselves
    assert set(tables.glob("*")) == before


def test_durable_steps_give_the_drivers_memory_back(spark, monkeypatch):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()

    def full_collections():
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    trims, trim = [], getattr(common, "_trim_native_heap", None)
    monkeypatch.setattr(common, "HEAP_SHARE", 0, raising=False)
    monkeypatch.setattr(common, "COLLECT_S", 0, raising=False)
    monkeypatch.setattr(common, "_trim_native_heap", lambda spark: trims.append(trim(spark)), raising=False)
    before = full_collections()
    assert common.durable(spark.range(3)).count() == 3
    assert full_collections() > before and len(trims) == 1  # and this JVM has the command, or nothing would be added
    monkeypatch.setattr(common, "COLLECT_S", 1000)
    before = full_collections()
    common.durable(spark.range(3))
    assert full_collections() == before and len(trims) == 1
