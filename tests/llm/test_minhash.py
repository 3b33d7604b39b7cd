import random

import numpy as np
import pyarrow as pa
import pytest

from tarnsieve.llm import minhash as m
from tarnsieve.llm import common
from tests.llm.cases import SCHEMA, docs, empty, odd_columns, prose, same_rows, weird


def jaccard(a, b):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + m.SHINGLE]) for i in range(max(1, len(w) - m.SHINGLE + 1))} if w else set()

    x, y = grams(a), grams(b)
    return len(x & y) / max(1, len(x | y))


def edited(text, share, seed):
    r = random.Random(seed)
    w = text.split()
    return " ".join(prose(seed * 1000 + i, 1) if r.random() < share else x for i, x in enumerate(w))


def test_estimate_is_corrected_for_collisions():
    r = np.random.default_rng(1)
    errors = []
    for i in range(60):
        a = prose(i, 150)
        b = edited(a, float(r.random()) * 0.4, i)
        _, lanes, _ = m.signatures(pa.array([a, b], pa.large_string()))
        errors.append(float(m.similarity(m.equal_fields(lanes[0], lanes[1]))) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08
    apart = [m.similarity(m.equal_fields(*m.signatures(pa.array([prose(i, 90), prose(i + 5000, 90)], pa.large_string()))[1])) for i in range(40)]
    assert abs(np.mean(apart)) < 0.03


def brute_components(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return [find(i) for i in range(n)]


def test_bucket_edges_against_all_pairs():
    r = np.random.default_rng(3)
    for _ in range(20):
        base = r.integers(0, 1 << 63, (4, m._LANES), dtype=np.uint64)
        n = 30
        sigs = base[r.integers(0, 4, n)] ^ np.where(r.random((n, m._LANES)) < 0.5, r.integers(0, 1 << 63, (n, m._LANES), dtype=np.uint64) & r.integers(0, 1 << 63, (n, m._LANES), dtype=np.uint64) & r.integers(0, 1 << 63, (n, m._LANES), dtype=np.uint64), 0).astype(np.uint64)
        ids = r.permutation(n).astype(np.int64)
        pairs = [(int(ids[i]), int(ids[j])) for i in range(n) for j in range(i) if m.similarity(m.equal_fields(sigs[i], sigs[j])) >= m.THRESHOLD - 1e-9]
        assert brute_components(n, m.bucket_edges(ids, sigs, m.THRESHOLD)) == brute_components(n, pairs)


@pytest.mark.parametrize("edges", [[], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)], [(i, (i * 7 + 3) % 50) for i in range(50)], [(1, 1), (2, 1), (1, 2), (9, 8)]])
def test_components(spark, edges):
    n = 70
    want = {i: r for i, r in enumerate(brute_components(n, edges)) if r != i}
    got = {r.node: r.root for r in m.components(spark.createDataFrame(edges, "a long, b long")).collect() if r.node != r.root}
    assert got == want


def corpus():
    texts = [prose(i, 80 + i % 50) for i in range(120)]
    for i in range(40):
        texts.append(edited(texts[i], 0.08, i + 1))  # near copies
    texts += [texts[50]] * 25 + [texts[51].upper()]
    return texts


def test_recall_against_brute_force(spark):
    texts = corpus()
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.7]
    root, size = {}, {}
    for r in m.near_duplicates(docs(spark, texts)).collect():
        root[r.doc_id] = r.class_id
        size[r.class_id] = size.get(r.class_id, []) + [(r.doc_id, r.links)]
    assert all(min(v)[0] == c and {n for _, n in v} == {len(v) - 1} for c, v in size.items())
    assert np.mean([root.get(i, i) == root.get(j, j) for i, j in pairs]) >= 0.9
    together = [(i, j) for i in root for j in root if i < j and root[i] == root[j]]
    assert all(jaccard(texts[i], texts[j]) > 0.4 for i, j in together)


def test_one_of_each_group_stays(spark):
    d = docs(spark, corpus())
    gone = {r.doc_id for r in m.near_duplicates(d).collect() if r.doc_id != r.class_id}
    assert {r.doc_id for r in m.deduplicate(d).collect()} == set(range(d.count())) - gone
    assert same_rows(m.deduplicate(d), m.deduplicate(d.repartition(5)))


def test_weird_rows(spark):
    d = weird(spark)
    out = m.deduplicate(d)
    assert out.columns == d.columns
    left = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
    # 6 (three times) and the first 7 are one text; all texts without words stay
    assert left == [(False, i) for i in (1, 2, 3, 4, 5, 6, 7, 8, 9)] + [(True, 0), (True, 0)]
    assert sorted(tuple(r) for r in m.near_duplicates(d).collect()) == [(6, 6, 3)] * 3 + [(7, 6, 3)]
    assert m.deduplicate(empty(spark)).count() == 0 and m.near_duplicates(empty(spark)).count() == 0


def test_null_ids_come_last(spark):
    rows = [(None, prose(1), "en", "a", 1), (5, prose(1), "en", "a", 1), (None, prose(2), "en", "a", 1), (None, prose(2), "en", "a", 1)]
    out = m.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0) for r in out) == [0, 5]


def test_any_columns(spark):
    d = odd_columns(spark, [(6, prose(2)), (6, prose(2)), (7, prose(2)), (8, prose(3)), (None, None)])
    out = m.deduplicate(d)
    assert out.columns == d.columns and out.dtypes == d.dtypes and sorted((r[0] or 0) for r in out.collect()) == [0, 6, 8]


def test_rows_of_one_unit_are_told_by_maps(spark):
    d = spark.sql("select 1L as doc_id, 'one two three' as text, map('a', id) as m from range(5)")
    assert [r.m for r in m.deduplicate(d).collect()] == [{"a": 0}] == [r.m for r in m.deduplicate(d.repartition(5)).collect()]


def _nodes(spark, sigs, bands):
    rows = [(i, [int(x) for x in s.view(np.int64)], b) for i, (s, b) in enumerate(zip(sigs, bands))]
    return common.cut(spark.createDataFrame(rows, "sh long, sig array<long>, bands array<long>"))


@pytest.mark.parametrize("block", [2048, 7])
def test_buckets_against_all_pairs(spark, block):
    """Chains within buckets, found in blocks of any size."""
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, (5, m._LANES), dtype=np.uint64)
    sigs, last = [], {}
    for _ in range(90):
        b = int(r.integers(5))
        s = last.get(b, base[b]).copy()
        f = r.choice(m.PERMUTATIONS, int(r.integers(20, 48)), replace=False)
        for x in f:
            s[x // m._FIELDS] ^= np.uint64(1) << np.uint64(m.BITS * (x % m._FIELDS))
        last[b] = s
        sigs.append(s)
    bands = [[int(i % 3), 10 + int(i % 2), 100 + i] for i in range(90)]
    pairs = [(i, j) for i in range(90) for j in range(i) if {*bands[i]} & {*bands[j]} and m.similarity(m.equal_fields(sigs[i], sigs[j])) >= m.THRESHOLD - 1e-9]
    want = {i: x for i, x in enumerate(brute_components(90, pairs)) if x != i}
    assert {x.node: x.root for x in m.links(_nodes(spark, sigs, bands), block=block).collect() if x.node != x.root} == want and want


def test_a_bucket_of_many_unlike_members(spark):
    r = np.random.default_rng(9)
    n = 6_000
    sigs = r.integers(0, 1 << 63, (n, m._LANES), dtype=np.uint64)
    sigs[n - 1] = sigs[n - 2]
    sigs[n - 1, 0] ^= np.uint64(1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m._LANES), pa.array(sigs.view(np.int64).ravel()))
    bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(np.zeros(n, np.int64)))
    nodes = common.cut(spark.createDataFrame(pa.table({"sh": pa.array(np.arange(n)), "sig": lists, "bands": bands})))
    assert [(x.node, x.root) for x in m.links(nodes).collect()] == [(n - 1, n - 2)]
