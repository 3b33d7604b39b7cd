import numpy as np
import pytest

from tarnsieve.llm import mixing as m
from tests.llm.cases import SCHEMA, empty, odd_columns, same_rows, weird


def test_flight_keeps_both_totals():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 3000):
        p, t = r.random(n), r.integers(0, 500, n).astype(float)
        out = m.flight(p, t, r.permutation(n), r.random(n))
        assert abs(out.sum() - p.sum()) < 1e-6 * max(1, n) and abs(out @ t - p @ t) < 1e-5 * max(1, p @ t)
        assert ((out > 0) & (out < 1)).sum() <= 2
        landed = m.landing(out, r.random(n))
        assert set(landed.tolist()) <= {0.0, 1.0} and abs(landed.sum() - p.sum()) < 1 + 1e-6


def test_inclusion_probabilities():
    p = np.array([0.2, 0.5, 0.7, 0.9, 0.4, 0.3])
    t = np.array([3.0, 9, 1, 4, 4, 7])
    total = np.zeros(6)
    for seed in range(4000):
        r = np.random.default_rng(seed)
        total += m.landing(m.flight(p, t, r.permutation(6), r.random(6)), r.random(6))
    assert np.abs(total / 4000 - p).max() < 0.04


def corpus(spark, n=3000):
    r = np.random.default_rng(2)
    rows = []
    for i in range(n):
        words = int(r.integers(1, 60))
        rows.append((i, " ".join(f"w{j}" for j in range(words)), "en", ["a", "b", "c"][int(i % 10 > 5) + int(i % 10 > 8)], 0))
    return spark.createDataFrame(rows, SCHEMA)


def probabilities(tokens, weights):
    """Inclusion probabilities by dictionaries."""
    w = {s: t**m.ALPHA if weights is None else weights.get(s, 0) for s, t in tokens.items()}
    ratios = {s: t / w[s] for s, t in tokens.items() if w[s] and t}
    large = [x for s, x in ratios.items() if tokens[s] >= m.SMALL * sum(tokens.values())]
    limit = min(large or ratios.values(), default=0)
    return {s: min(1, w[s] * limit / t) if t else float(weights is None or w[s] > 0) for s, t in tokens.items()}


def brute(rows, weights, seed, chunk):
    """Rows (doc_id, text, source) that stay, by the flight and landing of each source's chunks, one after another."""
    by = {}
    for u, s, t in rows:
        by.setdefault(s, []).append((u, t))
    p = probabilities({s: sum(t for _, t in v) for s, v in by.items()}, weights)
    kept = {u for s, v in by.items() if p[s] >= 1 - 1e-9 for u, _ in v}
    for s, v in by.items():
        if 1e-9 < p[s] < 1 - 1e-9:
            assert len(v) <= chunk
            u, t = np.array(sorted(v)).T
            q = m.flight(np.full(len(u), p[s]), t.astype(float), np.lexsort((u, m._draws(u, seed + 1))), m._draws(u, seed))
            kept |= set(u[m.landing(q, m._draws(u, seed + 2)) == 1].tolist())
    return kept


@pytest.mark.parametrize("weights", [None, {"a": 3, "b": 1, "c": 1}, {"a": 1}])
def test_query_against_brute_force(spark, weights):
    d = corpus(spark, 1500)
    units = [(r.u, r.s, r.tokens) for r in m._units(d).collect()]
    assert {r.u for r in m.chosen_units(d, weights).collect()} == brute(units, weights, m.SEED, m.CHUNK)


def test_small_sources_set_no_bound(spark):
    rows = [(i, "w " * 50, "en", "big", 0) for i in range(4000)] + [(9000, "one two", "en", "stray", 0)]
    out = m.mix(spark.createDataFrame(rows, SCHEMA)).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in out} == {"big": 4000, "stray": 1}


def test_many_sources(spark):
    d = spark.range(60_000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 50 as int)) as text", "concat('h', id % 30000) as source")
    out = m.chosen_units(d, alpha=0.5)
    assert 0 < out.count() < 60_000


def test_any_columns(spark):
    d = odd_columns(spark, [(i, "w " * (i + 1)) for i in range(30)])
    out = m.mix(d, {"s": 1})
    assert out.columns == d.columns and out.count() == 30


def test_chunks_run_over_batches(spark):
    import pyarrow as pa

    r = np.random.default_rng(4)
    s = np.sort(r.integers(0, 6, 200))
    whole = pa.RecordBatch.from_arrays([pa.array(r.permutation(200)), pa.array([None if x == 0 else f"s{x}" for x in s], pa.string()), pa.array(r.integers(1, 99, 200)), pa.array(np.full(200, 0.4)), pa.array(np.zeros(200, np.int64))], names=["u", "s", "tokens", "p", "c"])
    for last in (True, False):
        one = pa.Table.from_batches(m._level(1, last)(iter([whole])))
        many = pa.Table.from_batches(m._level(1, last)(iter([whole.slice(i, 7) for i in range(0, 200, 7)])))
        assert one.to_pylist() == many.to_pylist()


@pytest.mark.parametrize("weights, chunk", [({"a": 1, "b": 1, "c": 1}, 2048), ({"a": 5, "b": 3, "c": 1}, 100), (None, 100)])
def test_weights_are_met(spark, monkeypatch, weights, chunk):
    monkeypatch.setattr(m, "CHUNK", chunk)
    d = corpus(spark)
    have = {r.source: r for r in m._units(d).groupBy("s").agg({"tokens": "sum"}).toDF("source", "t").collect()}
    p = probabilities({s: r.t for s, r in have.items()}, weights)
    rows = m.mix(d, weights).collect()
    for s, r in have.items():
        kept = [len(x.text.split()) for x in rows if x.source == s]
        n = sum(1 for x in d.collect() if x.source == s)
        assert abs(len(kept) - p[s] * n) <= 1 and abs(sum(kept) - p[s] * r.t) <= 3 * 60
    assert len({x.doc_id for x in rows}) == len(rows)


def test_partitions_don_t_matter(spark):
    d = corpus(spark, 600)
    assert same_rows(m.mix(d, {"a": 1, "b": 1}), m.mix(d.repartition(7), {"a": 1, "b": 1}))


def test_weird_rows(spark):
    d = weird(spark)
    out = m.mix(d, {"a": 1, "b": 1, None: 1})
    assert out.columns == d.columns
    assert {r.source for r in out.collect()} <= {"a", "b", None}
    chosen = m.chosen_units(d).collect()
    # rows that repeat are one unit, with the tokens of all of them
    assert all(r.n_rows == 3 and r.n_tokens == 180 for r in chosen if r.doc_id == 6)
    assert m.mix(empty(spark)).count() == 0 and m.chosen_units(empty(spark)).count() == 0
    assert m.mix(d, {"nowhere": 1}).count() == 0
