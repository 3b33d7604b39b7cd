import numpy as np
import pytest

from tarnsieve.llm import common
from tarnsieve.llm import sharding as s
from tests.llm.cases import SCHEMA, empty, odd_columns, prose, same_rows, weird


def corpus(spark, n=800):
    r = np.random.default_rng(1)
    return spark.createDataFrame([(int(i), "x" * int(min(40_000, r.pareto(1.1) * 200)), "en", "hot" if i % 3 else f"s{i % 7}", 0) for i in range(n)], SCHEMA)


@pytest.mark.parametrize("target, fan", [(2_000, None), (20_000, None), (1 << 30, None), (2_000, 5), (3_000, 2)])
def test_shards(spark, target, fan):
    d = corpus(spark)
    out = s.shard(d, target, fan=fan)
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == list(range(800)) and out.columns == [*d.columns, "shard_id"]
    size, keys = {}, {}
    for r in rows:
        size[r.shard_id] = size.get(r.shard_id, 0) + len(r.text) + s.RECORD_BYTES
        keys.setdefault(r.shard_id, []).append((r.source, r.doc_id))
    assert all(b <= s.SLACK * target or len(keys[i]) == 1 for i, b in size.items())
    assert sorted(size) == list(range(len(size)))
    ranges = [(min(keys[i]), max(keys[i])) for i in sorted(keys)]
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    total = sum(size.values())
    assert len(size) <= 2 * total / target + sum(b > target for b in size.values()) + 2
    assert all(keys[i] == sorted(keys[i]) for i in keys)


def test_shards_are_partitions_and_stable(spark):
    d = corpus(spark, 300)
    out = s.shard(d, 5_000)
    places = out.select("shard_id", s.F.spark_partition_id().alias("p")).distinct().collect()
    assert len(places) == len({x.shard_id for x in places}) == len({x.p for x in places})
    assert same_rows(out, s.shard(d.repartition(9), 5_000))


def test_quantiles():
    keys = [bytes([i]) for i in range(100)]
    assert s.quantiles(keys, np.ones(100), 4) == [keys[25], keys[50], keys[75]]
    heavy = np.ones(100)
    heavy[10] = 1000
    assert keys[11] in s.quantiles(keys, heavy, 50) or keys[10] in s.quantiles(keys, heavy, 50)
    assert s.quantiles([], np.ones(0), 9) == [] == s.quantiles(keys, np.ones(100), 1)


def test_weird_rows(spark):
    d = weird(spark)
    out = s.shard(d, 600)
    assert out.columns == [*d.columns, "shard_id_"]
    assert same_rows(out.select(*d.columns), d)
    by = {}
    for r in out.collect():
        by.setdefault((r.source, r.doc_id, r.text), set()).add(r.shard_id_)
    assert all(len(v) == 1 for v in by.values())
    first = min(out.collect(), key=lambda r: r.shard_id_)
    assert first.source is None
    assert s.shard(empty(spark)).count() == 0


def test_ties(spark):
    d = spark.createDataFrame([(1, prose(1), "en", "a", 0)] * 50 + [(2, prose(2), "en", "a", 0)] * 50, SCHEMA)
    assert {r.shard_id for r in s.shard(d, 100).collect()} == {0, 1}


def test_levels(spark):
    """However many ranges the driver draws, the shards keep order and bound, and each lies in one partition."""
    d = corpus(spark, 200)
    for fan in (1, 3):
        out = s.shard(d, 4_000, fan=fan)
        places = out.select("shard_id", s.F.spark_partition_id().alias("p")).distinct().collect()
        assert len(places) == len({x.shard_id for x in places})
        assert same_rows(out, s.shard(d.repartition(7), 4_000, fan=fan))
        assert s.shard(empty(spark), fan=fan).count() == 0
    d = weird(spark)
    out = s.shard(d, 600, fan=2)
    assert same_rows(out.select(*d.columns), d)


def test_any_columns(spark):
    d = odd_columns(spark, [(i, prose(i)) for i in range(9)] + [(None, None)])
    for fan in (1, None):
        out = s.shard(d, 300, fan=fan)
        assert out.columns == [*d.columns, "shard_id"] and out.count() == 10


def test_ids_that_are_no_numbers(spark):
    d = spark.createDataFrame([("x", prose(1), "a"), ("7", prose(2), "a"), (None, prose(1), "a")], "doc_id string, text string, source string")
    assert [r.doc_id for r in sorted(s.shard(d, 10).collect(), key=lambda r: r.shard_id)][-1] == "7"


def brute(keys, target):
    """Shard of each (key, size, draw) by plain lists: the loop of samples, quantiles and measures."""
    cuts, density = [], s.SAMPLES
    over = {0: sum(size for _, size, _ in keys)} if keys else {}
    over = {r: b for r, b in over.items() if b > s.SLACK * target}
    where = lambda key: sum(c <= key for c in cuts)
    while over:
        new = []
        for r, b in over.items():
            mine = [(key, size, min(1.0, size * float(density) / target)) for key, size, u in keys if where(key) == r and u < min(1.0, size * float(density) / target)]
            new += s.quantiles([k for k, _, _ in mine], np.array([size / p for _, size, p in mine]), max(2, round(b / target)))
        cuts = sorted({*cuts, *new})
        ranges = {}
        for key, size, _ in keys:
            ranges.setdefault(where(key), []).append(size)
        over = {r: sum(v) for r, v in ranges.items() if sum(v) > s.SLACK * target and len(v) > 1}
        density *= 2
    first = min((where(k) for k, _, _ in keys), default=0)
    return {key: where(key) - first for key, _, _ in keys}


@pytest.mark.parametrize("target", [700, 9_000])
def test_query_against_brute_force(spark, target):
    d = corpus(spark, 250).union(spark.createDataFrame([(None, "x" * 900, None, None, None), (3, None, "a", None, None), (3, None, "a", None, None)], SCHEMA))
    p = common.Plain(d)
    rows = p.df.select(s._key(p).alias("key"), s._size(p).alias("size"), p.long("doc_id").alias("doc_id"), p.col("source").alias("source"))
    keys = rows.groupBy("key", "doc_id", "source").agg(s.F.sum("size").alias("size")).withColumn("u", s.F.xxhash64("key", s.F.lit(s.SEED)).cast("double") / 2.0**64 + 0.5).collect()
    want = brute([(bytes(r.key), r.size, r.u) for r in keys], target)
    mine = {(r.source, r.doc_id): want[bytes(r.key)] for r in keys}
    got = s.shard(d, target).collect()
    assert len(got) == 253 and {(r.source, r.doc_id): r.shard_id for r in got} == mine and max(mine.values()) > 5
