"""Operator 8: shards by sampled splitters.

Records are put in order of (source, doc_id, hash of the text) and cut into ranges of about TARGET_BYTES of text. A
sample, in which a record's chance is in proportion to its size, is drawn (SAMPLES a range on average, whatever the
number of records); its weighted quantiles are the splitters. Ranges are then measured exactly. Those over SLACK times
their goal are subdivided by splitters from a sample of their own records, twice as dense each time, until none is left
that has more than one key; a single record beyond the target makes a shard alone.

This is done on two levels, so that neither driver nor broadcast grows with the data. The driver draws at most about FAN
coarse ranges, whose goal is the target or, in tables of more than FAN targets, their FANth part. There the executors
subdivide each coarse range on their own: splitters are a table (range, key), quantiles are taken a range a task, and
records and splitters meet by a shuffle on the range and one ordered pass. One shuffle of the documents puts each coarse
range into its partition, sorted; shards are runs within it, and where coarse ranges are the shards, partitions are too.

Sizes are bytes of UTF-8 plus RECORD_BYTES. Sampling goes by hashes, so the shards are the same whatever the partitions.

Nulls and cases: a null source or doc_id (or one that is no whole number) comes before all others; null and empty texts
have RECORD_BYTES; a text of any length is one record. Ties: rows equal in all of the key, repeated rows above all, lie
in one shard. An empty table has no shards and gives no rows. The result has all columns of docs, whatever their names,
and shard_id (underscores are added where that name is taken).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnsieve.llm import common

TARGET_BYTES, SLACK, SAMPLES, RECORD_BYTES, SEED = 16 << 20, 1.25, 40, 16, 29
#: Ranges that the driver draws, about; beyond, executors subdivide these.
FAN = 8192


def _key(p: common.Plain):
    """A binary key that sorts as (source, doc_id, hash of the text), nulls first."""
    # to_binary of a number keeps its order once the sign bit is turned
    ordered = lambda c: F.unhex(F.lpad(F.hex(c.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    source, doc = p.col("source").cast("string"), p.long("doc_id")
    parts = [
        F.when(source.isNull(), F.lit(b"\0")).otherwise(F.concat(F.lit(b"\1"), F.encode(F.regexp_replace(source, "\u0000", "\u0001"), "UTF-8"), F.lit(b"\0"))),
        F.when(doc.isNull(), F.lit(b"\0")).otherwise(F.concat(F.lit(b"\1"), ordered(doc))),
        ordered(common.text_key(p.col("text"))),
    ]
    return F.concat(*parts)


def _size(p: common.Plain):
    return F.coalesce(F.octet_length(p.col("text")), F.lit(0)).cast("long") + RECORD_BYTES


def _ranges(spark: SparkSession, splitters: list[bytes]):
    shared = spark.sparkContext.broadcast(splitters)

    @F.arrow_udf("int")
    def range_of(keys: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cuts = shared.value
        for column in keys:
            yield pa.array([bisect_right(cuts, k) for k in column.to_pylist()], pa.int32())

    return range_of


def quantiles(keys: list[bytes], weights: np.ndarray, parts: int) -> list[bytes]:
    """Keys at which the weight of a sample, sorted by key, is cut into equal parts; a splitter is the first key of its range."""
    if parts < 2 or not keys:
        return []
    order = sorted(range(len(keys)), key=keys.__getitem__)
    before = np.cumsum(weights[order]) - weights[order] / 2
    at = np.searchsorted(before, before[-1] * np.arange(1, parts) / parts)
    return sorted({keys[order[min(i, len(order) - 1)]] for i in at})


def _sampled(rows: DataFrame, density: float, goal: int, seed: int) -> DataFrame:
    """Rows drawn with a chance in proportion to their size, and that chance p."""
    u = (F.xxhash64("key", F.lit(seed)).cast("double") / 2.0**64) + 0.5
    chance = F.least(F.lit(1.0), F.col("size") * float(density) / goal)
    return rows.where(u < chance).withColumn("p", chance)


def splitters(rows: DataFrame, goal: int, seed: int = SEED) -> tuple[list[bytes], int]:
    """Splitters of rows (key, size; keys distinct) into ranges of about goal bytes, drawn by the driver; and the number of ranges."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    cuts: list[bytes] = []
    sizes = {0: (total, 2)} if total else {}
    density = SAMPLES
    while True:
        over = {r: b for r, (b, keys) in sizes.items() if b > SLACK * goal and keys > 1}
        if not over:
            break
        ranged = rows.withColumn("r", _ranges(rows.sparkSession, cuts)("key")) if cuts else rows.withColumn("r", F.lit(0))
        by: dict[int, list] = {}
        for x in _sampled(ranged.where(F.col("r").isin([*over])), density, goal, seed).collect():
            by.setdefault(x["r"], []).append(x)
        for r, own in by.items():
            cuts += quantiles([bytes(x["key"]) for x in own], np.array([x["size"] / x["p"] for x in own]), max(2, round(over[r] / goal)))
        cuts = sorted({*cuts})
        measured = rows.withColumn("r", _ranges(rows.sparkSession, cuts)("key")).groupBy("r").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
        sizes = {x["r"]: (x["b"], x["n"]) for x in measured}
        density *= 2
    # the first splitter may be the least key of all, with nothing before it
    if cuts and 0 not in sizes:
        cuts = cuts[1:]
    return cuts, len(cuts) + bool(total)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """r, key, size (null: a splitter), in order -> r, i, key, size of the records; i is the number of the range's splitters up to the key."""
    now, i = None, 0
    for batch in batches:
        out = []
        for r, size in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if r != now:
                now, i = r, 0
            i += size is None
            out.append(i)
        x = pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int32()), batch.column(1), batch.column(2)], names=["r", "i", "key", "size"])
        yield x.filter(pc.is_valid(x.column(3)))


def _own_quantiles(target: int):
    def run(sample: pd.DataFrame) -> pd.DataFrame:
        cuts = quantiles([*sample["key"]], (sample["size"] / sample["p"]).to_numpy(), max(2, round(float(sample["b"].iloc[0]) / target)))
        return pd.DataFrame({"r": np.full(len(cuts), sample["r"].iloc[0], np.int32), "key": cuts})

    return run


def subdivided(ranged: DataFrame, target: int, seed: int = SEED) -> DataFrame:
    """Splitters (r, key) within each range of ranged (r, key, size), so that parts have about target bytes; drawn by executors."""
    fine = ranged.sparkSession.createDataFrame([], "r int, key binary")
    placed = ranged.select("r", F.lit(0).alias("i"), "key", "size")
    density = SAMPLES
    while True:
        measured = placed.groupBy("r", "i").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
        over = common.cut(measured.where((F.col("b") > SLACK * target) & (F.col("n") > 1)).select(F.col("r").alias("of"), F.col("i").alias("oi"), "b"))
        if over.isEmpty():
            return fine
        mine = placed.join(common.by_size(over, 64), (F.col("r") == F.col("of")) & (F.col("i") == F.col("oi")))
        new = _sampled(mine, density, target, seed).select("r", "i", "b", "key", "size", "p").groupBy("r", "i").applyInPandas(_own_quantiles(target), "r int, key binary")
        fine = common.cut(fine.union(new).distinct())
        both = ranged.select("r", "key", "size").union(fine.select("r", "key", F.lit(None).cast("long")))
        # a splitter comes before the record that begins its range
        placed = both.repartition("r").sortWithinPartitions("r", "key", "size").mapInArrow(_placed, "r int, i int, key binary, size long")
        placed = common.cut(placed)
        density *= 2


def shard(docs: DataFrame, target: int = TARGET_BYTES, seed: int = SEED, fan: int | None = None) -> DataFrame:
    """docs with shard_id, shards in order of the key and each within one partition; a partition of its own where there are at most fan."""
    p, out = common.Plain(docs), common.free_name(docs, "shard_id")
    rows = common.cut(p.df.select(_key(p).alias("key"), _size(p).alias("size")).groupBy("key").agg(F.sum("size").alias("size")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    goal = max(target, -(-total // (fan or FAN)))
    cuts, n = splitters(rows, goal, seed)
    range_of = _ranges(docs.sparkSession, cuts)
    keyed = p.df.withColumns({"key": _key(p)}).withColumn("r", range_of("key"))
    if goal == target:
        placed = keyed.repartitionById(max(1, n), F.col("r")).sortWithinPartitions("r", "key")
        return p.back(placed.withColumn(out, F.col("r")), out)
    ranged = common.cut(rows.withColumn("r", range_of("key")))
    fine = subdivided(ranged, target, seed)
    # shards of a coarse range: its splitters, and what lies before the first
    first = ranged.groupBy("r").agg(F.min("key").alias("least")).join(fine.groupBy(F.col("r").alias("of")).agg(F.count("*").alias("n"), F.min("key").alias("cut")), F.col("r") == F.col("of"), "left")
    before, begin = 0, []
    for x in first.select("r", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("least") == F.col("cut"), F.lit(False)).alias("at")).orderBy("r").collect():  # a row a coarse range
        begin.append((x["r"], before - int(x["at"])))
        before += x["n"] + 1 - int(x["at"])
    begins = docs.sparkSession.createDataFrame(begin, "of int, begin int")
    both = keyed.withColumn("is_cut", F.lit(False)).unionByName(fine.withColumn("is_cut", F.lit(True)), allowMissingColumns=True)
    order = Window.partitionBy("r").orderBy("key", F.col("is_cut").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = both.repartition(n, "r").withColumn("i", F.sum(F.col("is_cut").cast("int")).over(order)).where(~F.col("is_cut"))
    placed = placed.join(F.broadcast(begins), F.col("r") == F.col("of"))  # a row a coarse range
    return p.back(placed.withColumn(out, (F.col("begin") + F.col("i")).cast("int")), out)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.load(spark, sf_dir, "documents"))
