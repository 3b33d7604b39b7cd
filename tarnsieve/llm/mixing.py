"""Operator 4: mixing sources to target weights by the cube method.

A document of source s gets the inclusion probability p_s = min(1, w_s T / tokens_s), where w_s is the source's target
share of the tokens, tokens_s the source's own and T the most tokens that the weights allow without repeating any
document: the least of tokens_s / w_s over the sources that hold at least SMALL of all tokens. Smaller ones set no bound
and are taken whole where the weights ask for more than they have, so a stray source doesn't shrink the others. Without
given weights w_s is proportional to tokens_s ** ALPHA, which holds a dominant source back; the default keeps most of
the input (92 % of the documents that reach the pipeline's stage in the check's tables). In each source the cube method (Deville and
Tillé, 2004) then moves the probabilities along the null space of two constraints, the number of documents and the number
of tokens: of three undecided documents a step leaves both totals as they are and decides at least one. The flight runs
in chunks of about CHUNK documents, whose at most two undecided ones go on to the next level, until every source is one
chunk; the landing drops the token constraint and then decides the last document by its probability. So the documents
kept of a source are the expected number but for one, and the tokens but for what the two last documents make.

Sources may be as many as hosts: their totals and probabilities are a table, joined to the documents by a broadcast up
to a counted size and by a shuffle beyond; only T and the size of the largest source come to the driver. Given weights
are an argument and so of the caller's size. A task works chunk after chunk through its part, sorted by chunk.

Tokens are runs of characters other than ASCII white space. Random choices come from the key of the unit and the seed, and the
order of flight from the key, so the result depends neither on partitions nor on attempts.

Nulls and cases: a null source is a source of its own (give its weight as None); a source without a given weight, or
with a weight of 0, is left out whole. Null and empty texts have no tokens: they pass at their source's probability,
which is 1 for a source without any token; a text of any length is one document. Rows that are equal in doc_id, source
and text are one unit, kept or left out together, with the tokens of all its rows; a doc_id that is no whole number is
null. Ties don't occur: units of one order have one key. An empty table gives an empty one. Other columns pass through,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsieve.llm import common

ALPHA, CHUNK, SEED = 0.9, 2048, 17
#: Share of all tokens from which on a source bounds T.
SMALL = 0.001
_EPS = 1e-9


def flight(p: np.ndarray, tokens: np.ndarray, order: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """p after the flight through the documents in order: all but at most two are 0 or 1, sum(p) and sum(p * tokens) as before."""
    p = p.tolist()
    t = tokens.tolist()
    hold: list[int] = []
    for i, draw in zip(order.tolist(), draws.tolist()):
        if _EPS < p[i] < 1 - _EPS:
            hold.append(i)
        if len(hold) < 3:
            continue
        a, b, c = hold
        u = (t[c] - t[b], t[a] - t[c], t[b] - t[a])
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        up = down = np.inf
        for x, d in zip(hold, u):
            if d > 0:
                up, down = min(up, (1 - p[x]) / d), min(down, p[x] / d)
            elif d < 0:
                up, down = min(up, -p[x] / d), min(down, (p[x] - 1) / d)
        step = up if draw * (up + down) < down else -down
        for x, d in zip(hold, u):
            p[x] += step * d
        hold = [x for x in hold if _EPS < p[x] < 1 - _EPS]
    out = np.array(p)
    out[out <= _EPS] = 0
    out[out >= 1 - _EPS] = 1
    return out


def landing(p: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Decides the at most two that a flight left: first keeping their sum, then by probability."""
    p = p.copy()
    open_ = [int(i) for i in np.flatnonzero((p > 0) & (p < 1))]
    while len(open_) > 1:
        a, b = open_[:2]
        up, down = min(1 - p[a], p[b]), min(p[a], 1 - p[b])
        step = up if draws[a] * (up + down) < down else -down
        p[a] += step
        p[b] -= step
        for x in (a, b):
            p[x] = 0 if p[x] <= _EPS else 1 if p[x] >= 1 - _EPS else p[x]
        open_ = [x for x in open_ if 0 < p[x] < 1]
    for x in open_:
        p[x] = float(draws[x] < p[x])
    return p


def _draws(keys: np.ndarray, seed: int) -> np.ndarray:
    from tarnsieve.llm.textkit import mix

    return mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) / 2.0**64


_AT = "u long, s string, tokens long, p double"


def _level(seed: int, last: bool):
    """u, s, tokens, p, c, sorted by (s, c) -> u, s, tokens, p after the flight of each chunk (and the landing)."""

    def settled(u: np.ndarray, tokens: np.ndarray, p: np.ndarray) -> np.ndarray:
        if not last and len(u) < 3:
            return p
        order = np.argsort(u)  # the landing takes what is left in this order
        u, tokens, p = u[order], tokens[order], p[order]
        q = flight(p, tokens.astype(float), np.lexsort((u, _draws(u, seed + 1))), _draws(u, seed))
        out = np.empty_like(q)
        out[order] = landing(q, _draws(u, seed + 2)) if last else q
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table) -> pa.RecordBatch:
            s, c = t.column(1).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(), t.column(4).to_numpy()
            lead = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (c[1:] != c[:-1])]))
            u, tokens, p = (t.column(j).to_numpy() for j in (0, 2, 3))
            p = np.concatenate([settled(u[a:b], tokens[a:b], p[a:b]) for a, b in zip(lead, [*lead[1:], len(u)])])
            return pa.RecordBatch.from_arrays([*(t.column(j).combine_chunks() for j in range(3)), pa.array(p)], names=["u", "s", "tokens", "p"])

        for batch in batches:
            if not batch.num_rows:
                continue
            # the last chunk of a batch may go on in the next one
            tail = 0
            key = batch.column(1)[batch.num_rows - 1].as_py(), batch.column(4)[batch.num_rows - 1].as_py()
            tail = batch.num_rows - 1
            while tail and (batch.column(1)[tail - 1].as_py(), batch.column(4)[tail - 1].as_py()) == key:
                tail -= 1
            if tail:
                held.append(batch.slice(0, tail))
                yield done(pa.Table.from_batches(held))
                held = []
            elif held and (held[-1].column(1)[0].as_py(), held[-1].column(4)[0].as_py()) != key:
                yield done(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(tail))
        if held:
            yield done(pa.Table.from_batches(held))

    return run


def weighed(stats: DataFrame, weights: dict | None, alpha: float) -> DataFrame:
    """stats (s, t tokens, n documents; a row a source) with the inclusion probability p."""
    if weights is None:
        w = stats.withColumn("w", F.pow(F.col("t").cast("double"), F.lit(float(alpha))))
    else:
        rows = [(k, float(v or 0)) for k, v in weights.items()]
        given = stats.sparkSession.createDataFrame(rows, "ws string, w double")
        w = stats.join(F.broadcast(given), F.col("s").eqNullSafe(F.col("ws")), "left").drop("ws").withColumn("w", F.coalesce("w", F.lit(0.0)))
    w = common.cut(w)
    total = w.agg(F.sum("t")).first()[0] or 0
    told = F.when((F.col("w") > 0) & (F.col("t") > 0), F.col("t") / F.col("w"))
    bound = w.agg(F.min(F.when(F.col("t") >= SMALL * float(total), told)), F.min(told)).first()
    limit = bound[0] if bound[0] is not None else bound[1] or 0.0  # weights may name small sources alone
    p = F.when(F.col("t") > 0, F.least(F.lit(1.0), F.col("w") * F.lit(float(limit)) / F.col("t"))).otherwise(F.lit(1.0) if weights is None else (F.col("w") > 0).cast("double"))
    return w.select("s", "t", "n", p.alias("p"))


def _units(docs: DataFrame) -> DataFrame:
    """u, doc_id, s, n_rows, tokens: units, their rows and the tokens of all of them."""
    p = common.Plain(docs)
    words = F.coalesce(F.regexp_count(p.col("text"), F.lit(r"\S+")), F.lit(0)).cast("long")
    return p.df.select(_unit_key(p).alias("u"), p.long("doc_id").alias("doc_id"), p.col("source").cast("string").alias("s"), words.alias("tokens")).groupBy("u", "doc_id", "s").agg(F.count("*").alias("n_rows"), F.sum("tokens").alias("tokens"))


def _unit_key(p: common.Plain):
    # nulls are told from each other by their places; xxhash64 itself skips them
    return F.xxhash64(p.long("doc_id"), p.long("doc_id").isNull(), p.col("source").cast("string"), p.col("source").isNull(), p.col("text"))


def chosen_units(docs: DataFrame, weights: dict | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """u, doc_id, source, n_rows, n_tokens of the units that are kept."""
    units = common.cut(_units(docs))
    known = common.cut(weighed(units.groupBy("s").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")), weights, alpha))
    most = known.where((F.col("p") > _EPS) & (F.col("p") < 1 - _EPS)).agg(F.max("n")).first()[0] or 0
    known = known.select(F.col("s").alias("ps"), "p", F.greatest(F.lit(1), F.ceil(F.col("n") / CHUNK)).alias("chunks"))
    left = units.join(common.by_size(known, 128), F.col("s").eqNullSafe(F.col("ps"))).select("u", "s", "tokens", "p", "chunks")
    done, at = left.where(f"p >= {1 - _EPS}").select("u"), left.where(f"p > {_EPS} and p < {1 - _EPS}")
    level = 0
    while most:
        last = most <= CHUNK
        at = at.withColumn("c", F.pmod(F.xxhash64("u", F.lit(level)), F.col("chunks")) if not last else F.lit(0).cast("long"))
        chunks = at.select("u", "s", "tokens", "p", "c").repartition("s", "c").sortWithinPartitions("s", "c")
        moved = common.cut(chunks.mapInArrow(_level(seed + 10 * level, last), _AT))
        done = done.union(moved.where("p = 1").select("u"))
        if last:
            break
        most = 2 * max(1, -(-most // CHUNK))
        at = moved.where("p > 0 and p < 1").withColumn("chunks", F.lit(max(1, -(-most // CHUNK))).cast("long"))
        level += 1
    kept = units.join(done.toDF("du"), F.col("u") == F.col("du"), "left_semi")
    return kept.select("u", "doc_id", F.col("s").alias("source"), "n_rows", F.col("tokens").alias("n_tokens"))


def mix(docs: DataFrame, weights: dict | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """The rows of docs that the sample keeps; columns as they are."""
    chosen = chosen_units(docs, weights, alpha, seed).select(F.col("u").alias("chosen_u"))
    p = common.Plain(docs)
    return p.back(p.df.join(chosen, _unit_key(p) == F.col("chosen_u"), "left_semi"))


def op4_mixing_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_units(common.load(spark, sf_dir, "documents")).drop("u")
