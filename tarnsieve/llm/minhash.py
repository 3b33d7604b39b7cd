"""Operator 7: near duplicates by b-bit MinHash.

A text's features are the hashes of its runs of SHINGLE words (lower case; letters, digits and whatever lies outside
ASCII make words). PERMUTATIONS multiplicative permutations give as many minima, of which two things are kept:

* band keys: each BAND minima in a row, hashed, for candidate generation;
* BITS low bits of each minimum, packed into 64-bit lanes. Two packed signatures are compared by an exclusive or and a
  bit count; with m of k fields equal, similarity is estimated as (m/k - c) / (1 - c), c = 2^-BITS being the chance
  that the fields of different minima agree (Li and König, 2010; sets are large against the hash range).

Texts with the same signature and bands are one node from the start, so a thousand copies cost no more than one. In each
band's bucket all members are first tested against the bucket's least one, as a join of columns; what is similar gives
edges, and their components. In a bucket whose members all lie in one component nothing is left to test. In the others
the pairs of different components are tested by blocks of at most about BLOCK members a side, a task a pair of blocks; so
the components are exactly those that all pairs of all buckets would give, no bucket is gathered anywhere, and no pair
but a link between components leaves a task. Edges meet in a large-star/small-star contraction, cut by checkpoints; a
node's least neighbour comes from a grouped minimum (combined before the shuffle) joined back, not from a window.

near_duplicates() has a row for each row of a class of several: doc_id, class_id (the doc_id that stays) and links, the
number of the class's other rows. Documents without a near duplicate have no links and no row.

Nulls and cases: a null or empty text, or one without a word, has no features and never takes part in a class. A text
of fewer than SHINGLE words has one feature, its whole word run. Texts of any length are read whole. Rows equal in doc_id
and text are one unit, and a class of itself if repeated; of a unit's rows one is kept (the least by its other columns;
those without an order, like maps, by their JSON text). Of a class the row with the least doc_id stays, a null doc_id
coming last, and the least key of the text breaking ties; a doc_id that is no whole number is null. An empty table gives no
rows. Other columns pass through deduplicate(), whatever their names and types.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsieve.llm import common, textkit

SHINGLE, PERMUTATIONS, BAND, BITS = 2, 128, 4, 4
#: Estimated similarity from which two texts are near duplicates.
THRESHOLD = 0.6
#: Members of a bucket, about, that a task tests against as many others.
BLOCK = 2048

_rng = np.random.default_rng(7)
_MULTIPLIERS = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANES = PERMUTATIONS * BITS // 64
_FIELDS = 64 // BITS


def minima(features: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(permutations, rows with features): the least permuted feature of each."""
    rows, lead = textkit.row_slices(at)
    out = np.empty((PERMUTATIONS, len(rows)), np.uint64)
    if len(rows):
        tmp = np.empty_like(features)
        for p, a in enumerate(_MULTIPLIERS):
            np.multiply(features, a, out=tmp)
            np.minimum.reduceat(tmp, lead, out=out[p])
    return out


def packed(m: np.ndarray) -> np.ndarray:
    """(rows, lanes) of uint64: BITS bits of the upper half of each minimum."""
    low = (m >> np.uint64(32)) & np.uint64((1 << BITS) - 1)
    lanes = np.zeros((m.shape[1], _LANES), np.uint64)
    for p in range(PERMUTATIONS):
        lanes[:, p // _FIELDS] |= low[p] << np.uint64(BITS * (p % _FIELDS))
    return lanes


def band_keys(m: np.ndarray) -> np.ndarray:
    """(rows, bands) of int64."""
    mults = [np.uint64(pow(0x9FB21C651E98DF25, j + 1, 1 << 64)) for j in range(BAND)]
    keys = np.empty((m.shape[1], PERMUTATIONS // BAND), np.uint64)
    for b in range(PERMUTATIONS // BAND):
        h = np.full(m.shape[1], np.uint64(b * 0x632BE59BD9B4E019 & (1 << 64) - 1))
        for j in range(BAND):
            h ^= textkit.mix(m[b * BAND + j] * mults[j])
            h *= np.uint64(0xD6E8FEB86659FD93)
        keys[:, b] = textkit.mix(h)
    return keys.view(np.int64)


def equal_fields(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the fields agree between the signatures in the last axes of a and b."""
    return PERMUTATIONS - _differing(a ^ b).sum(-1, dtype=np.int64)


def _differing(x: np.ndarray) -> np.ndarray:
    """Fields that aren't 0 in each of the lanes x, which it overwrites."""
    step = 1
    while step < BITS:
        x |= x >> np.uint64(step)
        step *= 2
    x &= np.uint64(sum(1 << BITS * j for j in range(_FIELDS)))
    return np.bitwise_count(x)


def similarity(equal: np.ndarray) -> np.ndarray:
    c = 2.0**-BITS
    return (equal / PERMUTATIONS - c) / (1 - c)


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of texts that have words, their lanes, their band keys."""
    raw, off = textkit.buffer(textkit.lower(texts))
    words = textkit.Words(raw, off)
    features, at = textkit.grams(words.hashes(), words.first, SHINGLE)
    m = minima(features, at)
    return textkit.row_slices(at)[0], packed(m), band_keys(m)


_SIGNED = "doc_id long, k long, sh long, sig array<long>, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in textkit.blocks(batches):
        have, lanes, keys = signatures(texts)
        if not len(have):
            continue
        sh = np.zeros(len(have), np.uint64)
        for col in (*lanes.T, *keys.view(np.uint64).T):
            sh = textkit.mix((sh ^ col) * np.uint64(0x9FB21C651E98DF25) + np.uint64(1))
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(have) + 1, dtype=np.int32) * np.int32(x.shape[1])), pa.array(np.ascontiguousarray(x).view(np.int64).ravel())) for x in (lanes, keys)]
        take = pa.array(have)
        yield pa.RecordBatch.from_arrays([rows.column(0).take(take), rows.column(1).take(take), pa.array(sh.view(np.int64)), *lists], names=["doc_id", "k", "sh", "sig", "bands"])


def _needed(threshold: float) -> int:
    """Fields that have to agree for an estimate of threshold."""
    return int(np.ceil((threshold * (1 - 2.0**-BITS) + 2.0**-BITS) * PERMUTATIONS - 1e-9))


def similar(a: Column, b: Column, threshold: float) -> Column:
    """Whether packed signatures estimate at least threshold, in built-in functions."""
    differ = F.lit(0)
    ones = sum(1 << BITS * j for j in range(_FIELDS))
    for i in range(_LANES):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        any_ = x
        for j in range(1, BITS):
            any_ = any_.bitwiseOR(F.shiftrightunsigned(x, j))
        differ = differ + F.bit_count(any_.bitwiseAND(F.lit(ones).cast("long")))
    return differ <= PERMUTATIONS - _needed(threshold)


def bucket_edges(ids: np.ndarray, sigs: np.ndarray, threshold: float, roots: np.ndarray | None = None, right: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (member, member) that join the components which pairs similar by threshold join, one for each joining.

    roots: components known before, by default each member is its own. right: members of the second block; then only pairs of the two
    blocks count.
    """
    need = _needed(threshold)
    _, root = np.unique(ids if roots is None else roots, return_inverse=True)
    # the largest component's members meet all others when those are tested
    rest = root != np.bincount(root).argmax()
    sides = [np.arange(len(ids))] if right is None else [np.flatnonzero(~right), np.flatnonzero(right)]
    # half of the fields rule nearly all pairs out: what they miss at most is known
    half = _LANES // 2
    most = PERMUTATIONS - need  # fields that may differ
    fronts = [np.ascontiguousarray(sigs[side, :half].T) for side in sides]
    open_ = np.ones(len(ids), bool)
    out: list[tuple[int, int]] = []
    for mine, theirs, front in zip(sides, sides[::-1], fronts[::-1]):
        for x in mine[rest[mine]]:
            open_[x] = False
            can = open_[theirs]
            if not can.any():
                break
            i = theirs[can & (root[theirs] != root[x]) & (_differing(front ^ sigs[x, :half, None]).sum(0, dtype=np.int16) <= most)]
            i = i[equal_fields(sigs[i], sigs[x]) >= need]
            if len(i):
                joined, lead = np.unique(root[i], return_index=True)
                out += [(int(ids[x]), int(ids[i[y]])) for y in lead]
                root[np.isin(root, joined)] = root[x]
    return out


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            ids, roots, right, sig = (column.flatten().field(j) for j in range(4))
            ids, roots, right = (x.to_numpy(zero_copy_only=False) for x in (ids, roots, right))
            lanes = sig.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, _LANES)
            off = column.offsets.to_numpy() - column.offsets[0].as_py()
            edges = []
            for a, b in zip(off[:-1], off[1:]):
                sides = right[a:b]
                edges += bucket_edges(ids[a:b], lanes[a:b], threshold, roots[a:b], sides == 2 if sides.any() else None)
            yield pa.RecordBatch.from_arrays([pa.array(np.array([e[z] for e in edges], np.int64)) for z in (0, 1)], names=["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each component of edges (a, b). Nodes without an edge are not in it.

    Large-star and small-star steps in turn (Kiveris et al., 2014) until neither changes the edges.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = common.cut(edges)
    size = None

    def with_least(x: DataFrame) -> DataFrame:
        return x.join(x.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("least")), F.col("a") == F.col("of")).select("a", "b", "least")

    while True:
        both = with_least(edges.union(edges.select("b", "a")))
        large = both.where("b > a").select(F.col("b").alias("a"), F.least("least", "a").alias("b"))
        large = large.where("a <> b").distinct()
        down = with_least(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        small = down.select("b", "least").union(down.select("a", "least")).toDF("a", "b").where("a <> b").distinct()
        edges = common.cut(small)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == size:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        size = now


def links(nodes: DataFrame, threshold: float = THRESHOLD, block: int | None = None) -> DataFrame:
    """nodes (sh, sig, bands), cut() -> node, root: components of all pairs that share a band and are similar."""
    block = block or BLOCK
    pairs = nodes.select("sh", F.explode("bands").alias("band"))
    buckets = pairs.groupBy(F.col("band").alias("bucket")).agg(F.min("sh").alias("leader"), F.count("*").alias("n")).where("n > 1")
    members = common.cut(pairs.join(buckets, F.col("band") == F.col("bucket")).select("bucket", "leader", "n", "sh"))
    sigs = nodes.select(F.col("sh").alias("node"), "sig")
    star = members.where("sh <> leader").select("sh", "leader").distinct().join(sigs, F.col("sh") == F.col("node")).select("sh", "leader", F.col("sig").alias("own"))
    star = star.join(sigs, F.col("leader") == F.col("node")).where(similar(F.col("own"), F.col("sig"), threshold))
    edges = common.cut(star.select(F.col("sh").alias("a"), F.col("leader").alias("b")))
    root = components(edges)
    # buckets of two are done; the others are where they hold several components
    rooted = members.where("n > 2").join(root, F.col("sh") == F.col("node"), "left").select("bucket", "n", "sh", F.coalesce("root", "sh").alias("root"))
    several = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.first("n").alias("n"), F.bit_xor(F.xxhash64("sh")).alias("x"), F.bit_xor(F.xxhash64("sh", F.lit(1))).alias("y")).where("lo < hi")
    # near copies share many bands: the same set of members is tested once
    several = common.cut(several.groupBy("n", "x", "y").agg(F.min("bucket").alias("open")).select("open"))
    if several.isEmpty():
        return root
    rest = rooted.join(several, F.col("bucket") == F.col("open")).withColumn("parts", F.ceil(F.col("n") / block))
    rest = rest.withColumn("part", F.pmod(F.xxhash64("sh", F.lit(2)), "parts"))
    rest = rest.select("bucket", "sh", "root", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("with"))
    rest = rest.select("bucket", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "sh", "root", F.when(F.col("part") == F.col("with"), 0).when(F.col("part") < F.col("with"), 1).otherwise(2).alias("right"))
    rest = rest.join(sigs, F.col("sh") == F.col("node"))
    blocks = rest.groupBy("bucket", "i", "j").agg(F.collect_list(F.struct("sh", "root", "right", "sig")).alias("m")).where("size(m) > 1")
    more = common.cut(blocks.select("m").mapInArrow(_verify(threshold), "a long, b long"))
    return root if more.isEmpty() else components(root.toDF("a", "b").union(more))


def groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, k, n, gi, gk, gn: the units in classes of more than one row; n rows of the unit, gi and gk the unit that stays, gn the class's rows."""
    signed = common.cut(common.units_of(docs).select("doc_id", "k", "text").mapInArrow(_sign, _SIGNED))
    nodes = common.cut(signed.groupBy("sh").agg(F.first("sig").alias("sig"), F.first("bands").alias("bands")))
    root = links(nodes, threshold)
    units = signed.groupBy("sh", "doc_id", "k").agg(F.count("*").alias("n"))
    mine = units.join(root, F.col("sh") == F.col("node"), "left").select("doc_id", "k", "n", F.coalesce("root", "sh").alias("root"))
    stays = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.col("k").alias("k")))
    whole = mine.groupBy(F.col("root").alias("of")).agg(stays.alias("stays"), F.sum("n").alias("gn")).where("gn > 1")
    return mine.join(whole, F.col("root") == F.col("of")).select("doc_id", "k", "n", F.col("stays.i").alias("gi"), F.col("stays.k").alias("gk"), "gn")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, links: a row for each row of a class of several."""
    g = groups(docs, threshold)
    rows = g.select("doc_id", F.col("gi").alias("class_id"), (F.col("gn") - 1).alias("links"), F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    return rows.drop("copy")


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class of near duplicates; columns as they are."""
    g = common.cut(groups(docs, threshold))
    gone = g.where(~(F.col("doc_id").eqNullSafe(F.col("gi")) & (F.col("k") == F.col("gk"))))
    twice = common.cut(g.where("n > 1").where(F.col("doc_id").eqNullSafe(F.col("gi")) & (F.col("k") == F.col("gk"))))
    if twice.isEmpty():
        return common.without_units(docs, gone)
    once = common.without_units(docs, gone.unionByName(twice))
    p = common.Plain(common.only_units(docs, twice))
    order = F.struct(*(common.sortable(F.col(c), t).alias(c) for c, t in zip(p.names, p.types)))
    some = p.df.groupBy(p.long("doc_id").alias("i"), common.text_key(p.col("text")).alias("k")).agg(F.min_by(F.struct(*p.names), order).alias("row"))
    return once.union(p.back(some.select("row.*")))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.load(spark, sf_dir, "documents"))
