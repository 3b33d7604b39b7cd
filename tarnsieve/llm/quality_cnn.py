"""Operator 1: quality classifier, a convolutional network over bytes.

Every byte has a learned vector of EMBED numbers; FILTERS filters of WIDTH bytes slide over the whole text, byte by
byte. Chunks of CHUNK bytes overlap by half and together cover the text to its last byte; in each chunk the filters'
outputs are max-pooled. What the chunks have is combined by their maximum and their mean, which one hidden layer turns
into one probability. Since the filters are linear in one-hot bytes, a filter bank is WIDTH tables of 256 rows, and the
convolution a sum of table look-ups in numpy; gradients flow through the places of the maxima alone.

The label to be learned is "good to train on": quality 1 and toxic 0. The network is fitted on the driver to at most
MAX_LABELLED labelled documents (by the least hashes of their ids), of which one part in HELD_OUT is kept apart: on it
the threshold is chosen from both classes, as that which makes the share of bad documents kept and WORTH times the share
of good ones lost least in sum, within BOUNDS, so that one odd document moves it little even where labels are few. All
documents are scored.

Nulls and cases: a null or empty text is one chunk of no bytes, gets whatever probability that has under the model
learned, and is never kept; a text of any length is covered to its end. Labels that are null, or contradict each other for
one doc_id, aren't learned from; labels that repeat count once, and of several texts of one doc_id the least is learned
from. A doc_id that is no whole number has no label and, in scores(), is null. Ties: a probability equal to the threshold
is kept; of thresholds that are equally good the least is taken. Repeated rows are scored and kept alike. An empty table
gives no rows. Without labels of both kinds there is nothing to learn: every probability is null and every document is
kept. Other columns pass through filter_documents() and are ignored by scores(), whatever their names.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsieve.llm import common, textkit

EMBED, FILTERS, WIDTH, HIDDEN = 16, 48, 7, 32
CHUNK = 512
_HALF = CHUNK // 2
#: Labelled documents that the network is fitted to at most; one part in HELD_OUT of them only sets the threshold.
MAX_LABELLED, HELD_OUT = 4000, 5
EPOCHS, BATCH, RATE, DECAY = 12, 16, 1.5e-2, 1e-4
#: How much more a good document lost costs than a bad one kept, and where the threshold lies.
WORTH, BOUNDS = 20, (0.05, 0.9)
#: Threads that the driver fits with.
THREADS = min(4, os.cpu_count() or 1)


def padded(texts: list[bytes] | tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each with zeros up to whole half chunks and at least WIDTH - 1 of them; half chunks before each text."""
    if isinstance(texts, list):
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        raw = np.frombuffer(b"".join(texts), np.uint8)
    else:
        raw, off = texts
    size = np.diff(off)
    halves = np.maximum(2, -(-(size + WIDTH - 1) // _HALF))
    at = np.concatenate([[0], np.cumsum(halves)])
    out = np.zeros(int(at[-1]) * _HALF + WIDTH, np.uint8)
    for r in range(len(size)):
        out[at[r] * _HALF : at[r] * _HALF + size[r]] = raw[off[r] : off[r + 1]]
    return out, at


@dataclass
class Network:
    embed: np.ndarray
    filters: np.ndarray  # WIDTH, EMBED, FILTERS
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    threshold: float = 0.5

    @staticmethod
    def start(seed: int) -> Network:
        r = np.random.default_rng(seed)
        n = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        return Network(n(256, EMBED, scale=0.5), n(WIDTH, EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5), n(2 * FILTERS, HIDDEN, scale=(2 * FILTERS) ** -0.5), np.zeros(HIDDEN, np.float32), n(HIDDEN, scale=HIDDEN**-0.5), np.zeros(1, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.w1, self.b1, self.w2, self.b2]

    def convolve(self, data: np.ndarray, at: np.ndarray, places: bool = False, pool: ThreadPoolExecutor | None = None):
        """The filters' maxima in each half chunk (halves, FILTERS), and where they are.

        Windows that would reach from one text's padding into the next text don't count.
        """
        halves, final = int(at[-1]), at[1:] - 1
        tables = np.ascontiguousarray(np.einsum("be,wef->wbf", self.embed, self.filters))
        best = np.empty((halves, FILTERS), np.float32)
        where = np.empty((halves, FILTERS), np.int64) if places else None
        step = 24 if pool else 64  # half chunks at once: what is summed stays in the cache

        def part(lo: int, total: np.ndarray, addend: np.ndarray) -> None:
            hi = min(halves, lo + step)
            n = (hi - lo) * _HALF
            t, q = total[:n], addend[:n]
            np.take(tables[0], data[lo * _HALF : lo * _HALF + n], axis=0, out=t, mode="clip")
            for j in range(1, WIDTH):
                np.take(tables[j], data[lo * _HALF + j : lo * _HALF + j + n], axis=0, out=q, mode="clip")
                t += q
            cube = t.reshape(hi - lo, _HALF, FILTERS)
            cube[final[np.searchsorted(final, lo) : np.searchsorted(final, hi)] - lo, _HALF - WIDTH + 1 :] = -np.inf
            if places:
                a = cube.argmax(1)
                best[lo:hi] = np.take_along_axis(cube, a[:, None], 1)[:, 0]
                where[lo:hi] = a + np.arange(lo, hi)[:, None] * _HALF
            else:
                cube.max(1, out=best[lo:hi])

        def several(begins: range) -> None:
            room = [np.empty((step * _HALF, FILTERS), np.float32) for _ in range(2)]
            for lo in begins:
                part(lo, *room)

        if pool:
            list(pool.map(several, [range(i * step, halves, THREADS * step) for i in range(THREADS)]))
        else:
            several(range(0, halves, step))
        return best, where

    def pooled(self, best: np.ndarray, at: np.ndarray):
        """Chunks (two half chunks each, overlapping) -> maximum and mean of each text."""
        second = best[1:] > best[:-1]
        chunk = np.where(second, best[1:], best[:-1])
        # the chunk that starts in a text's last half would reach into the next text
        rows = np.delete(np.arange(len(best) - 1), at[1:-1] - 1)
        lead = at[:-1] - np.arange(len(at) - 1)
        c = chunk[rows]
        n = np.diff(at) - 1
        return c, rows, second, lead, n, np.concatenate([np.maximum.reduceat(c, lead), np.add.reduceat(c, lead) / n[:, None].astype(np.float32)], 1)

    def head(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(doc @ self.w1 + self.b1, 0)
        return hidden, hidden @ self.w2 + self.b2

    def probabilities(self, texts) -> np.ndarray:
        data, at = padded(texts)
        if len(at) < 2:
            return np.zeros(0)
        best, _ = self.convolve(data, at)
        return 1 / (1 + np.exp(-self.head(self.pooled(best, at)[-1])[1].astype(np.float64)))

    def gradients(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray, pool: ThreadPoolExecutor | None = None) -> list[np.ndarray]:
        data, at = padded(texts)
        best, where = self.convolve(data, at, True, pool)
        c, rows, second, lead, n, doc = self.pooled(best, at)
        hidden, z = self.head(doc)
        dz = (1 / (1 + np.exp(-z)) - y) * weight / len(y)
        dh = np.outer(dz, self.w2) * (hidden > 0)
        dd = dh @ self.w1.T
        of = np.repeat(np.arange(len(n)), n)
        dc = np.repeat(dd[:, FILTERS:] / n[:, None], n, 0)
        top = c == np.repeat(doc[:, :FILTERS], n, 0)
        share = np.add.reduceat(top.astype(np.float32), lead)
        dc += top * (dd[:, :FILTERS] / share)[of]
        place = np.where(second, where[1:], where[:-1])[rows]
        g_embed, g_filters = np.zeros_like(self.embed), np.zeros_like(self.filters)
        for j in range(WIDTH):
            b = data[place + j]
            onto = np.bincount((b.astype(np.int64) * FILTERS + np.arange(FILTERS)).ravel(), dc.ravel(), 256 * FILTERS).reshape(256, FILTERS).astype(np.float32)
            g_filters[j] = self.embed.T @ onto
            g_embed += onto @ self.filters[j].T
        return [g_embed, g_filters, doc.T @ dh, dh.sum(0), hidden.T @ dz, dz.sum(keepdims=True)]


def fit(texts: list[bytes], good: np.ndarray, seed: int = 1, epochs: int = EPOCHS) -> Network | None:
    """The network for these texts; None where all are good or none is."""
    good = np.asarray(good, np.float32)
    order = np.random.default_rng(seed).permutation(len(texts))
    held, train = order[::HELD_OUT], np.delete(order, np.s_[::HELD_OUT])
    if not len(train) or good[train].min() == good[train].max():
        return None
    net = Network.start(seed)
    params = net.parameters()
    m, v = ([np.zeros_like(x) for x in params] for _ in range(2))
    share = good[train].mean()
    weight = np.where(good == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    r, step = np.random.default_rng(seed + 1), 0
    size = np.array([len(t) for t in texts])
    rounds = max(epochs, -(-epochs * 800 // len(train)) if len(train) < 800 else 0)
    steps = rounds * -(-len(train) // BATCH)
    with ThreadPoolExecutor(THREADS) as pool:
        for _ in range(rounds):
            mixed = r.permutation(train)
            for lo in range(0, len(mixed), BATCH):
                pick = mixed[lo : lo + BATCH]
                pick = pick[np.argsort(size[pick])]
                step += 1
                rate = RATE * min(1.0, step / 50) * (1 - 0.95 * step / steps)
                for i, g in enumerate(net.gradients([texts[x] for x in pick], good[pick], weight[pick], pool)):
                    m[i] += 0.1 * (g - m[i])
                    v[i] += 0.001 * (g * g - v[i])
                    params[i] -= rate * (m[i] / (1 - 0.9**step) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8) + DECAY * params[i])
    net.threshold = chosen_threshold(net.probabilities([texts[x] for x in held]), good[held] == 1)
    return net


def chosen_threshold(p: np.ndarray, good: np.ndarray) -> float:
    """Where bad documents kept and WORTH times the good ones lost, as shares, are least in sum."""
    low, high = BOUNDS
    some = np.unique(np.clip(np.concatenate([[low, 0.5], p]), low, high))
    if not good.any() or good.all():
        return 0.5
    kept = 1 - np.searchsorted(np.sort(p[~good]), some) / (~good).sum()
    lost = np.searchsorted(np.sort(p[good]), some) / good.sum()
    return float(some[np.argmin(kept + WORTH * lost)])


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, seed: int = 1) -> Network | None:
    """Fits the network to at most limit labelled documents of docs."""
    p = common.Plain(labels)
    told = p.df.select(p.long("doc_id").alias("doc_id"), ((p.col("quality") == 1) & (F.coalesce(p.col("toxic"), F.lit(0)) == 0)).alias("good"))
    told = told.where("doc_id is not null and good is not null").groupBy("doc_id").agg(F.min("good").alias("good"), F.max("good").alias("other")).where("good = other")
    texts = common.picked(docs, "doc_id", "text").where("text <> ''").withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    ids = texts.select("doc_id", "h").join(told, "doc_id", "left_semi").distinct().orderBy("h", "doc_id").limit(limit)
    few = F.broadcast(ids.join(told, "doc_id").select("doc_id", "good"))  # at most limit rows
    rows = texts.join(few, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("good").alias("good"), F.min("h").alias("h")).orderBy("h", "doc_id").toArrow()
    if not rows.num_rows:
        return None
    return fit([t.encode("utf-8", "replace") for t in rows.column("text").to_pylist()], np.array(rows.column("good").to_pylist()), seed)


def _scorer(net: Network | None, spark: SparkSession):
    shared = spark.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def score(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = shared.value
        for column in text:
            if net is None:
                yield pa.nulls(len(column), pa.float64())
                continue
            p = [net.probabilities(textkit.buffer(t)) for _, t in textkit.blocks([pa.record_batch([column], ["text"])])]
            yield pa.array(np.concatenate(p) if p else np.zeros(0), pa.float64())

    return score


def scores(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, probability, keep: one row for each row of docs."""
    d = common.picked(docs, "doc_id", "text")
    rows = d.select("doc_id", F.length("text").alias("size"), _scorer(net, docs.sparkSession)("text").alias("probability"))
    keep = F.lit(True) if net is None else (F.col("probability") >= F.lit(net.threshold)) & F.coalesce(F.col("size") > 0, F.lit(False))
    return rows.select("doc_id", "probability", keep.alias("keep"))


def filter_documents(docs: DataFrame, net: Network | None) -> DataFrame:
    """The rows of docs that are kept; columns as they are."""
    if net is None:
        return docs
    p = common.Plain(docs)
    rows = p.df.where(F.length(p.col("text")) > 0).withColumn("probability", _scorer(net, docs.sparkSession)(p.col("text")))
    return p.back(rows.where(F.col("probability") >= F.lit(net.threshold)))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents")
    return scores(docs, train(docs, common.load(spark, sf_dir, "labels")))
