"""Operator 5: language identification of words by a linear-chain conditional random field.

A word (a run of letters, digits and bytes outside ASCII) is described by binary features: itself and its length class,
its first and last 1 to 3 bytes, all its n-grams of 2 to 4 bytes with the word's bounds, and the lexicons in which it
stands; a lexicon has the LEXICON words most frequent in a language's training texts. Features are hashed into a table
of SLOTS rows with a weight for each language. Together with learned transition weights they make a chain over the words
of a line; forward-backward gives each word's marginal probabilities, and the word gets the most probable language.

Chains of more than PIECE words are cut into pieces that are worked on side by side: a piece's transfer matrix leads what
comes in on its left to what goes out on its right, so marginals are those of the whole chain and a line of a million
words takes no more steps than PIECE and the number of pieces.

Training text is what labelled documents have: at most TRAIN_DOCS documents of each language (by the least hashes of
their ids) go to the driver, of the TRAIN_LANGS languages with most documents. Since documents have one language each, code-switched lines are made of pieces of documents
of different languages, beside lines left as they are; the likelihood of the lines is climbed with Adam, gradients by
forward-backward. One part in HELD_OUT of the documents is kept apart and measured.

Result: one row for each row of docs: doc_id; lang, the language with the largest sum of marginals; its share of that
sum; n_words; and spans, an array of (first word, words, lang) of maximal runs of words of one language.

Nulls and cases: a null or empty text, or one without words, has a null lang and share, no words and no spans. Texts are
read whole, however long they or their lines are. A doc_id that is no whole number is null. Documents without a label
aren't learned from. With labels of one language only every word gets it; without any label lang, share
and spans are null. Equal sums go to the language whose name sorts first. Repeated rows come out as often; an empty table
gives no rows. Columns other than doc_id, text and (for training) lang are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tarnsieve.llm import common, textkit

SLOTS, LEXICON = 1 << 17, 400
#: Labelled documents of each language that the field is fitted to at most; one part in HELD_OUT is only measured.
TRAIN_DOCS, HELD_OUT = 150, 5
#: Languages that are learned at most.
TRAIN_LANGS = 200
#: Words of a chain that are followed one after another.
PIECE = 1024
EPOCHS, BATCH, RATE, DECAY = 3, 64, 0.05, 1e-5
#: Words whose scores a worker keeps at most before it begins anew.
REMEMBERED = 1 << 19

_LINE = np.zeros(256, bool)
_LINE[[*b"\n\r"]] = True
_GRAM = [np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xB5297A4D3F84D5B5), np.uint64(0x2545F4914F6CDD1D)]


def _slot(h: np.ndarray, kind: int) -> np.ndarray:
    return (textkit.mix(h ^ np.uint64(kind * 0x632BE59BD9B4E019 & (1 << 64) - 1)) & np.uint64(SLOTS - 1)).astype(np.int64)


def features(words: list[bytes], lexicons: list[set[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all features of the words, and where each word's begin."""
    n = len(words)
    size = np.array([len(w) for w in words], np.int64)
    raw = np.frombuffer(b"".join(b"\2" + w + b"\3" for w in words) + b"\0\0\0\0", np.uint8).astype(np.uint64)
    begin = np.concatenate([[0], np.cumsum(size + 2)])
    total = int(begin[-1])
    end = np.repeat(begin[1:], size + 2)
    at, owner = np.arange(total), np.repeat(np.arange(n), size + 2)
    slots, owners = [], []
    gram = raw[:total] + np.uint64(1)
    for k in range(2, 5):
        gram = gram * _GRAM[k - 2] + raw[k - 1 : total + k - 1] + np.uint64(1)
        ok = at + k <= end
        slots.append(_slot(gram[ok], k))
        owners.append(owner[ok])
    head, tail = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for k in range(1, 4):
        there = np.flatnonzero(size >= k)
        head[there] = head[there] * _GRAM[3] + raw[begin[there] + k] + np.uint64(1)
        tail[there] = tail[there] * _GRAM[3] + raw[begin[there] + 1 + size[there] - k] + np.uint64(1)
        for j, x in enumerate((head, tail)):
            slots.append(_slot(x[there], 10 + 2 * k + j))
            owners.append(there)
    clean = np.frombuffer(b"".join(words), np.uint8)
    off = np.concatenate([[0], np.cumsum(size)])
    slots += [_slot(textkit.span_hashes(clean, off[:-1], off[1:]), 30), _slot(np.minimum(size, 12).astype(np.uint64), 31)]
    owners += [np.arange(n)] * 2
    for j, lexicon in enumerate(lexicons):
        within = np.array([i for i, w in enumerate(words) if w in lexicon], np.int64)
        slots.append(np.full(len(within), int(_slot(np.array([j + 1], np.uint64), 40)[0])))
        owners.append(within)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(slots)[order], np.searchsorted(owner[order], np.arange(n))


def _pieces(chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """chain with chains of more than PIECE words cut; which pieces begin a chain."""
    size = np.diff(chain)
    n = np.maximum(1, -(-size // PIECE))
    if not len(size) or n.max() == 1:
        return chain, np.ones(len(size), bool)
    first = np.zeros(int(n.sum()), bool)
    lead = np.concatenate([[0], np.cumsum(n)[:-1]])
    first[lead] = True
    of = np.repeat(np.arange(len(n)), n)
    return np.append(chain[:-1][of] + (np.arange(len(of)) - lead[of]) * PIECE, chain[-1]), first


def marginals(scores: np.ndarray, trans: np.ndarray, start: np.ndarray, chain: np.ndarray, want_pairs: bool = False):
    """Of all words the languages' marginals; chain: where each chain begins, and the end. Also log Z and expected transitions if wanted."""
    n, k = scores.shape
    whole, (chain, first) = chain, _pieces(chain)
    size = np.diff(chain)
    order = np.argsort(-size, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    lead, size = chain[:-1][order], size[order]
    top = scores.max(1, keepdims=True)
    e = np.exp(scores - top)
    t, s = np.exp(trans), np.exp(start)
    alpha, beta, scale = np.empty((n, k)), np.ones((n, k)), np.empty(n)
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), "left")  # pieces with more words than i
    into = np.tile(s, (len(order), 1))  # what stands before each piece's first word, by place in order
    out = np.ones((len(order), k))  # what comes after its last
    if not first.all():
        # what a piece makes of each language before its first word
        carry = np.tile(t, (len(order), 1, 1))
        for i in range(longest):
            at = lead[: active[i]] + i
            c = (carry[: active[i]] if i == 0 else carry[: active[i]] @ t) * e[at][:, None, :]
            carry[: active[i]] = c / c.sum((1, 2), keepdims=True)
        before = None
        for piece in range(len(order)):
            at = place[piece]
            if first[piece]:  # its first word has the start instead
                before = None
            if before is not None:
                into[at] = before @ t
            if piece + 1 < len(order) and not first[piece + 1]:
                if before is None:
                    a = s * e[lead[at]]
                    for i in range(1, int(size[at])):
                        a = (a / a.sum() @ t) * e[lead[at] + i]
                else:
                    a = before @ carry[at]
                before = a / a.sum()
        after = np.ones(k)
        for piece in range(len(order) - 1, -1, -1):
            at = place[piece]
            last = piece + 1 == len(order) or first[piece + 1]
            if last:
                after = np.ones(k)
            out[at] = after
            if not first[piece]:
                after = carry[at] @ after
                after /= after.sum()
    for i in range(longest):
        at = lead[: active[i]] + i
        a = e[at] * into[: active[i]] if i == 0 else (alpha[at - 1] @ t) * e[at]
        z = a.sum(1)
        scale[at] = z
        alpha[at] = a / z[:, None]
    ends = lead + size - 1
    beta[ends] = out
    for i in range(longest - 1, 0, -1):
        at = lead[: active[i]] + i
        b = ((e[at] * beta[at]) @ t.T) / scale[at][:, None]
        beta[at - 1] = b
    p = alpha * beta
    p /= p.sum(1, keepdims=True)
    if not want_pairs:
        return p
    later = np.ones(n, bool)
    later[whole[:-1]] = False
    j = np.flatnonzero(later)
    each = alpha[j - 1][:, :, None] * t * (e[j] * beta[j])[:, None, :] if not first.all() else None
    if each is not None:
        pairs = (each / each.sum((1, 2), keepdims=True)).sum(0)
    else:
        pairs = (alpha[j - 1].T @ (e[j] * beta[j] / scale[j][:, None])) * t
    return p, float(np.log(scale).sum() + top.sum()), pairs


@dataclass
class Field:
    langs: list[str]
    lexicons: list[set[bytes]]
    weights: np.ndarray  # SLOTS, languages
    trans: np.ndarray
    start: np.ndarray
    accuracy: float = float("nan")  # of words of held-out lines

    def scores(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.langs)))
        slots, lead = features(words, self.lexicons)
        return np.add.reduceat(self.weights[slots], lead).astype(np.float64)


def split_words(texts: pa.Array) -> tuple[textkit.Words, np.ndarray]:
    """Words of the texts in lower case, and the first word of each line that has any (and the end)."""
    raw, off = textkit.buffer(textkit.lower(texts))
    words = textkit.Words(raw, off)
    breaks = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_LINE[raw], out=breaks[1:])
    line = breaks[words.starts] if len(words.starts) else np.zeros(0, np.int64)
    new = np.ones(len(line), bool)
    new[1:] = np.diff(line) > 0
    new[words.first[:-1][np.diff(words.first) > 0]] = True
    return words, np.append(np.flatnonzero(new), len(line))


def _lines(text: str) -> list[list[bytes]]:
    words, chain = split_words(pa.array([text], pa.large_string()))
    flat = [words.raw[a:b].tobytes() for a, b in zip(words.starts, words.ends)]
    return [flat[a:b] for a, b in zip(chain[:-1], chain[1:])]


def _switched(docs: list[tuple[int, list[list[bytes]]]], r: np.random.Generator) -> list[tuple[list[bytes], list[int]]]:
    """Chains with gold languages: the documents' lines, and as many made of pieces of several documents."""
    out, by = [], {}
    for y, lines in docs:
        for line in lines:
            out.append((line, [y] * len(line)))
            by.setdefault(y, []).append(line)
    langs = sorted(by)
    for _ in range(len(out) if len(langs) > 1 else 0):
        words, gold, y = [], [], int(r.integers(len(langs)))
        for _ in range(int(r.integers(2, 6))):
            line = by[langs[y]][int(r.integers(len(by[langs[y]])))]
            n = min(len(line), int(r.integers(2, 16)))
            a = int(r.integers(len(line) - n + 1))
            words += line[a : a + n]
            gold += [langs[y]] * n
            y = (y + int(r.integers(1, len(langs)))) % len(langs)
        out.append((words, gold))
    return out


def fit(texts: list[str], labels: list[str], seed: int = 1, epochs: int = EPOCHS) -> Field | None:
    """The field for these labelled texts; None where there are none."""
    langs = sorted({*labels})
    if not langs:
        return None
    r = np.random.default_rng(seed)
    docs = [(langs.index(y), _lines(t)) for t, y in zip(texts, labels)]
    train, held = [d for i, d in enumerate(docs) if i % HELD_OUT or len(langs) == 1], [d for i, d in enumerate(docs) if not i % HELD_OUT]
    lexicons = []
    for y in range(len(langs)):
        count: dict[bytes, int] = {}
        for z, lines in train:
            if z == y:
                for line in lines:
                    for w in line:
                        count[w] = count.get(w, 0) + 1
        lexicons.append({w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]})
    k = len(langs)
    field = Field(langs, lexicons, np.zeros((SLOTS, k), np.float32), np.eye(k), np.zeros(k))
    if k == 1:
        return field
    chains = _switched(train, r)
    vocabulary = {w: i for i, w in enumerate(sorted({w for c, _ in chains for w in c}))}
    slots, lead = features([*vocabulary], lexicons)
    ends = np.append(lead[1:], len(slots))
    params = [field.weights, field.trans, field.start]
    m, v = ([np.zeros(x.shape, np.float64 if x.dtype == np.float64 else np.float32) for x in params] for _ in range(2))
    steps, step = epochs * -(-len(chains) // BATCH), 0
    for _ in range(epochs):
        order = r.permutation(len(chains))
        for lo in range(0, len(order), BATCH):
            pick = [chains[x] for x in order[lo : lo + BATCH]]
            ids = np.array([vocabulary[w] for c, _ in pick for w in c])
            gold = np.array([y for _, g in pick for y in g])
            chain = np.concatenate([[0], np.cumsum([len(c) for c, _ in pick])])
            own, back = np.unique(ids, return_inverse=True)
            size = ends[own] - lead[own]
            spots = slots[np.repeat(lead[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
            each = np.add.reduceat(field.weights[spots], np.concatenate([[0], np.cumsum(size)[:-1]])).astype(np.float64)
            p, _, pairs = marginals(each[back], field.trans, field.start, chain, True)
            p[np.arange(len(gold)), gold] -= 1
            g_words = np.stack([np.bincount(back, p[:, y], len(own)) for y in range(k)], 1)
            later = np.ones(len(gold), bool)
            later[chain[:-1]] = False
            j = np.flatnonzero(later)
            np.add.at(pairs, (gold[j - 1], gold[j]), -1)
            touched, where = np.unique(spots, return_inverse=True)
            g_slots = np.stack([np.bincount(where, np.repeat(g_words[:, y], size), len(touched)) for y in range(k)], 1)
            step += 1
            rate = RATE * (1 - 0.9 * step / steps)
            n = len(gold)
            for i, (rows, g) in enumerate(((touched, g_slots / n), (slice(None), pairs / n), (slice(None), p[chain[:-1]].sum(0) / n))):
                m[i][rows] += 0.1 * (g - m[i][rows])
                v[i][rows] += 0.01 * (g * g - v[i][rows])
                params[i][rows] -= rate * (m[i][rows] / (1 - 0.9**step) / (np.sqrt(v[i][rows] / (1 - 0.99**step)) + 1e-8) + DECAY * params[i][rows])
    test = _switched(held, r)
    if test:
        words = [w for c, _ in test for w in c]
        p = marginals(field.scores(words), field.trans, field.start, np.concatenate([[0], np.cumsum([len(c) for c, _ in test])]))
        field.accuracy = float((p.argmax(1) == np.array([y for _, g in test for y in g])).mean())
    return field


def train(docs: DataFrame, per_language: int = TRAIN_DOCS, seed: int = 1) -> Field | None:
    """Fits the field to at most per_language documents of each language of docs."""
    p = common.Plain(docs)
    rows = p.df.select(p.long("doc_id").alias("doc_id"), p.col("lang").cast("string").alias("lang"), p.col("text").alias("text"))
    rows = rows.where("lang is not null and text <> ''").withColumn("h", F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")))
    langs = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(TRAIN_LANGS)
    first = rows.join(F.broadcast(langs.select(F.col("lang").alias("known"))), F.col("lang") == F.col("known"), "left_semi").select("lang", "h").distinct()
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= per_language)
    few = F.broadcast(first.select(F.col("lang").alias("its"), F.col("h").alias("chosen")))  # at most per_language rows of each of TRAIN_LANGS languages
    got = rows.join(few, (F.col("lang") == F.col("its")) & (F.col("h") == F.col("chosen"))).groupBy("h", "lang").agg(F.min("text").alias("text")).orderBy("h", "lang").toArrow()
    return fit(got.column("text").to_pylist(), got.column("lang").to_pylist(), seed)


class Labeller:
    """Labels blocks of texts; remembers the scores of words it has seen."""

    def __init__(self, field: Field):
        self.field = field
        self.forget()

    def forget(self) -> None:
        self.keys, self.known = np.zeros(0, np.uint64), np.zeros((0, len(self.field.langs)))

    def scores(self, words: textkit.Words) -> np.ndarray:
        h = words.hashes()
        own, lead, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, own), max(0, len(self.keys) - 1))
        new = self.keys[at] != own if len(self.keys) else np.ones(len(own), bool)
        i = lead[new]
        fresh = self.field.scores([words.raw[a:b].tobytes() for a, b in zip(words.starts[i], words.ends[i])])
        out = np.empty((len(own), len(self.field.langs)))
        out[new] = fresh
        out[~new] = self.known[at[~new]]
        if len(self.keys) > REMEMBERED:
            self.forget()
        keys, known = np.concatenate([self.keys, own[new]]), np.concatenate([self.known, fresh])
        order = np.argsort(keys)
        self.keys, self.known = keys[order], known[order]
        return out[back]

    def label(self, texts: pa.Array) -> list[tuple]:
        """(language, share, words, spans) of each text."""
        words, chain = split_words(texts)
        out: list[tuple] = [(None, None, 0, [])] * len(texts)
        if not len(words.starts):
            return out
        p = marginals(self.scores(words), self.field.trans, self.field.start, chain)
        best = p.argmax(1)
        rows, lead = textkit.row_slices(words.first)
        sums = np.add.reduceat(p, lead)
        change = np.ones(len(best), bool)
        change[1:] = np.diff(best) != 0
        change[lead] = True
        begin = np.flatnonzero(change)
        size = np.diff(np.append(begin, len(best)))
        cuts = np.append(np.searchsorted(begin, lead), len(begin))
        langs = self.field.langs
        for i, row in enumerate(rows.tolist()):
            a, b = cuts[i], cuts[i + 1]
            top = int(sums[i].argmax())
            spans = [{"first": int(x - lead[i]), "n": int(y), "lang": langs[z]} for x, y, z in zip(begin[a:b], size[a:b], best[begin[a:b]])]
            out[row] = (langs[top], float(sums[i][top] / sums[i].sum()), int(words.first[row + 1] - words.first[row]), spans)
        return out


_SCHEMA = "doc_id long, lang string, share double, n_words long, spans array<struct<first:int,n:int,lang:string>>"
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32()), ("lang", pa.string())]))


def _label(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        labeller = Labeller(field) if field else None
        for rows, texts in textkit.blocks(batches):
            if labeller:
                got = labeller.label(texts)
            else:
                got = [(None, None, int(n), None) for n in np.diff(split_words(texts)[0].first)]
            lang, share, n, spans = zip(*got)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(lang, pa.string()), pa.array(share, pa.float64()), pa.array(n, pa.int64()), pa.array(spans, _SPANS)], names=["doc_id", "lang", "share", "n_words", "spans"])

    return run


def identify(docs: DataFrame, field: Field | None) -> DataFrame:
    """The languages of the words of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    return common.picked(docs, "doc_id", "text").mapInArrow(_label(shared), _SCHEMA)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents")
    return identify(docs, train(docs))
