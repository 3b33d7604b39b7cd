"""Operator 10: benchmark decontamination by canonical templates.

A text becomes a row of tokens in lower case, in which a number is <num>, a capitalised word inside a sentence is <name>
(a run of them is one name) and a unit of measure right after a number is <unit>. Windows of WINDOW such tokens, of
which at least LITERALS are words, are hashed and joined by hash between documents and benchmark items; an item of fewer
tokens is one window, and the documents' windows of that length are joined too. Whatever stands in the slots stays
beside the window. Within one copy of an item (one difference of positions) a slot value of the item has to stand for
one and the same value of the document: windows that contradict the mapping most others use don't count. A document is
contaminated by an item if the windows that count hold at least COVERAGE of the item's windows, or a run of at least LONG
tokens of it in one copy, however long the item is; "reworded" says that some slot has another value than in the item.

Capitals make names, so a copy in upper or title case has other windows than the item. A second series of windows is
therefore blind to case: no token is a name there, all else is the same. The series are hashed, joined and judged apart,
and a document is contaminated if it is so in any; the counts told are those of the first series that says so.

With thin=True, as the query and the pipeline have it, items without a window of LITERALS words are looked for too, in
three more series. By values: windows of any tokens, blind to case, in which every token stands for itself, at COVERAGE;
so each item that has a token is found where it is copied, and a very short one wherever its tokens stand in a row. By
template, with names and without: windows of at least THIN words; all of an item's have to be in one copy, with
consistent slots, and to hold all of its tokens, since so few words say little alone.

The windows of a benchmark of up to FILTER_BYTES filter the documents' windows where they are made (a bitmap, then a
sorted array: exact), so only hits reach the join; a larger benchmark is joined without the filter, by shuffle, with
the same result.

Nulls and cases: a null or empty text has no windows, on either side. Without thin, items that lack a window of
LITERALS words are never found; with it, thin items with a stretch of fewer than THIN words in every window are found by
their values alone. Equal rows of a side count once; a text of any length is read whole. A null doc_id or item_id is a
value like any other, and one that is no whole number is null. Ties: of slot values that as many windows vote for the
least hash stands. Empty tables give no rows. Only doc_id, text and item_id, text are read; other columns are ignored, and
pass through decontaminate(), whatever their names. Capitals are told in all scripts of two bytes a letter (Latin, Greek,
Cyrillic, Armenian); units are English words and symbols, those of other languages are words like any other.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsieve.llm import common, textkit

WINDOW, LITERALS, COVERAGE = 8, 5, 0.3
#: Tokens of an item that suffice where they stand in a row.
LONG = 24
#: Words that a window of a thin item's template has at least.
THIN = 3
#: Bytes of benchmark window hashes up to which they go to every worker as a filter.
FILTER_BYTES = 64 << 20

UNITS = """kg g mg lb lbs oz ton tons tonne tonnes km m cm mm mi mile miles meter meters metre metres foot feet ft inch inches in yard yards
l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
mph kmh kph w kw kwh v volt volts a amp amps hz khz mhz ghz j kj cal kcal pa kpa n degree degrees celsius fahrenheit percent usd eur gbp
dollar dollars cent cents euro euros pound pounds yen kb mb gb tb""".split()

_KIND = np.zeros(256, np.uint8)
_KIND[textkit.WORD] = 1
_KIND[48:58] = 2
#: Whether two bytes are a capital letter.
_CAPITAL = np.zeros(1 << 16, bool)
_CAPITAL[[int.from_bytes(chr(c).encode(), "big") for c in range(0x80, 0x800) if chr(c).isupper()]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[*b".!?\n"]] = True
_JOIN = {2: np.zeros(256, bool), 3: np.zeros(256, bool)}
_JOIN[2][[*b".,:/-"]] = True
_JOIN[3][[*b" -"]] = True
_UNIT_HASHES = np.sort(textkit.span_hashes(np.frombuffer(" ".join(UNITS).encode(), np.uint8), *(lambda w: (w.starts, w.ends))(textkit.Words(np.frombuffer(" ".join(UNITS).encode(), np.uint8), np.array([0, len(" ".join(UNITS))])))))
_SLOT = np.array([0, 0, 0x1B873593CC9E2D51, 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85], np.uint64)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens of the texts: hash of the template token, kind (1 word, 2 number, 3 name, 4 unit), hash of the value; and each text's first."""
    return readings(texts, [True])[0]


def readings(texts: pa.Array, named: list[bool]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """tokens() once for each of named: with names, or blind to case, without them."""

    def spans(column):
        raw, off = textkit.buffer(column)
        kind = _KIND[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[off] = True
        opens = kind > 0
        closes = opens.copy()
        if len(raw):
            differs = kind[1:] != kind[:-1]
            opens[1:] &= differs | edge[1 : len(raw)]
            closes[:-1] &= differs | edge[1 : len(raw)]
        starts = np.flatnonzero(opens)
        return raw, off, kind, starts, np.flatnonzero(closes) + 1

    raw, off, kind, starts, ends = spans(texts)
    low, _, _, lo, hi = spans(textkit.lower(texts))
    first = np.searchsorted(starts, off)
    if len(lo) != len(starts):  # lower case of some rare letter isn't a letter: take the bytes as they are
        low, lo, hi = raw, starts, ends
    value = textkit.span_hashes(low, lo, hi)
    plain = kind[starts]
    if not len(plain):
        return [(value, plain, value, first)] * len(named)
    heads = np.zeros(len(plain), bool)
    heads[first[:-1][np.diff(first) > 0]] = True

    def names():
        lead = raw[starts]
        cap = (lead >= 65) & (lead <= 90)
        two = np.flatnonzero((lead >= 0xC2) & (lead <= 0xDF) & (starts + 1 < len(raw)))
        cap[two] |= _CAPITAL[lead[two].astype(np.int64) << 8 | raw[starts[two] + 1]]
        c = np.flatnonzero(cap & ~heads & (plain == 1))
        breaks = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(_BREAK[raw], out=breaks[1:])
        return c[breaks[starts[c]] == breaks[ends[c - 1]]]

    def read(with_names: bool):
        k, v, begin = plain.copy(), value, first
        if with_names:
            k[names()] = 3
        u = np.flatnonzero((k[1:] == 1) & (k[:-1] == 2) & ~heads[1:] & (starts[1:] - ends[:-1] <= 1)) + 1
        at = np.searchsorted(_UNIT_HASHES, v[u])
        k[u[_UNIT_HASHES[np.minimum(at, len(_UNIT_HASHES) - 1)] == v[u]]] = 4
        # numbers and names of several parts are one token
        same = np.zeros(len(k), bool)
        for kind_, joins in _JOIN.items():
            i = np.flatnonzero((k[1:] == kind_) & (k[:-1] == kind_) & ~heads[1:] & (starts[1:] - ends[:-1] == 1)) + 1
            same[i[joins[raw[starts[i] - 1]]]] = True
        if same.any():
            keep = np.flatnonzero(~same)
            last = np.append(keep[1:], len(k)) - 1
            parts = np.flatnonzero(last > keep)
            v = value[keep]
            v[parts] = textkit.span_hashes(low, lo[keep[parts]], hi[last[parts]])
            k, begin = k[keep], np.searchsorted(keep, first)
        return np.where(k == 1, v, _SLOT[k]), k, v, begin

    return [read(x) for x in named]


def windows(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of n tokens with enough words: row, position in it, hash; then kinds and values of all tokens, and the windows' first tokens."""
    token, kind, value, first = tokens(texts)
    return (*_windows(token, kind, first, n), kind, value)


def _windows(token, kind, first, n, series=0):
    count = np.diff(first)
    words = np.zeros(len(kind) + 1, np.int64)
    np.cumsum(kind == 1, out=words[1:])
    inside = np.ones(len(kind), bool)
    for j in range(1, n):
        back = first[1:] - j
        inside[back[j <= count]] = False
    inside[max(0, len(kind) - n + 1) :] = False
    at = np.flatnonzero(inside)
    at = at[words[at + n] - words[at] >= [min(LITERALS, n), THIN, 0][series // 2]]
    h = np.zeros(len(at), np.uint64)
    for j in range(n):
        h += token[at + j] * np.uint64(pow(0xB5297A4D3F84D5B5, j + 1, 1 << 64) | 1)
    h = textkit.mix(h ^ np.uint64((n + series * (WINDOW + 1)) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
    row = np.searchsorted(first, at, "right") - 1
    return row, at, at - first[row], h


class Filter:
    """Whether hashes are among some: most are told by a bitmap, the rest by a sorted array."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes.view(np.uint64))
        self.bits = max(16, min(27, int(len(self.hashes) * 64).bit_length()))
        self.map = np.zeros(1 << self.bits, bool)
        self.map[self.hashes >> np.uint64(64 - self.bits)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.map[h >> np.uint64(64 - self.bits)])
        where = np.minimum(np.searchsorted(self.hashes, h[at]), max(0, len(self.hashes) - 1))
        return at[self.hashes[where] == h[at]] if len(self.hashes) else at[:0]


_WINDOWS = "id long, k long, series int, h long, pos int, n_tokens int, slots array<long>"
#: The series: by template with names, and blind to case; then for thin items alone the same two, and by values.
SERIES, WHOLE, VALUES = 5, (2, 3), 4


def _series(texts: pa.Array) -> list:
    """tokens() of each series."""
    names, blind = readings(texts, [True, False])
    _, kind, value, first = blind
    return [names, blind, names, blind, (value, np.ones_like(kind), value, first)]


def _whole(row: np.ndarray, pos: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Whether windows (in order) belong to rows whose windows hold all of their tokens."""
    lead = np.flatnonzero(np.diff(row, prepend=-1))
    last = np.append(lead[1:], len(row)) - 1 if len(row) else lead
    gap = np.flatnonzero((np.diff(row) == 0) & (np.diff(pos) > n))
    bad = np.zeros(len(size), bool)
    bad[row[lead[pos[lead] > 0]]] = bad[row[last[pos[last] + n < size[row[last]]]]] = bad[row[gap]] = True
    return ~bad[row]


def _cut_windows(lengths: list[tuple[int, int]], known=None, thin: bool = False):
    """id, k, text -> windows of these (series, length). None, for items: all series; WINDOW, or the text's own number of tokens where it has fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = known.value if known is not None else None
        for rows, texts in textkit.blocks(batches):
            read = _series(texts)
            have = np.zeros((2, len(texts)), bool)  # whether items have a window of enough words, with names or without
            for series, n in lengths or product(range(SERIES if thin else 2), range(1, WINDOW + 1)):
                token, kind, value, first = read[series]
                size = np.diff(first)
                row, at, pos, h = _windows(token, kind, first, n, series)
                if not lengths and n < WINDOW:
                    own = size[row] == n
                    row, at, pos, h = row[own], at[own], pos[own], h[own]
                if not lengths and series < 2:
                    have[series, row] = True
                elif not lengths:
                    own = ~have[0 if series == 2 else 1, row]
                    if series in WHOLE:
                        own &= _whole(row, pos, size, n)
                    row, at, pos, h = row[own], at[own], pos[own], h[own]
                if keep is not None:
                    hit = keep(h)
                    row, at, pos, h = row[hit], at[hit], pos[hit], h[hit]
                if not len(at):
                    continue
                cells = at[:, None] + np.arange(n)
                slot = kind[cells] > 1
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(slot.sum(1))]).astype(np.int32)), pa.array(value[cells[slot]].view(np.int64)))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([rows.column(0).take(take), rows.column(1).take(take), pa.array(np.full(len(at), series, np.int32)), pa.array(h.view(np.int64)), pa.array(pos.astype(np.int32)), pa.array(np.full(len(at), n, np.int32)), lists], names=["id", "k", "series", "h", "pos", "n_tokens", "slots"])

    return run


def _copies(found: list[tuple]) -> Iterable[list[tuple]]:
    copies = defaultdict(list)
    for x in found:
        copies[x[1] - x[0]].append(x)
    return copies.values()


def _agreeing(copy: list[tuple]) -> list[tuple]:
    """The windows of one copy that don't contradict the mapping of slots that most have."""
    votes: dict[int, Counter] = defaultdict(Counter)
    for _, _, a, b in copy:
        for x, y in {*zip(a, b)}:
            votes[x][y] += 1
    stands = {x: min(v, key=lambda y: (-v[y], y)) for x, v in votes.items()}
    return [w for w in copy if all(stands[x] == y for x, y in zip(w[2], w[3]))]


def consistent(found: list[tuple[int, int, list[int], list[int]]]) -> tuple[int, bool]:
    """(item position, document position, item's slot values, document's) of windows -> distinct item positions that count; whether slots differ."""
    good, differs = set(), False
    for copy in _copies(found):
        for ip, _, a, b in _agreeing(copy):
            good.add(ip)
            differs |= any(x != y for x, y in zip(a, b))
    return len(good), differs


def in_one_copy(found: list[tuple[int, int, list[int], list[int]]]) -> tuple[int, bool]:
    """consistent() of the copy that has the most."""
    return max((consistent(c) for c in _copies(found)), key=lambda v: (v[0], not v[1]))


def longest_run(found: list[tuple[int, int, list[int], list[int]]]) -> int:
    """Item positions in a row, in one copy, of windows that agree with their copy."""
    most = 0
    for copy in _copies(found):
        run, last = 0, None
        for ip in sorted({w[0] for w in _agreeing(copy)}) if len(copy) > most else ():
            run = run + 1 if last == ip - 1 else 1
            most, last = max(most, run), ip
    return most


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        verdicts = []
        for s, r in zip(batch.column(4).to_pylist(), batch.column(6).to_pylist()):
            found = [(x["ip"], x["dp"], x["a"], x["b"]) for x in r]
            verdicts.append((*(in_one_copy if s in WHOLE else consistent)(found), longest_run(found)))
        yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(6)), *(pa.array([v[j] for v in verdicts], t) for j, t in enumerate((pa.int64(), pa.bool_(), pa.int64())))], names=["doc_id", "k", "item_id", "ik", "series", "of_windows", "windows", "reworded", "run"])


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, filter_bytes: int = FILTER_BYTES, thin: bool = False) -> DataFrame:
    """doc_id, k, item_id, windows, of_windows, reworded: the units of docs that hold at least coverage of an item's windows.

    thin: whether to look for items without a window of LITERALS words too.
    """
    items = common.picked(benchmark, "item_id", "text").select(F.col("item_id").alias("id"), F.xxhash64("text").alias("k"), "text").distinct()
    of = common.cut(items.mapInArrow(_cut_windows([], thin=thin), _WINDOWS))
    total = of.groupBy("id", "k", "series").agg(F.count("*").alias("of_windows"))
    lengths = sorted({tuple(r) for r in of.select("series", "n_tokens").distinct().collect()} or {(0, WINDOW)})
    known = None
    if of.count() * 8 <= filter_bytes:
        hashes = of.select("h").distinct().toPandas()["h"].to_numpy(np.int64)
        known = docs.sparkSession.sparkContext.broadcast(Filter(hashes))
    units = common.units_of(docs).select(F.col("doc_id").alias("id"), "k", "text")
    mine = units.mapInArrow(_cut_windows(lengths, known), _WINDOWS).select(F.col("id").alias("doc_id"), F.col("k").alias("dk"), "h", F.col("pos").alias("dp"), F.col("slots").alias("b"))
    of = of.join(total.select(F.col("id").alias("ti"), F.col("k").alias("tk"), F.col("series").alias("ts"), "of_windows"), F.col("id").eqNullSafe(F.col("ti")) & (F.col("k") == F.col("tk")) & (F.col("series") == F.col("ts")))
    theirs = of.select(F.col("id").alias("item_id"), F.col("k").alias("ik"), "series", "h", F.col("pos").alias("ip"), F.col("slots").alias("a"), "of_windows")
    pairs = mine.join(theirs, "h").groupBy("doc_id", F.col("dk").alias("k"), "item_id", "ik", "series", "of_windows").agg(F.collect_set(F.struct("ip", "dp", "a", "b")).alias("w"))
    enough = F.when(F.col("series").isin(*WHOLE), F.col("of_windows")).otherwise(F.lit(coverage) * F.col("of_windows"))
    in_a_row = F.when(F.col("series").isin(*WHOLE), F.col("of_windows")).otherwise(F.lit(LONG - WINDOW + 1))
    pairs = pairs.where(F.size("w") >= F.least(enough, in_a_row))
    judged = pairs.mapInArrow(_judge, "doc_id long, k long, item_id long, ik long, series int, of_windows long, windows long, reworded boolean, run long")
    found = judged.where((F.col("windows") >= enough) | (F.col("run") >= in_a_row))
    first = found.groupBy("doc_id", "k", "item_id", "ik").agg(F.min(F.struct("series", "windows", "of_windows", "reworded")).alias("x"))
    return first.select("doc_id", "k", "item_id", "x.windows", "x.of_windows", "x.reworded")


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, thin: bool = False) -> DataFrame:
    """docs without the rows that contaminated() finds; columns as they are."""
    return common.without_units(docs, common.cut(contaminated(docs, benchmark, coverage, thin=thin).select("doc_id", "k").distinct()))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "benchmark"), thin=True).drop("k")
