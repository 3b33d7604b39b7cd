"""Whole Arrow columns of text as byte arrays: blocks, word bounds, rolling hashes. Runs in Python workers on numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer text makes a block of its own.
BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_rng = np.random.default_rng(20240117)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}

#: Letters, digits and every byte of a character outside ASCII belong to words.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over each other, in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def strings(column: pa.Array) -> pa.Array:
    """As large_string, without nulls; bytes that are no UTF-8 are replaced."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    return pc.fill_null(column, "")


def lower(column: pa.Array) -> pa.Array:
    try:
        return pc.utf8_lower(column)
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace").lower() for x in column.cast(pa.large_binary()).to_pylist()], pa.large_string())


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array, and the offsets of its rows in them."""
    n = len(column)
    off = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    lo, hi = int(off[0]), int(off[-1])
    raw = np.frombuffer(data, np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
    return raw, off - lo


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Runs of rows of at most limit bytes of text (or one row), with that text as strings()."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = strings(batch.column(batch.schema.get_field_index(text)))
        _, off = buffer(column)
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at), column.slice(at, end - at)
            at = end


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse modulo 2^64, to the powers 0 ... n - 1."""
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK + (BLOCK >> 2))
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


class Words:
    """Where words start and end in raw, their hashes, and at first[row] the first word of each row."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, inside: np.ndarray = WORD):
        n = len(raw)
        mask = inside[raw]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        opens, closes = mask.copy(), mask.copy()
        if n:
            opens[1:] &= ~mask[:-1] | edge[1:n]
            closes[:-1] &= ~mask[1:] | edge[1:n]
        self.raw, self.starts, self.ends = raw, np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, off)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.raw, self.starts, self.ends)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of the spans (starts in order), by differences of running sums over about BLOCK bytes each."""
    if len(raw) <= 2 * BLOCK:
        return _span_hashes(raw, starts, ends)
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, lo + BLOCK)))
        out[i:j] = _span_hashes(raw[lo : ends[i:j].max()], starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return out


def _span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words of each row (of the whole row where it has fewer, none where it has none) and each row's first."""
    count = np.diff(first)
    have = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    at = np.zeros(len(count) + 1, np.int64)
    np.cumsum(have, out=at[1:])
    pad = np.concatenate([h, np.zeros(n, np.uint64)])
    full = np.zeros(len(h), np.uint64)
    mults = [np.uint64(pow(0xB5297A4D3F84D5B5, j + 1, 1 << 64) | 1) for j in range(n)]
    for j in range(n):
        full += pad[j : j + len(h)] * mults[j]
    keep = np.ones(len(h), bool)
    long, short = count >= n, (count > 0) & (count < n)
    for j in range(1, n):
        keep[first[1:][long] - j] = False
    if short.any():
        lead, size = first[:-1][short], count[short]
        part = np.zeros(len(lead), np.uint64)
        for j in range(n):
            part += np.where(j < size, pad[lead + j], np.uint64(0)) * mults[j]
            if j:
                keep[(lead + j)[j < size]] = False
        full[lead] = part
    return mix(full[keep]), at


def row_slices(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have anything, and where theirs starts: what ufunc.reduceat needs."""
    rows = np.flatnonzero(np.diff(at) > 0)
    return rows, at[rows]
