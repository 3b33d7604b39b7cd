"""Operator 3: HTML extraction by host suffix arrays.

A page's visible text is a stream of tokens (runs of other characters than white space). The streams of a host's pages
are concatenated, each with an end of its own, and the suffixes of the concatenation are sorted by prefix doubling up
to RUN tokens: neighbours that agree so far are one run of ranks. Where such a run has suffixes of different pages, the
RUN tokens from each of its positions on are boilerplate; longer repeats are the union of such windows, so sorting
deeper would add nothing. What isn't covered is kept: the unique runs, in order, each on lines of its own.

A host of more than SLICE_BYTES of HTML is cut into slices of whole pages by hash, each with a suffix array of its own.
What repeats across slices is found in buckets of suffixes: those that begin with the same RUN tokens lie in one bucket,
by a 64-bit hash of these tokens; each bucket is sorted, and prefixes that different pages have go to the slices that
hold them. So the result is that of one array, and no task has more than a slice or a bucket.

Pages of one host with the same HTML are one page here: a copy isn't boilerplate, and each of its rows gets the same
text. Of HTML that a host has several times one page goes into the slices; the ids of all are joined to its text
afterwards, by a broadcast up to a counted size and a shuffle beyond. Hosts are compared in lower case without port and
user.

Nulls and cases: pages without a host in their URL, or without URL, share one host of their own, the empty string.
Null or empty HTML has an empty text and no tokens. Unclosed comments and scripts run to the end of the page; a "<"
that opens no tag is text. A page of fewer than RUN tokens is kept whole; one of any length is read whole, beyond a
slice's size alone in a task's memory. Repeated rows come out as often; ties don't occur. A page_id that is no whole
number is null. An empty table gives no rows. Columns other than page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import html as html_
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsieve.llm import common, textkit

RUN = 8
#: Bytes of HTML of one host in a slice, about; and suffixes in a bucket, about.
SLICE_BYTES, BUCKET_SUFFIXES = 16 << 20, 1 << 20
#: Bytes of HTML that are packed together at most, but for a single page.
PIECE = 4 << 20

_SKIPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"""<[a-zA-Z/!?](?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+>|<[a-zA-Z/!?][^<>]*+>""")
_INLINE = re.compile(r"</?(?:a|abbr|b|bdi|bdo|cite|code|em|font|i|kbd|mark|q|s|small|span|strong|sub|sup|u|wbr)\b[^<>]*+>", re.I)
_SPACE = np.zeros(256, bool)
_SPACE[[*b" \t\n\r\f\v"]] = True


def visible(page: str | None) -> str:
    """The text of a page: without scripts, styles, comments and tags; entities resolved; block tags end a line."""
    if not page:
        return ""
    text = _TAG.sub("\n", _INLINE.sub("", _SKIPPED.sub(" ", page)))
    return html_.unescape(text).replace("\xa0", " ") if "&" in text else text


def _tokens(texts: list[str]) -> tuple[np.ndarray, textkit.Words]:
    raw, off = textkit.buffer(pa.array([t.encode("utf-8", "replace") for t in texts], pa.large_binary()))
    words = textkit.Words(raw, off, ~_SPACE)
    return words.hashes(), words


def prefix_keys(tokens: np.ndarray, first: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a page has run more tokens, and hashes of these."""
    inside = np.ones(len(tokens), bool)
    for j in range(1, run):
        back = first[1:] - j
        inside[back[back >= first[:-1]]] = False
    at = np.flatnonzero(inside)
    key = np.zeros(len(at), np.uint64)
    for j in range(run):
        key += tokens[at + j] * np.uint64(pow(0xB5297A4D3F84D5B5, j + 1, 1 << 64) | 1)
    return at, textkit.mix(key)


def suffix_runs(tokens: np.ndarray, first: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the concatenated pages to a depth of run tokens: positions in order, and where runs of equal prefixes begin."""
    n, pages = len(tokens), len(first) - 1
    stream = np.empty(n + pages, np.int64)
    place = np.arange(n) + np.searchsorted(first[1:-1], np.arange(n), "right") if pages > 1 else np.arange(n)
    _, stream[place] = np.unique(tokens, return_inverse=True)
    top = int(stream[place].max()) + 1 if n else 0
    stream[first[1:] + np.arange(pages)] = top + np.arange(pages)  # ends differ from all else
    rank, k = stream, 1

    def doubled(shift: int) -> np.ndarray:
        after = np.zeros(len(rank), np.int64)
        after[: len(rank) - shift] = rank[shift:] + 1
        _, out = np.unique(rank * (int(rank.max()) + 2) + after, return_inverse=True)
        return out

    while 2 * k <= run:
        rank, k = doubled(k), 2 * k
    if k < run:
        rank = doubled(run - k)
    order = np.argsort(rank, kind="stable")
    return order, np.flatnonzero(np.concatenate([[True], np.diff(rank[order]) > 0]))


def covered(tokens: np.ndarray, first: np.ndarray, page: np.ndarray, run: int, known: np.ndarray | None = None) -> np.ndarray:
    """Which tokens lie in run tokens that another page has too; page: the identity of each text, known: keys told from outside."""
    n = len(tokens)
    starts = np.zeros(n + 1, np.int64)
    at, keys = prefix_keys(tokens, first, run)
    if len(at):
        order, lead = suffix_runs(tokens, first, run)
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first) + 1)
        mine = page[owner[order]]
        several = np.minimum.reduceat(mine, lead) != np.maximum.reduceat(mine, lead)
        hit = np.zeros(len(order), bool)
        hit[order[np.repeat(several, np.diff(np.append(lead, len(order))))]] = True
        begin = at + (np.searchsorted(first, at, "right") - 1)  # places in the stream with its ends
        found = hit[begin]
        if known is not None and len(known):
            i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            found |= known[i] == keys
        np.add.at(starts, at[found], 1)
        np.add.at(starts, at[found] + run, -1)
    return np.cumsum(starts)[:n] > 0


def kept_text(words: textkit.Words, out: np.ndarray, row: int) -> tuple[str, int, int]:
    """The unique runs of one page; its tokens, and those removed."""
    lo, hi = int(words.first[row]), int(words.first[row + 1])
    keep = ~out[lo:hi]
    if not keep.any():
        return "", hi - lo, hi - lo
    edge = np.diff(np.concatenate([[0], keep.view(np.int8), [0]]))
    runs = zip(np.flatnonzero(edge == 1) + lo, np.flatnonzero(edge == -1) + lo)
    lines = [words.raw[words.starts[a] : words.ends[b - 1]].tobytes().decode("utf-8", "replace") for a, b in runs]
    return "\n".join(" ".join(y.split()) for x in lines for y in x.split("\n") if y.strip()), hi - lo, hi - lo - int(keep.sum())


def _host() -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def _prepared(pages: DataFrame) -> DataFrame:
    """page_id, host, u (identity of the HTML), html."""
    return common.picked(pages, "page_id", "url", "html").select("page_id", _host().alias("host"), F.xxhash64("html").alias("u"), F.col("html").cast("string").alias("html"))


def packed_keys(keys: np.ndarray) -> bytes:
    """Distinct keys in order, as the byte planes of their differences: what many keys in order share takes no room."""
    steps = np.diff(keys.view(np.uint64), prepend=np.uint64(0))
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked_keys(z: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(z), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _by_slice(batch: pa.RecordBatch) -> Iterator[tuple[str, int, list[int]]]:
    """host, slice, rows of a batch whose first columns these are, in pieces of about PIECE bytes of the column html."""
    pages = batch.column(batch.schema.get_field_index("html"))
    size = np.asarray(pc.fill_null(pc.binary_length(pages), 0), np.int64)
    rows: dict[tuple[str, int], list[int]] = {}
    for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
        rows.setdefault(key, []).append(i)
    for (host, slice_), mine in rows.items():
        piece, n = [], 0
        for i in mine:
            if piece and n + size[i] > PIECE:
                yield host, slice_, piece
                piece, n = [], 0
            piece.append(i)
            n += size[i]
        yield host, slice_, piece


_KEYS = pa.schema([("host", pa.string()), ("bucket", pa.int64()), ("slice", pa.int64()), ("keys", pa.binary())])


def _bucketed(run: int):
    """host, slice, buckets, html -> the prefixes that a slice's pages have, by bucket."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = batch.column(2).to_pylist()
            for host, slice_, rows in _by_slice(batch):
                tokens, words = _tokens([visible(batch.column(3)[i].as_py()) for i in rows])
                keys = np.unique(prefix_keys(tokens, words.first, run)[1])
                of = keys % np.uint64(buckets[rows[0]])
                order = np.argsort(of, kind="stable")
                parts = np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else []
                out = [{"host": host, "bucket": int(of[p[0]]), "slice": slice_, "keys": packed_keys(keys[p])} for p in parts]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_KEYS)

    return go


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Runs of rows that are equal in their first two columns."""
    group: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if group and group[-1][:2] != row[:2]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of suffixes -> for each slice the prefixes that other slices have too. Equal pages are in one slice."""
    for group in _grouped(batches):
        keys = [unpacked_keys(r[3]) for r in group]
        every = np.concatenate(keys)
        slices = np.repeat([r[2] for r in group], [len(k) for k in keys])
        order = np.lexsort((slices, every))
        every, slices = every[order], slices[order]
        lead = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        several = np.repeat(slices[lead] != np.maximum.reduceat(slices, lead), np.diff(np.append(lead, len(every))))
        every, slices = every[several], slices[several]
        for s in np.unique(slices):
            yield pa.RecordBatch.from_pylist([{"host": group[0][0], "slice": int(s), "keys": packed_keys(np.unique(every[slices == s]))}], schema=pa.schema([_KEYS.field(0), _KEYS.field(2), _KEYS.field(3)]))


_PACKED = pa.schema([("host", pa.string()), ("slice", pa.int64()), ("u", pa.list_(pa.int64())), ("page_id", pa.list_(pa.int64())), ("many", pa.list_(pa.bool_())), ("size", pa.list_(pa.int64())), ("z", pa.binary())])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, slice, u, page_id, many, html -> the texts of a slice's pages, packed together."""
    for batch in batches:
        u, ids, many = (batch.column(j).to_pylist() for j in (2, 3, 4))
        out = []
        for host, slice_, rows in _by_slice(batch):
            texts = [visible(batch.column(5)[i].as_py()).encode("utf-8", "replace") for i in rows]
            out.append({"host": host, "slice": slice_, "u": [u[i] for i in rows], "page_id": [ids[i] for i in rows], "many": [many[i] for i in rows], "size": [len(t) for t in texts], "z": zstandard.compress(b"".join(texts), 3)})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_PACKED)


def _extracted(run: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches):
            known = [unpacked_keys(r[7]) for r in group if r[2] == 0]
            mine = [r for r in group if r[2] == 1]
            if not mine:
                continue
            host, u, ids, many = group[0][0], *([x for r in mine for x in r[j]] for j in (3, 4, 5))
            sizes = np.array([x for r in mine for x in r[6]], np.int64)
            raw = np.frombuffer(b"".join(zstandard.decompress(r[7]) for r in mine), np.uint8)
            group.clear()
            words = textkit.Words(raw, np.concatenate([[0], np.cumsum(sizes)]), ~_SPACE)
            out = covered(words.hashes(), words.first, np.array(u, np.int64), run, np.unique(np.concatenate(known)) if known else None)
            for lo in range(0, len(ids), 512):
                part = range(lo, min(len(ids), lo + 512))
                texts = [kept_text(words, out, i) for i in part]
                columns = [pa.array([ids[i] for i in part], pa.int64()), pa.array([host] * len(part)), pa.array([t[0] for t in texts], pa.string()), pa.array([t[1] for t in texts], pa.int64()), pa.array([t[2] for t in texts], pa.int64()), pa.array([u[i] if many[i] else None for i in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "host", "text", "n_tokens", "n_removed", "u"])

    return go


def extract(pages: DataFrame, run: int = RUN, slice_bytes: int = SLICE_BYTES, bucket_suffixes: int = BUCKET_SUFFIXES, limit: int = common.BROADCAST_BYTES) -> DataFrame:
    """page_id, host, text, n_tokens, n_removed: one row for each row of pages."""
    rows = _prepared(pages)
    # the HTML is read once for all that is counted
    about = common.cut(rows.select("host", "u", F.col("html").isNull().alias("cn"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("size")))
    sizes = about.groupBy("host").agg(F.sum("size").alias("b"))
    # a host has at most 1 byte a suffix, mostly six; there are at most total / slice_bytes such hosts
    big = common.cut(sizes.where(F.col("b") > slice_bytes).select(F.col("host").alias("big"), F.ceil(F.col("b") / slice_bytes).alias("slices"), F.greatest(F.lit(1), F.ceil(F.col("b") / 6 / bucket_suffixes)).alias("buckets")))
    # HTML that a host has several times: one page of it is worked on
    copies = about.groupBy(F.col("host").alias("ch"), F.col("u").alias("cu"), "cn").agg(F.count("*").alias("n")).where("n > 1")
    copies = common.cut(copies.select("ch", "cu", "cn"))
    same = (F.col("host") == F.col("ch")) & (F.col("u") == F.col("cu")) & (F.col("html").isNull() == F.col("cn"))
    several = not copies.isEmpty()
    once = rows.withColumn("many", F.lit(False))
    if several:
        told = common.by_size(copies, 64, limit)
        one = rows.join(told, same, "left_semi").groupBy("host", "u", F.col("html").isNull().alias("cn")).agg(F.first("html").alias("html"))
        once = rows.join(told, same, "left_anti").withColumn("many", F.lit(False))
        once = once.unionByName(one.select(F.lit(None).cast("long").alias("page_id"), "host", "u", "html", F.lit(True).alias("many")))
    placed = once.join(common.by_size(big, 128, limit), F.col("host") == F.col("big"), "left")
    slice_ = F.coalesce(F.pmod(F.col("u"), F.col("slices")), F.lit(0)).cast("long").alias("slice")
    keys = placed.where("slices is not null").select("host", slice_, "buckets", "html").mapInArrow(_bucketed(run), "host string, bucket long, slice long, keys binary")
    known = keys.repartition("host", "bucket").sortWithinPartitions("host", "bucket").mapInArrow(_shared, "host string, slice long, keys binary")
    none, no = F.array().cast("array<long>"), F.array().cast("array<boolean>")
    known = known.select("host", "slice", F.lit(0).alias("kind"), none.alias("u"), none.alias("page_id"), no.alias("many"), none.alias("size"), F.col("keys").alias("z"))
    packed = placed.select("host", slice_, "u", "page_id", "many", "html").mapInArrow(_packed, "host string, slice long, u array<long>, page_id array<long>, many array<boolean>, size array<long>, z binary")
    packed = packed.select("host", "slice", F.lit(1).alias("kind"), "u", "page_id", "many", "size", "z")
    together = packed.unionByName(known).repartition("host", "slice").sortWithinPartitions("host", "slice", "kind")
    out = together.mapInArrow(_extracted(run), "page_id long, host string, text string, n_tokens long, n_removed long, u long")
    if several:
        ids = common.cut(rows.join(told, same, "left_semi").select(F.col("host").alias("ih"), F.col("u").alias("iu"), F.col("page_id").alias("its"), F.lit(True).alias("told")))
        out = out.join(common.by_size(ids, 96, limit), (F.col("host") == F.col("ih")) & (F.col("u") == F.col("iu")), "left").withColumn("page_id", F.when(F.col("told"), F.col("its")).otherwise(F.col("page_id")))
    return out.select("page_id", "host", "text", "n_tokens", "n_removed")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.load(spark, sf_dir, "pages"))


def _sql() -> str:
    """The same by windows of RUN tokens. Of entities it knows those that the tables have."""
    inline = "a|abbr|b|bdi|bdo|cite|code|em|font|i|kbd|mark|q|s|small|span|strong|sub|sup|u|wbr"
    skipped = "(?is)<!--.*?(?:-->|\\z)|" + "|".join(rf"<{x}\b.*?(?:</{x}\s*>|\z)" for x in ("script", "style", "noscript", "template"))
    tag = """<[a-zA-Z/!?](?:[^<>"']+|"[^"<]*"|'[^'<]*')*>|<[a-zA-Z/!?][^<>]+>""".replace("'", "''")
    text = f"regexp_replace(html, '{skipped}', ' ', 'g')"
    text = f"regexp_replace(regexp_replace({text}, '(?i)</?(?:{inline})\\b[^<>]*>', '', 'g'), '{tag}', chr(10), 'g')"
    for entity, value in (("&quot;", '"'), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&lt;", "<"), ("&gt;", ">")):
        text = f"replace({text}, '{entity}', '{value}')"
    text = f"regexp_replace({text}, '&amp;?', '&', 'g')"
    window = ", ".join(f"lead(w, {j}) OVER o" if j else "w" for j in range(RUN))
    return f"""WITH p AS (SELECT row_number() OVER () AS rid, page_id, html, lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '')) AS host, {text} AS text FROM pages),
t AS (SELECT rid, host, html, regexp_extract_all(replace(text, chr(10), concat(' ', chr(1), ' ')), '[^ \\t\\n\\r\\f\\v]+') AS parts FROM p),
u AS (SELECT rid, host, html, unnest(parts) AS w, unnest(generate_series(1, len(parts))) AS n FROM t),
k AS (SELECT rid, host, html, w, nl, row_number() OVER (PARTITION BY rid ORDER BY n) AS i FROM (SELECT *, lag(w) OVER (PARTITION BY rid ORDER BY n) = chr(1) AS nl FROM u) WHERE w <> chr(1)),
x AS (SELECT * FROM (SELECT rid, host, html, i, [{window}] AS win, lead(w, {RUN - 1}) OVER o AS last FROM k WINDOW o AS (PARTITION BY rid ORDER BY i)) WHERE last IS NOT NULL),
r AS (SELECT rid, i FROM x JOIN (SELECT host, win FROM x GROUP BY host, win HAVING count(DISTINCT html) > 1) USING (host, win)),
c AS (SELECT DISTINCT rid, unnest(generate_series(i, i + {RUN - 1})) AS i FROM r),
kept AS (SELECT rid, i, w, nl, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM k ANTI JOIN c USING (rid, i)),
out AS (SELECT rid, string_agg(concat(CASE WHEN before IS NULL THEN '' WHEN before < i - 1 OR nl THEN chr(10) ELSE ' ' END, w), '' ORDER BY i) AS text FROM kept GROUP BY rid),
n AS (SELECT rid, count(*) AS n FROM k GROUP BY rid), m AS (SELECT rid, count(*) AS m FROM c GROUP BY rid)
SELECT page_id, host, coalesce(out.text, '') AS text, coalesce(n, 0) AS n_tokens, coalesce(m, 0) AS n_removed FROM p LEFT JOIN out USING (rid) LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)"""


OP3_SQL = _sql()
