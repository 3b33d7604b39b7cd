"""Operator 6: WARC files read by their index first.

write() lays pages out as WARC 1.1 response records, each a gzip member of its own, one file a task, and returns the
index as a table: file, offset, length, URL, record id and SHA-1 digest of the payload. Records are then chosen in the
index alone, and read_records() fetches just these: their ranges are put in order of (file, offset), ranges that lie
within GAP bytes of each other are read as one of up to SPAN bytes, and the members are unpacked from there. Each digest
is checked. index_files() makes the same index of files from elsewhere, by walking their gzip members or, in files that
aren't packed, their records.

Files and the index lie in the session's shared folder. A task writes under a name of its own and the index row comes
from the attempt that Spark took, so lost executors and repeated attempts leave unused files, never wrong rows.

Nulls and cases: a page without html is a record with an empty payload and comes back as an empty string, told apart by
the header WARC-Page-Null (null again). A null url is written as the empty string under WARC-URL-Null. Equal rows are
records of their own. A page_id that is no whole number is null. Very long pages are one record each, read in one piece
beyond SPAN. An empty table gives an index without rows and no files. Columns other than page_id, url and html aren't
written, whatever their names. Of several captures of one URL latest() takes the one with the greatest page_id, then
digest, file and offset (so ties have the same payload); each capture without a URL stands for itself.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsieve.llm import common

GAP, SPAN, LEVEL = 64 << 10, 8 << 20, 1
#: Bytes of records that a task reads, about; at least LEAST where there are more cores than that needs.
READ, LEAST = 64 << 20, 1 << 20
INDEX = "file string, offset long, length long, url string, record_id long, digest string"
_DATE = "2024-01-01T00:00:00Z"


def _open(path: str, mode: str):
    """A stream of a path on any file system that the shared folder may be on."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path)
    if mode == "w":
        system.create_dir(at.rpartition("/")[0], recursive=True)
        return system.open_output_stream(at, compression=None)
    return system.open_input_file(at)


def digest_of(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, html: str | None) -> tuple[bytes, str]:
    """One WARC record, packed, and its payload's digest."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    digest = digest_of(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    where = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", "WARC-Type: response", f"WARC-Target-URI: {where}", f"WARC-Date: {_DATE}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Payload-Digest: {digest}"]
    head += ["WARC-URL-Null: 1"] * (url is None) + ["WARC-Page-Null: 1"] * (html is None)
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n") + z.flush(), digest


def parse(raw: bytes) -> dict:
    """page_id, url, html and digest of one unpacked record (headers' names compare without case)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2] if "application/http" in fields.get("content-type", "") else block
    number = fields.get("warc-record-id", "").rstrip(">").rpartition(":")[2]
    return {
        "type": fields.get("warc-type"),
        "page_id": int(number) if number.lstrip("-").isdigit() else None,
        "url": None if "warc-url-null" in fields else fields.get("warc-target-uri"),
        "html": None if "warc-page-null" in fields else payload.decode("utf-8", "replace"),
        "digest": digest_of(payload),
        "said": fields.get("warc-payload-digest"),
    }


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            rows = []
            for page_id, url, html in zip(*(batch.column(j).to_pylist() for j in range(3))):
                packed, digest = record(page_id, url, html)
                out = out or _open(path, "w")
                out.write(packed)
                rows.append((path, at, len(packed), url, page_id, digest))
                at += len(packed)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()))], names=[x.split()[0] for x in INDEX.split(", ")])
        if out:
            out.close()

    return run


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages as WARC files into folder/data and their index as a table into folder/index; the index, read again."""
    rows = common.picked(pages, "page_id", "url", "html").select("page_id", F.col("url").cast("string").alias("url"), "html")
    rows.mapInArrow(_writer(f"{folder}/data"), INDEX).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of the gzip members of a stream."""
    at, fed, z, parts, rest = 0, 0, zlib.decompressobj(31), [], b""
    while chunk := rest or stream.read(1 << 20):
        parts.append(z.decompress(chunk))
        rest = z.unused_data
        fed += len(chunk) - len(rest)
        if z.eof:
            yield at, fed - at, b"".join(parts)
            at, z, parts = fed, zlib.decompressobj(31), []
    if fed > at:
        raise ValueError(f"the member at {at} is cut short")


def records(stream) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of the records of a stream that isn't packed."""
    at, held = 0, b""
    while True:
        while b"\r\n\r\n" not in held and (more := stream.read(1 << 20)):
            held += more
        head, found, _ = held.partition(b"\r\n\r\n")
        if not found:
            if held.strip():
                raise ValueError(f"the record at {at} is cut short")
            return
        size = next((int(v) for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")) if k.strip().lower() == b"content-length"), 0)
        n = len(head) + 4 + size + 4
        parts, have = [held], len(held)
        while have < n and (more := stream.read(max(1 << 20, n - have))):
            parts.append(more)
            have += len(more)
        held = b"".join(parts)
        if have < n - 4:
            raise ValueError(f"the record at {at} is cut short")
        yield at, min(n, have), held[:n]
        at, held = at + n, held[n:]


def _unpacked(data: bytes) -> bytes:
    return zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows = []
            with _open(path, "r") as f:
                packed = f.read(2) == b"\x1f\x8b"
                f.seek(0)
                for at, n, raw in (members if packed else records)(f):
                    r = parse(raw)
                    if r["type"] == "response":
                        rows.append((path, at, n, r["url"], r["page_id"], r["digest"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()))], names=[x.split()[0] for x in INDEX.split(", ")])


def index_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The index of WARC files, packed or not; a task a file. Other records than responses are passed over."""
    files = spark.createDataFrame([(p,) for p in paths], "file string").repartition(max(1, len(paths)))
    return files.mapInArrow(_index, INDEX)


def latest(index: DataFrame) -> DataFrame:
    """Of each URL the index row of the last capture."""
    # nothing but the index is looked at; grouped maxima are combined before the shuffle, whatever one URL's captures are
    own = F.when(F.col("url").isNull(), F.concat_ws(":", "file", F.col("offset").cast("string")))
    last = F.max(F.struct("record_id", "digest", "file", "offset", "length")).alias("x")
    return index.groupBy("url", own.alias("own")).agg(last).select("x.file", "x.offset", "x.length", "url", "x.record_id", "x.digest")


def spans(rows: list[tuple[int, int]], gap: int = GAP, span: int = SPAN) -> list[tuple[int, int, int]]:
    """(offset, length) in order -> (first row, offset, length) of reads that cover them."""
    out: list[list[int]] = []
    for i, (at, n) in enumerate(rows):
        if out and at - (out[-1][1] + out[-1][2]) <= gap and max(at + n, out[-1][1] + out[-1][2]) - out[-1][1] <= span:
            out[-1][2] = max(out[-1][2], at + n - out[-1][1])
        else:
            out.append([i, at, n])
    return [tuple(x) for x in out]


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, f = None, None
    for batch in batches:
        files, at, length, said = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file", "offset", "length", "digest"))
        begin = 0
        while begin < len(files):  # runs of one file
            end = begin
            while end < len(files) and files[end] == files[begin]:
                end += 1
            if files[begin] != path:
                if f:
                    f.close()
                path, f = files[begin], _open(files[begin], "r")
            reads = spans([(at[i], length[i]) for i in range(begin, end)])
            for (first, lo, n), (after, _, _) in zip(reads, [*reads[1:], (end - begin, 0, 0)]):
                data = f.read_at(n, lo)
                rows = []
                for i in range(begin + first, begin + after):
                    r = parse(_unpacked(data[at[i] - lo : at[i] - lo + length[i]]))
                    if r["digest"] != said[i]:
                        raise ValueError(f"{path} at {at[i]}: the digest differs from the index")
                    rows.append((r["page_id"], r["url"], r["html"], r["digest"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.string()))], names=["page_id", "url", "html", "digest"])
            begin = end
    if f:
        f.close()


def read_records(chosen: DataFrame) -> DataFrame:
    """page_id, url, html, digest of the records that the index rows name."""
    chosen = common.cut(chosen.select("file", "offset", "length", "digest"))
    total = chosen.agg(F.sum("length")).first()[0] or 0
    parts = max(1, -(-total // READ), min(chosen.sparkSession.sparkContext.defaultParallelism, -(-total // LEAST)))
    ordered = chosen.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(_reader, "page_id long, url string, html string, digest string")


def op6_warc_index_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages, picks the latest capture of each URL by the index, reads those."""
    index = write(common.load(spark, sf_dir, "pages"), common.fresh_dir(spark, "warc"))
    rows = read_records(latest(index))
    return rows.select("page_id", "url", F.sha2(F.encode("html", "UTF-8"), 256).alias("html_sha256"), F.octet_length("html").cast("long").alias("n_bytes"))


OP6_SQL = """SELECT page_id, url, sha256(html) AS html_sha256, CAST(strlen(html) AS BIGINT) AS n_bytes
FROM pages QUALIFY row_number() OVER (PARTITION BY url, CASE WHEN url IS NULL THEN page_id END ORDER BY page_id DESC) = 1"""
