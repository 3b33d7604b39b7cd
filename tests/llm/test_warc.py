import gzip

import pytest

from tarnsieve.llm import warc as w
from tests.llm.cases import odd_columns, same_rows

ROWS = [(1, "http://a/", "<p>x</p>"), (1, "http://a/", "<p>x</p>"), (2, "http://a/", "é\r\n\r\nb"), (3, None, "q"), (None, "http://b/\n", None), (4, "http://c/", ""), (5, "http://d/", "z" * 300_000), (6, "http://e/", "x" * 50)]
SCHEMA = "page_id long, url string, html string, digest string, offset long"


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "zz", 7) for r in rows], SCHEMA)


def test_round_trip(spark, tmp_path):
    index = w.write(pages(spark), f"file://{tmp_path}/w")
    got = sorted((tuple(r)[:3] for r in w.read_records(index).collect()), key=repr)
    fixed = [(i, u.replace("\n", "%0A") if u else u, h) for i, u, h in ROWS]
    assert got == sorted(fixed, key=repr)


def test_any_reader_can_read_the_files(spark, tmp_path):
    index = w.write(pages(spark), f"file://{tmp_path}/w")
    files = [r.file for r in index.select("file").distinct().collect()]
    text = b"".join(gzip.open(f.removeprefix("file://")).read() for f in files)
    assert text.count(b"WARC/1.1\r\n") == len(ROWS) and text.count(b"WARC-Type: response") == len(ROWS)
    cols = ["file", "offset", "length", "url", "record_id", "digest"]
    assert same_rows(w.index_files(spark, files).select(*cols), index.select(*cols).withColumn("url", w.F.regexp_replace("url", "\n", "%0A")))


def test_latest_and_selection(spark, tmp_path):
    index = w.write(pages(spark), f"file://{tmp_path}/w")
    last = w.latest(index)
    assert sorted((r.url or "", r.record_id) for r in last.collect() if r.record_id) == [("", 3), ("http://a/", 2), ("http://c/", 4), ("http://d/", 5), ("http://e/", 6)]
    one = w.read_records(index.where("record_id = 6"))
    assert [r.html for r in one.collect()] == ["x" * 50]
    # nothing but the index is looked at to choose
    assert "Python" not in last._jdf.queryExecution().toString()


def test_damage_is_told(spark, tmp_path):
    index = w.write(pages(spark), f"file://{tmp_path}/w")
    with pytest.raises(Exception, match="digest"):
        w.read_records(index.withColumn("digest", w.F.lit("sha1:X"))).collect()


def test_spans():
    assert w.spans([(0, 10), (10, 5), (100, 5)], gap=20, span=1000) == [(0, 0, 15), (2, 100, 5)]
    assert w.spans([(0, 10), (10, 5), (100, 5)], gap=100, span=1000) == [(0, 0, 105)]
    assert w.spans([(0, 10), (10, 50)], gap=100, span=20) == [(0, 0, 10), (1, 10, 50)]
    assert w.spans([]) == []


def test_empty(spark, tmp_path):
    index = w.write(pages(spark, []), f"file://{tmp_path}/w")
    assert index.count() == 0 and w.read_records(w.latest(index)).count() == 0


def test_pages_without_a_url_stand_for_themselves(spark, tmp_path):
    index = w.write(pages(spark, [(1, None, "a"), (2, None, "b"), (None, None, None), (3, "http://a/", "c")]), f"file://{tmp_path}/w")
    assert sorted(str(r.html) for r in w.read_records(w.latest(index)).collect()) == ["None", "a", "b", "c"]


def test_files_that_are_not_packed(spark, tmp_path):
    index = w.write(pages(spark), f"file://{tmp_path}/w")
    files = [r.file for r in index.select("file").distinct().collect()]
    for i, f in enumerate(files):
        (tmp_path / f"{i}.warc").write_bytes(gzip.open(f.removeprefix("file://")).read())
    plain = w.index_files(spark, [f"file://{tmp_path}/{i}.warc" for i in range(len(files))])
    assert same_rows(plain.select("record_id", "digest"), index.select("record_id", "digest"))
    assert same_rows(w.read_records(plain).select("html"), w.read_records(index).select("html"))
    (tmp_path / "cut.warc").write_bytes((tmp_path / "0.warc").read_bytes()[:-40])
    with pytest.raises(Exception, match="cut short"):
        w.index_files(spark, [f"file://{tmp_path}/cut.warc"]).collect()


def test_reads_are_spread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(w, "LEAST", 10)
    index = w.write(spark.range(500).selectExpr("id as page_id", "concat('http://x/', id) as url", "repeat(uuid(), 9) as html"), f"file://{tmp_path}/w")
    assert w.read_records(w.latest(index)).rdd.getNumPartitions() >= 4


def test_any_columns(spark, tmp_path):
    d = odd_columns(spark, [(1, "x")]).withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumnRenamed("source", "url")
    assert [tuple(r)[:3] for r in w.read_records(w.write(d, f"file://{tmp_path}/w")).collect()] == [(1, "s", "x")]
