import random
from collections import defaultdict

import pytest

from tarnsieve.llm import host_suffixes as h
from tests.llm.cases import odd_columns, same_rows

PAGES = "page_id long, url string, html string, host string, slice long, u long"


def brute(pages, run):
    """(page_id, url, html) -> rows of extract(), by sets of windows."""
    host = lambda url: (url or "").split("://")[-1].split("/")[0].split("@")[-1].split(":")[0].lower() if url and "://" in url else ""
    held = defaultdict(set)
    for _, url, html in pages:
        t = h.visible(html).split()
        for i in range(len(t) - run + 1):
            held[host(url), tuple(t[i : i + run])].add(html)
    out = []
    for page_id, url, html in pages:
        t = h.visible(html).split()
        gone = set()
        for i in range(len(t) - run + 1):
            if len(held[host(url), tuple(t[i : i + run])]) > 1:
                gone |= set(range(i, i + run))
        out.append((page_id, host(url), [w for i, w in enumerate(t) if i not in gone], len(t), len(gone)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.page_id, r.host, r.text.split(), r.n_tokens, r.n_removed) for r in df.collect()), key=repr)


def pages(seed, n=60):
    r = random.Random(seed)
    boiler = [" ".join(r.choice("abcdefghij") * 2 for _ in range(9)) for _ in range(3)]
    out = []
    for i in range(n):
        body = " ".join(r.choice("klmnopqrstuvw") + str(r.randint(0, 9)) for _ in range(r.randint(0, 40)))
        out.append((i, f"https://{r.choice(['A.example', 'b.example:80', 'me@c.example'])}/{i}", f"<html><nav>{r.choice(boiler)}</nav><p>{body}</p><footer>{r.choice(boiler)}</footer></html>"))
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("slice_bytes, bucket, limit", [(1 << 30, 1 << 20, 1 << 20), (700, 20, 1 << 20), (700, 20, 0)])
def test_against_brute_force(spark, seed, slice_bytes, bucket, limit):
    rows = pages(seed)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert got(h.extract(df, 6, slice_bytes, bucket, limit)) == brute(rows, 6)


def test_weird_rows(spark):
    same = "<p>" + " ".join(f"w{i}" for i in range(30)) + "</p>"
    long = "<p>" + " ".join(f"x{i}" for i in range(50_000)) + "</p>"
    rows = [(None, None, None), (1, None, same), (2, "http://a/", same), (2, "http://a/", same), (3, "http://a/x", same), (4, "http://a/", ""), (5, "http://a/", long), (6, "http://b/", "<!-- open"), (7, "no url", "a < b &amp; c <script>x"), (8, "http://A:1/", "<p>" + " ".join(f"w{i}" for i in range(5, 20)) + " tail</p>")]
    df = spark.createDataFrame([(*r, "zz", 1, 2) for r in rows], PAGES)
    assert got(h.extract(df)) == brute(rows, h.RUN)
    text = {r.page_id: r for r in h.extract(df).collect()}
    assert text[7].text == "a < b & c" and text[6].text == "" and text[5].n_removed == 0
    # copies are one page, so only what page 8 shares with them goes
    assert text[8].text == "tail" and text[2].n_removed == text[3].n_removed == 15
    assert same_rows(h.extract(df), h.extract(df, slice_bytes=300, bucket_suffixes=10))
    assert h.extract(df.limit(0)).count() == 0


def test_markup():
    assert h.visible('<p title="a>b">x</p><b>y</b>z<style>q</style>&lt;i&gt;').split() == ["x", "yz", "<i>"]
    assert h.visible("<" * 1000 + "a" * 10).endswith("a" * 10)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_copies_of_a_page(spark, limit):
    """100,000 copies of one page are one page in one slice, and each keeps its id."""
    error = "<p>" + " ".join(f"e{i}" for i in range(2_000)) + "</p>"
    d = spark.range(100_000).selectExpr("id as page_id", "'http://hot/x' as url", f"'{error}' as html").union(spark.createDataFrame([(-1, "http://hot/y", "<p>" + " ".join(f"e{i}" for i in range(9)) + " own</p>"), (-2, "http://hot/z", None), (-3, "http://hot/z", ""), (None, "http://hot/z", None)], "page_id long, url string, html string"))
    out = h.extract(d, limit=limit)
    rows = {r.page_id: r for r in out.where("page_id < 5 or page_id is null").collect()}
    assert out.count() == 100_004 and out.select("page_id").distinct().count() == 100_004
    assert rows[-1].text == "own" and rows[3].n_removed == 9 and rows[-2].text == "" and set(rows) == {None, -3, -2, -1, 0, 1, 2, 3, 4}


def test_any_columns(spark):
    d = odd_columns(spark, [(1, "<p>x y</p>"), (2, "<p>x y</p>"), (None, None)]).withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumnRenamed("source", "url")
    assert sorted((r.text for r in h.extract(d).collect())) == ["", "x y", "x y"]
