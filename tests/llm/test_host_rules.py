import duckdb
import pytest

from tarnsieve.llm import host_rules as h
from tests.llm.cases import empty, odd_columns, prose, same_rows, weird
from tests.oracle import rows


def held(df, docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    cur = con.execute(h.OP9_SQL)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in cur.description], cur.fetchall())


def test_weird_rows(spark):
    d = weird(spark)
    out = h.judge(d)
    assert out.count() == d.count()
    held(out, d)
    assert h.judge(empty(spark)).count() == 0


def test_shrinking(spark):
    bad = "###$$$ %%% ^^^ " * 20
    texts = [("clean", prose(i)) for i in range(40)] + [("junk", bad if i % 10 else prose(i)) for i in range(40)] + [("tiny", bad)] + [(f"c{i}", prose(i + 100)) for i in range(30)]
    d = spark.createDataFrame([(i, t, "en", s, 0) for i, (s, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.source: r for r in h.judge(d).collect()}
    assert out["clean"].keep and not out["junk"].keep and out["c1"].keep
    # one bad document doesn't weigh like forty
    assert out["tiny"].rate < out["junk"].rate
    held(h.judge(d), d)


@pytest.mark.parametrize("text, rule", [("a b", "few-words"), ("### $$$ a b c d", "many-symbols"), ("AAA BBB CCC DDD EEE", "shouting"), ("wow! wow! wow! wow! wow!", "many-exclamations"), ("a" * 200 + " b c d e", "long-words"), ("a b c d e f g", "short-words"), ("one two three four five\n" * 9, "repeated-lines")])
def test_rules(spark, text, rule):
    d = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    assert rule in h.judge(d).first().failed.split(",")
    assert h.judge(d.withColumn("text", h.F.lit(prose(3)))).first().failed == ""


def test_partitions_don_t_matter(spark):
    d = weird(spark)
    assert same_rows(h.judge(d), h.judge(d.repartition(6)))


def test_any_columns(spark):
    d = odd_columns(spark, [(1, prose(1)), (2, None), (None, prose(2) * 50)])
    assert sorted(r.failed for r in h.judge(d).collect()) == ["", "", "few-words"]


def test_ids_that_are_no_numbers(spark):
    d = spark.createDataFrame([("x", prose(1), "s"), ("12", prose(2), "s")], "doc_id string, text string, source string")
    assert sorted(str(r.doc_id) for r in h.judge(d).collect()) == ["12", "None"]
