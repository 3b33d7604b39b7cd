import corpus_pipeline as p
import pytest

from tarnsieve.llm import common, decontaminate, minhash, mixing, quality_cnn
from tarnsieve.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.cases import SCHEMA, empty, odd_columns, prose, same_rows, weird
from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_minhash import brute_components, jaccard
from tests.llm.test_mixing import brute as brute_mix
from tests.llm.test_quality_cnn import brute as loops
from tests.oracle import DATA, same


@pytest.mark.parametrize("name", [*ORACLE_SQL])
def test_queries_against_sql(spark, name):
    same(QUERIES[name](spark, DATA), ORACLE_SQL[name])


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL and n != "pipeline"])
def test_other_queries_cover_their_tables(spark, name):
    rows = QUERIES[name](spark, DATA).collect()
    docs = common.load(spark, DATA, "documents").count()
    if name in ("op1_quality_classifier", "op5_language_id", "op8_sharding"):
        assert len(rows) == docs
    elif name == "op3_html_extraction":
        assert len(rows) == common.load(spark, DATA, "pages").count()
    else:
        assert rows


def test_names():
    assert [int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline"] == list(range(1, 11))
    assert [n for n, _ in p.STAGES] == ["quality classifier", "near duplicates", "benchmark decontamination", "mixing sources", "sharding"]


def test_stages(spark):
    """Each stage alone against what its operator says of its own input."""
    docs = common.load(spark, DATA, "documents")
    out = {}
    for name, stage in p.STAGES:
        after = common.cut(stage(spark, docs, DATA))
        out[name] = (docs, after)
        docs = after
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    before, after = out["quality classifier"]
    verdicts = quality_cnn.scores(before, quality_cnn.train(before, common.load(spark, DATA, "labels"))).collect()
    assert ids(after) == sorted(r.doc_id for r in verdicts if r.keep) and after.columns == before.columns
    before, after = out["near duplicates"]
    gone = [r.doc_id for r in minhash.near_duplicates(before).collect() if r.doc_id != r.class_id]
    assert sorted([*ids(after), *gone]) == ids(before)
    before, after = out["benchmark decontamination"]
    leaks = {r.doc_id for r in decontaminate.contaminated(before, common.load(spark, DATA, "benchmark")).collect()}
    assert ids(after) == [i for i in ids(before) if i not in leaks]
    before, after = out["mixing sources"]
    assert ids(after) == sorted(r.doc_id for r in mixing.chosen_units(before).collect())
    before, after = out["sharding"]
    assert after.columns == [*before.columns, "shard_id"] and same_rows(after.drop("shard_id"), before)
    assert ids(p.run(spark, DATA)) == ids(after)


def test_clean_labelled_documents_stay(spark):
    labels = common.load(spark, DATA, "labels")
    docs = common.load(spark, DATA, "documents")
    kept = {r.doc_id for r in p.quality(spark, docs, DATA).collect()}
    there = {r.doc_id for r in docs.select("doc_id").collect()}
    good = [r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect() if r.doc_id in there]
    bad = [r.doc_id for r in labels.where("quality = 0 or toxic = 1").collect() if r.doc_id in there]
    assert sum(i in kept for i in good) >= 0.95 * len(good)
    assert sum(i in kept for i in bad) <= 0.5 * len(bad)


def test_weird_rows_go_through(spark, tmp_path):
    import shutil

    for t in ("benchmark", "labels"):
        shutil.copy(f"{DATA}/{t}.parquet", tmp_path)
    for docs in (weird(spark), empty(spark)):
        for _, stage in p.STAGES:
            docs = common.cut(stage(spark, docs, str(tmp_path)))
        assert docs.columns[-1].startswith("shard_id")


def test_shared_folder(spark):
    assert common.shared_dir(spark).startswith("file://")
    assert common.fresh_dir(spark, "x") != common.fresh_dir(spark, "x")


def test_odd_columns_go_through(spark, tmp_path):
    import shutil

    for t in ("benchmark", "labels"):
        shutil.copy(f"{DATA}/{t}.parquet", tmp_path)
    docs = odd_columns(spark, [(i, prose(i)) for i in range(6)] + [(5, prose(5)), (None, None), (None, "")])
    columns = docs.columns
    for _, stage in p.STAGES:
        docs = common.cut(stage(spark, docs, str(tmp_path)))
    assert docs.columns == [*columns, "shard_id"]


def test_pipeline_against_brute_force(spark, tmp_path):
    """run() on a small corpus against plain Python: loops over windows, all pairs, dictionaries of windows, one flight a source."""
    bench = [prose(900 + i, 25) for i in range(4)]
    good = [prose(i, 40 + i % 30) for i in range(90)]
    bad = [" ".join(w.upper() + "!!!" for w in prose(500 + i, 50).split()) for i in range(60)]
    texts = good + bad + [good[i] for i in range(12)] + [good[20 + i] + " " + prose(700 + i, 2) for i in range(8)]
    texts += [f"{prose(800 + i, 20)} {bench[i % 4]} {prose(850 + i, 20)}" for i in range(9)] + [prose(60, 40).replace(" ", "\n")]
    rows = [(i, t, "en", ["a", "b", "c"][(i % 7 > 2) + (i % 7 > 5)], len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 90), 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(i, b) for i, b in enumerate(bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = common.load(spark, str(tmp_path), "documents")
    net = quality_cnn.train(docs, common.load(spark, str(tmp_path), "labels"))
    left = [r for r in rows if loops(net, r[1].encode()) >= net.threshold]
    pairs = [(i, j) for i in range(len(left)) for j in range(i) if jaccard(left[i][1], left[j][1]) >= minhash.THRESHOLD]
    left = [r for r, root in zip(left, brute_components(len(left), pairs)) if left[root] is r]
    found = brute_leaks([r[1] for r in left], bench)
    left = [r for i, r in enumerate(left) if i not in {d for d, _ in found}]
    assert 60 < len(left) < 120 and len(found) == 9
    frame = spark.createDataFrame(left, SCHEMA)
    chosen = brute_mix([(r.u, r.s, r.tokens) for r in mixing._units(frame).collect()], None, mixing.SEED, mixing.CHUNK)
    kept = {r.doc_id for r in mixing._units(frame).collect() if r.u in chosen}
    out = p.run(spark, str(tmp_path)).collect()
    assert sorted(tuple(r)[:5] for r in out) == sorted(r for r in left if r[0] in kept)
    assert {r.shard_id for r in out} == {0}  # far below the target


def test_ids_of_any_type(spark):
    """Whole numbers in any numeric type or string are ids; all else is null."""
    ids = {"cast(7 as int)": 7, "cast(7 as decimal(38,0))": 7, "cast(7.5 as double)": None, "7.0D": 7, "'7'": 7, "' x'": None, "cast('NaN' as double)": None, "1e30D": None, "date'2024-01-01'": None, "array(1)": None, "cast(null as string)": None, "x'07'": None}
    for value, want in ids.items():
        d = spark.sql(f"select {value} as doc_id, 'one two three' as text, 's' as source")
        assert [r.doc_id for r in common.picked(d, "doc_id").collect()] == [want], value
    d = spark.sql("select 7.5D as doc_id, 'one two three' as text, 's' as source, 'en' as lang")
    assert minhash.deduplicate(d).count() == mixing.mix(d).count() == quality_cnn.filter_documents(d, None).count() == 1
