import random

import numpy as np
import pyarrow as pa

from tarnsieve.llm import decontaminate as x
from tests.llm.cases import LONG, docs, empty, odd_columns, prose, same_rows, weird

ITEMS = "item_id long, text string, k string, h long"


def items(spark, texts):
    return spark.createDataFrame([(i, t, "zz", 1) for i, t in enumerate(texts)], ITEMS)


def tokens_of(text):
    token, kind, value, _ = x.tokens(pa.array([text], pa.large_string()))
    return list(zip(token.tolist(), kind.tolist(), value.tolist()))


def brute(docs_, bench, coverage=x.COVERAGE):
    """(document, item) -> (windows, of_windows, reworded), by dictionaries of whole windows."""

    def windows(t, n):
        out = []
        for i in range(len(t) - n + 1):
            part = t[i : i + n]
            if sum(k == 1 for _, k, _ in part) >= min(x.LITERALS, n):
                out.append((i, tuple(a for a, _, _ in part), [v for _, k, v in part if k > 1]))
        return out

    found = {}
    for j, item in enumerate(bench):
        t = tokens_of(item or "")
        n = min(x.WINDOW, len(t))
        mine = windows(t, n) if n else []
        if not mine:
            continue
        for i, d in enumerate(docs_):
            rows = [(a, b, v, w) for b, key, w in windows(tokens_of(d or ""), n) for a, k, v in mine if k == key]
            if rows and len(rows) >= coverage * len(mine):
                good, differs = x.consistent(rows)
                if good >= coverage * len(mine):
                    found[i, j] = (good, len(mine), differs)
    return found


QUESTION = "A farmer has 12 hens and sells them to Mary for 30 dollars at the market near the old bridge before noon, how much is left"


def test_against_brute_force(spark):
    r = random.Random(4)
    bench = [prose(i, 25) for i in range(8)] + [QUESTION, "two three", "", prose(80, 6)]
    texts = [prose(100 + i, 60) for i in range(20)]
    texts += [f"{prose(200 + i, 20)} {bench[i % 8]} {prose(300 + i, 20)}" for i in range(12)]
    texts += [" ".join(w for w in bench[i].split() if r.random() > 0.1) for i in range(8)] + [prose(1, 5) + " " + bench[11], QUESTION.replace("12", "47").replace("Mary", "Peter"), "", "12 13 14"]
    got = {(r.doc_id, r.item_id): (r.windows, r.of_windows, r.reworded) for r in x.contaminated(docs(spark, texts), items(spark, bench)).collect()}
    assert got == brute(texts, bench) and len(got) > 12


def test_filter_and_shuffle_agree(spark):
    bench = [prose(i, 25) for i in range(8)]
    d = docs(spark, [f"{prose(50 + i)} {bench[i % 8]}" for i in range(16)] + [prose(90)])
    assert same_rows(x.contaminated(d, items(spark, bench)), x.contaminated(d, items(spark, bench), filter_bytes=0))


def test_reworded_questions(spark):
    same = QUESTION
    other = QUESTION.replace("12", "7,500").replace("Mary", "Aunt Josephine").replace("30 dollars", "9 euros")
    twisted = "The farmer and Mary went to the market, and 12 hens of the old bridge were sold before noon for 30 dollars"
    rows = {r.doc_id: r for r in x.contaminated(docs(spark, [same, "Before. " + other, twisted, prose(5, 200)]), items(spark, [QUESTION])).collect()}
    assert set(rows) == {0, 1} and not rows[0].reworded and rows[1].reworded


def test_slots_have_to_agree():
    # one value of the item stands for two of the document: only the more frequent counts
    windows = [(0, 0, [5], [9]), (1, 1, [5], [9]), (2, 2, [5], [8])]
    assert x.consistent(windows) == (2, True)
    assert x.consistent([(0, 0, [5], [5])]) == (1, False)


def test_canonical_tokens():
    kinds = [k for _, k, _ in tokens_of("It cost 1,250.50 kg for Mary Ann Smith. The end came")]
    assert kinds == [1, 1, 2, 4, 1, 3, 1, 1, 1]
    a, b = tokens_of("It weighs 5 kg."), tokens_of("it weighs 99 miles")
    assert [t for t, _, _ in a] == [t for t, _, _ in b]


def test_weird_rows(spark):
    d = weird(spark)
    bench = spark.createDataFrame([(None, None, "a", 1), (None, prose(2), "a", 1), (1, "", "a", 1), (1, prose(2), "a", 1), (1, prose(2), "a", 1), (2, "x", "a", 1), (3, LONG[:400], "a", 1)], ITEMS)
    rows = x.contaminated(d, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(6, None), (6, 1), (7, None), (7, 1), (5, 2)}
    assert len(rows) == 5
    left = x.decontaminate(d, bench)
    assert left.columns == d.columns and sorted((r.doc_id or 0) for r in left.collect()) == [0, 0, 1, 2, 3, 4, 7, 8, 9]
    assert x.contaminated(empty(spark), bench).count() == 0 and x.contaminated(d, bench.limit(0)).count() == 0
    assert same_rows(x.decontaminate(d, bench.limit(0)), d)


def test_clean_documents_stay(spark):
    bench = [prose(i, 40) for i in range(50)]
    d = docs(spark, [prose(1000 + i, 200) for i in range(200)])
    assert x.decontaminate(d, items(spark, bench)).count() == 200
    assert np.isclose(x.COVERAGE, 0.3)


def test_copies_in_other_case(spark):
    plain = [prose(i, 30) for i in range(2)] + [QUESTION]
    texts = [f"{prose(50 + i, 10)} {f(b)} {prose(70 + i, 10)}" for i, b in enumerate(plain) for f in (str.upper, str.title, str.lower)]
    texts += [QUESTION.replace("12", "47").upper(), prose(90, 100).upper()]
    got = {(r.doc_id, r.item_id) for r in x.contaminated(docs(spark, texts), items(spark, plain)).collect()}
    assert got == {(i, i // 3) for i in range(9)} | {(9, 2)}
    assert got == {(r.doc_id, r.item_id) for r in x.contaminated(docs(spark, texts), items(spark, [p.upper() for p in plain])).collect()}
    assert x.decontaminate(docs(spark, texts), items(spark, plain)).count() == 1


def test_items_of_few_words(spark, tmp_path):
    import corpus_pipeline

    sums = "2 + 3 = 5, 4 + 5 = 9, 6 + 1 = 7, 8 + 8 = 16, 3 + 4 = 7"
    long = "Tom has 3 cats and 4 dogs, Ann has 5 hens and 6 ducks, Sue has 7 pigs and 8 cows"
    bench = ["What is 12 plus 7?", "What is 12 times 12?", "812", sums, "Is Mary older than Ann?", LONG[:400], long, "?!"]
    texts = [f"{prose(50 + i, 10)}. {b} {prose(70 + i, 10)}" for i, b in enumerate(bench)]
    texts += [f"{prose(50 + i, 10)}. {b.upper()} {prose(70 + i, 10)}" for i, b in enumerate(bench)]
    texts += ["So: what is 30 plus 9?", "so: what is 30 minus 9?", "so: what is 30 times 9?", "So. Is Peter older than Lucy?", "So. " + long.replace("3", "9").replace("Sue", "Eve"), "So. " + long.split(", Sue")[0].replace("3", "9"), "1 + 3 = 4, 4 + 4 = 8"]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    items(spark, bench).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.reworded for r in x.op10_benchmark_decontamination(spark, str(tmp_path)).collect()}
    assert got == {(i + n, i): False for i in range(7) for n in (0, 8)} | {(16, 0): True, (19, 4): True, (20, 6): True, (21, 6): True}
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.decontamination(spark, d, str(tmp_path)).collect()) == [7, 15, 17, 18, 22]
    assert same_rows(x.contaminated(d, items(spark, bench), thin=True), x.contaminated(d, items(spark, bench), filter_bytes=0, thin=True))


def test_thin_templates_have_to_be_in_one_copy():
    found = [(0, 5, [1], [2]), (1, 6, [1], [2]), (2, 40, [1], [1])]
    assert x.consistent(found) == (3, True) and x.in_one_copy(found) == (2, True)


def test_a_long_run_suffices(spark):
    item = prose(3, 500)
    words = item.split()
    texts = [f"{prose(50, 20)} {' '.join(words[100 : 100 + n])} {prose(51, 20)}" for n in (100, x.LONG, x.LONG - 1)]
    scattered = " ".join(" ".join([*words[i : i + 9], *prose(60 + i, 9).split()]) for i in range(0, 400, 20))
    got = {(r.doc_id, r.windows) for r in x.contaminated(docs(spark, [*texts, scattered]), items(spark, [item])).collect()}
    assert got == {(0, 93), (1, x.LONG - x.WINDOW + 1)}
    assert x.longest_run([(0, 5, [], []), (1, 6, [], []), (2, 40, [], []), (4, 9, [], [])]) == 2


def test_names_in_other_scripts():
    assert [k for _, k, _ in tokens_of("the Ökonom met Иван and Ωμέγα at Žižkov with жена")] == [1, 3, 1, 3, 1, 3, 1, 3, 1, 1]


def test_any_columns(spark):
    d = odd_columns(spark, [(1, prose(1) + " " + prose(2)), (2, prose(5))])
    bench = odd_columns(spark, [(7, prose(2))]).withColumnRenamed("doc_id", "item_id")
    left = x.decontaminate(d, bench)
    assert left.columns == d.columns and [r[0] for r in left.collect()] == [2]
