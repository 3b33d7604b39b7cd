import itertools
import random
import time

import numpy as np
import pyarrow as pa

from tarnsieve.llm import language_crf as l
from tests.llm.cases import LONG, SCHEMA, empty, odd_columns, weird


def test_forward_backward_against_enumeration():
    r = np.random.default_rng(0)
    scores, trans, start, chain = r.normal(size=(9, 3)), r.normal(size=(3, 3)), r.normal(size=3), np.array([0, 4, 5, 9])
    p, log_z, pairs = l.marginals(scores, trans, start, chain, True)
    want, want_pairs, want_z = np.zeros((9, 3)), np.zeros((3, 3)), 0.0
    for a, b in zip(chain[:-1], chain[1:]):
        weights = {y: np.exp(start[y[0]] + sum(scores[a + i, y[i]] for i in range(b - a)) + sum(trans[y[i - 1], y[i]] for i in range(1, b - a))) for y in itertools.product(range(3), repeat=b - a)}
        total = sum(weights.values())
        want_z += np.log(total)
        for y, w in weights.items():
            for i in range(b - a):
                want[a + i, y[i]] += w / total
                if i:
                    want_pairs[y[i - 1], y[i]] += w / total
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs) and abs(log_z - want_z) < 1e-9


def test_pieces_of_long_chains(monkeypatch):
    r = np.random.default_rng(2)
    scores, trans, start, chain = r.normal(size=(100, 3)) * 3, r.normal(size=(3, 3)), r.normal(size=3), np.array([0, 41, 42, 49, 99, 100])
    want = l.marginals(scores, trans, start, chain, True)
    for piece in (1, 2, 7, 8):
        monkeypatch.setattr(l, "PIECE", piece)
        got = l.marginals(scores, trans, start, chain, True)
        assert np.allclose(want[0], got[0]) and np.allclose(want[2], got[2]) and np.isclose(want[1], got[1])


def test_a_long_line_takes_few_steps():
    f = field()
    text = " ".join(language("xx", i, 1) for i in range(40)) * 400 + " " + language("yy", 1, 9).replace("\n", " ")
    began = time.perf_counter()
    ((_, _, n, spans),) = l.Labeller(f).label(pa.array([text], pa.large_string()))
    assert time.perf_counter() - began < 10 and n > 190_000 and sum(s["n"] for s in spans) == n and spans[-1]["lang"] == "yy"


def brute_query(field, rows):
    """The query's rows by the chain's marginals of one line at a time, word by word."""
    out = []
    for i, text in rows:
        sums, best = np.zeros(len(field.langs)), []
        for line in l._lines(text or ""):
            scores = np.array([field.weights[l.features([w], field.lexicons)[0]].sum(0) for w in line], float)
            t, s = np.exp(field.trans), np.exp(field.start)
            e = np.exp(scores - scores.max(1, keepdims=True))
            a, b = [s * e[0]], [np.ones(len(s))]
            for x in e[1:]:
                a.append(a[-1] / a[-1].sum() @ t * x)
            for x in e[:0:-1]:
                b.append(t @ (x * b[-1] / b[-1].sum()))
            p = np.array(a) * np.array(b[::-1])
            p /= p.sum(1, keepdims=True)
            sums += p.sum(0)
            best += p.argmax(1).tolist()
        spans = [(field.langs[y], len([*g])) for y, g in itertools.groupby(best)]
        out.append((i, field.langs[int(sums.argmax())] if best else None, len(best), spans))
    return out


def test_query_against_brute_force(spark):
    f = field()
    rows = [(i, language(["xx", "yy", "zz"][i % 3], 70 + i, 2) + " " + language(["yy", "xx"][i % 2], 90 + i, 1)) for i in range(12)] + [(20, ""), (21, None), (22, "...")]
    d = spark.createDataFrame([(i, t, "xx", "s", 0) for i, t in rows], SCHEMA)
    got = [(r.doc_id, r.lang, r.n_words, [(s.lang, s.n) for s in r.spans]) for r in sorted(l.identify(d, f).collect(), key=lambda r: r.doc_id)]
    assert got == brute_query(f, rows)


def test_any_columns(spark):
    d = odd_columns(spark, [(1, language("xx", 1, 2)), (2, None)])
    assert l.identify(d, l.train(d)).count() == 2


def language(name, seed, n):
    r = random.Random(seed)
    parts = {"xx": (["ka", "to", "mi"], ["ra", "no"]), "yy": (["str", "ven", "gru"], ["ich", "eit"]), "zz": (["éa", "ou", "ç"], ["tion", "eux"])}[name]
    return "\n".join(" ".join("".join(r.choice(parts[0]) for _ in range(r.randint(1, 3))) + r.choice(parts[1]) for _ in range(12)) for _ in range(n))


def field():
    names = ["xx", "yy", "zz"] * 12
    return l.fit([language(n, i, 6) for i, n in enumerate(names)], names)


def test_code_switched_words():
    f = field()
    assert f.accuracy > 0.95
    text = " ".join([*language("xx", 900, 1).split(), *language("yy", 901, 1).split(), *language("xx", 902, 1).split()])
    lang, share, n, spans = l.Labeller(f).label(pa.array([text], pa.large_string()))[0]
    assert lang == "xx" and n == 36 and sum(s["n"] for s in spans) == 36
    gold = ["xx"] * 12 + ["yy"] * 12 + ["xx"] * 12
    mine = [s["lang"] for s in spans for _ in range(s["n"])]
    assert np.mean([a == b for a, b in zip(gold, mine)]) > 0.9


def test_held_out_documents():
    f = field()
    texts = [(n, language(n, 5000 + i, 4)) for i, n in enumerate(["xx", "yy", "zz"] * 20)]
    got = l.Labeller(f).label(pa.array([t for _, t in texts], pa.large_string()))
    assert np.mean([g[0] == n for g, (n, _) in zip(got, texts)]) > 0.97


def test_blocks_and_memory_don_t_matter(monkeypatch):
    f = field()
    texts = [language("yy", 40 + i, 3) for i in range(6)] + ["", "ka"]
    whole = l.Labeller(f).label(pa.array(texts, pa.large_string()))
    monkeypatch.setattr(l, "REMEMBERED", 3)
    one = l.Labeller(f)
    assert [one.label(pa.array([t], pa.large_string()))[0][0] for t in texts] == [w[0] for w in whole]


def test_weird_rows(spark):
    d = weird(spark)
    rows = l.identify(d, field()).collect()
    assert len(rows) == d.count()
    for r in rows:
        assert r.n_words == sum(s["n"] for s in r.spans) and (r.lang is None) == (r.n_words == 0)
    assert {r.n_words for r in rows if r.doc_id == 3} == {len(LONG.split())}
    assert {r.lang for r in l.identify(d, None).collect()} == {None}
    assert l.identify(empty(spark), None).count() == 0


def test_training(spark):
    rows = [(i, language(n, i, 3), n, "s", 0) for i, n in enumerate(["xx", "yy"] * 20)] + [(None, None, None, None, None), (99, "", "xx", "s", 0), (98, "ka to", None, "s", 0)] + [(5, language("yy", 5, 3), "yy", "s", 0)] * 3
    d = spark.createDataFrame(rows, SCHEMA)
    f = l.train(d, 10)
    assert f.langs == ["xx", "yy"] and l.train(empty(spark)) is None
    assert {r.lang for r in l.identify(d, l.train(d.where("lang = 'xx'"))).where("n_words > 0").collect()} == {"xx"}
    a, b = l.train(d, 10), l.train(d.repartition(5), 10)
    assert np.array_equal(a.weights, b.weights)
