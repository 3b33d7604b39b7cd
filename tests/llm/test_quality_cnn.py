import numpy as np

from tarnsieve.llm import quality_cnn as q
from tests.llm.cases import empty, odd_columns, prose, weird


def brute(net: q.Network, text: bytes) -> float:
    """The probability by loops over every window of every chunk."""
    data, _ = q.padded([text])
    halves = max(2, -(-(len(text) + q.WIDTH - 1) // q._HALF))
    out = []
    for c in range(halves - 1):
        windows = [sum(net.embed[data[i + j]] @ net.filters[j] for j in range(q.WIDTH)) for i in range(c * q._HALF, min(c * q._HALF + q.CHUNK, halves * q._HALF - q.WIDTH + 1))]
        out.append(np.max(windows, 0))
    doc = np.concatenate([np.max(out, 0), np.mean(out, 0)])
    z = np.maximum(doc @ net.w1 + net.b1, 0) @ net.w2 + net.b2
    return float(1 / (1 + np.exp(-z[0])))


def test_convolution_against_loops():
    net = q.Network.start(3)
    texts = [b"", b"a", prose(1, 200).encode(), b"z" * 511, b"y" * 513]
    assert np.allclose(net.probabilities(texts), [brute(net, t) for t in texts], atol=1e-5)


def test_neighbours_don_t_count():
    net = q.Network.start(6)
    texts = [prose(i, 30 + 7 * i).encode() for i in range(9)]
    assert np.allclose(net.probabilities(texts), [net.probabilities([t])[0] for t in texts], atol=1e-6)


def test_last_byte_counts():
    net = q.Network.start(4)
    net.embed[ord("!")] = 50
    a, b = net.probabilities([b"a" * 3000, b"a" * 2999 + b"!"])
    assert a != b


def test_gradients_against_differences():
    net = q.Network.start(5)
    texts, y, w = [prose(i, 40).encode() for i in range(3)], np.array([1, 0, 1], np.float32), np.ones(3, np.float32)

    def loss():
        p = net.probabilities(texts)
        return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    grads = net.gradients(texts, y, w)
    for p, g in zip(net.parameters(), grads):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep, step = p[i], 1e-2
        p[i] = keep + step
        up = loss()
        p[i] = keep - step
        down = loss()
        p[i] = keep
        assert abs((up - down) / (2 * step) - g[i]) < 0.15 * abs(g[i]) + 1e-3


def _labelled(n):
    good = [prose(i, 50) for i in range(n)]
    bad = [" ".join(w.upper() + "!!!" for w in prose(9000 + i, 50).split()) for i in range(n)]
    return [t.encode() for t in good + bad], np.array([1] * n + [0] * n)


def test_held_out_accuracy():
    net = q.fit(*_labelled(60), epochs=8)
    p = net.probabilities([prose(500 + i, 80).encode() for i in range(40)] + [(" ".join(w.upper() + "!!!" for w in prose(700 + i, 80).split())).encode() for i in range(40)])
    assert (p[:40] >= net.threshold).mean() >= 0.95 and (p[40:] < net.threshold).mean() >= 0.95


def test_weird_rows(spark):
    texts, good = _labelled(30)
    net = q.fit(texts, good, epochs=4)
    d = weird(spark)
    rows = q.scores(d, net).collect()
    assert len(rows) == d.count() and all(0 <= r.probability <= 1 for r in rows)
    assert not any(r.keep for r in rows if r.doc_id in (1, 2))
    kept = q.filter_documents(d, net)
    assert kept.columns == d.columns and kept.count() == sum(r.keep for r in rows)
    assert q.scores(empty(spark), net).count() == 0 and q.filter_documents(empty(spark), net).count() == 0


def test_labels_that_teach_nothing(spark):
    d = weird(spark)
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    for rows in ([], [(6, 1, 0)], [(6, 1, 0), (6, 0, 0)], [(None, 1, 0), (99, 0, 1)], [(6, None, 0), (7, 1, None)]):
        net = q.train(d, labels(rows))
        assert net is None or isinstance(net, q.Network)
    assert q.train(d, labels([(6, 1, 0), (6, 0, 0)])) is None
    assert q.filter_documents(d, None).count() == d.count()
    assert {(r.probability, r.keep) for r in q.scores(d, None).collect()} == {(None, True)}


def test_query_against_loops(spark):
    """Probability and verdict of every row of the query by loops over all windows."""
    texts, good = _labelled(30)
    net = q.fit(texts, good, epochs=2)
    rows = [(i, t.decode()) for i, t in enumerate([*texts[:3], *texts[-3:], b"", b"z" * 700, b"a"])] + [(50, None)]
    got = {r.doc_id: (r.probability, r.keep) for r in q.scores(spark.createDataFrame(rows, "doc_id long, text string"), net).collect()}
    for i, t in rows:
        p = brute(net, (t or "").encode())
        assert abs(got[i][0] - p) < 1e-5 and got[i][1] == (bool(t) and p >= net.threshold)


def test_bad_documents_not_learned_from_are_rejected():
    """Fitted on the labelled documents of even id of the largest table; those of odd id are judged."""
    import pyarrow.parquet as pq

    docs = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).to_pandas()
    rows = pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pandas().merge(docs, on="doc_id").drop_duplicates("doc_id")
    rows = rows[rows["text"].str.len() > 0]
    good = (rows["quality"] == 1) & (rows["toxic"] == 0)
    even = rows["doc_id"] % 2 == 0
    net = q.fit([t.encode() for t in rows["text"][even]], good[even].to_numpy())
    p = net.probabilities([t.encode() for t in rows["text"][~even]])
    odd = rows[~even]
    kept, fine = p >= net.threshold, good[~even].to_numpy()
    assert kept[fine].mean() >= 0.985 and kept[~fine].mean() <= 0.2
    assert kept[odd["toxic"].to_numpy() == 1].mean() <= 0.35 and kept[odd["quality"].to_numpy() == 0].mean() <= 0.15


def test_threshold():
    p, good = np.array([0.1, 0.2, 0.3, 0.6, 0.7, 0.8]), np.array([0, 0, 0, 1, 1, 1]) == 1
    assert 0.3 < q.chosen_threshold(p, good) <= 0.6
    # one odd good document of many doesn't open the gate
    many = np.concatenate([p, np.full(300, 0.95), [0.01]]), np.concatenate([good, np.ones(301, bool)])
    assert 0.3 < q.chosen_threshold(*many) <= 0.6
    assert q.chosen_threshold(p, np.ones(6, bool)) == 0.5


def test_threads_don_t_matter(monkeypatch):
    texts, good = _labelled(12)
    a = q.fit(texts, good, epochs=1)
    monkeypatch.setattr(q, "THREADS", 1)
    b = q.fit(texts, good, epochs=1)
    assert all(np.array_equal(x, y) for x, y in zip(a.parameters(), b.parameters()))


def test_any_columns(spark):
    texts, good = _labelled(20)
    d = odd_columns(spark, [(i, t.decode()) for i, t in enumerate(texts)] + [(None, None)])
    net = q.train(d, spark.createDataFrame([(i, int(g), 0, 1) for i, g in enumerate(good)], "doc_id long, quality int, toxic int, `a.b` int"))
    out = q.filter_documents(d, net)
    assert out.columns == d.columns and out.dtypes == d.dtypes and 0 < out.count() < 41 and q.scores(d, net).count() == 41
