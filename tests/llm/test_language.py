"""The byte network: gradients, held-out accuracy, edge rows."""

import numpy as np
from cases import edge, empty
from conftest import SF_CHECK

from feedspark.llm.language import ByteGru, LanguageParams, identify, learn, pooled, segment_rows
from feedspark.llm.queries import op3_language


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = ByteGru(3, LanguageParams(hidden=4))
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, y, use = rng.integers(97, 105, (6, 5)), rng.integers(0, 3, 5), np.ones((6, 5))

    def loss():
        total = 0.0
        for _, p in net.probabilities(x):
            total -= np.log(p[y, np.arange(5)]).sum()
        return total / use.sum()

    grads = net.gradients(x, y, use)
    for key, value in net.weights.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in value.shape) if not key.startswith("in_") else (rng.integers(0, 12), rng.integers(97, 105))
            keep, step = value[at], 1e-3
            value[at] = keep + step
            up = loss()
            value[at] = keep - step
            down = loss()
            value[at] = keep
            assert abs((up - down) / (2 * step) - grads[key][at]) < 2e-3, (key, at)


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()}
    rows = [r for r in op3_language(spark, SF_CHECK).collect()]
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and len(held) > 250
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_segments_do_not_depend_on_neighbours():
    net, p = ByteGru(2, LanguageParams()), LanguageParams(segment=16)
    texts = [b"", b"abc", b"x" * 40, b" ", b"yz" * 8]
    offs = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    rows, doc = segment_rows(data, offs, 16)
    assert doc.tolist() == [1, 2, 2, 2, 3, 4] and bytes(rows[1]) == b"x" * 16
    together = pooled(net, data, offs, 2, p)
    for k, t in enumerate(texts):
        alone = pooled(net, np.frombuffer(t, np.uint8), np.array([0, len(t)]), 2, p)
        assert np.allclose(together[k], alone[0], atol=1e-5)


def test_edge_rows(spark):
    net, langs = learn(edge(spark), "doc_id", "text", "lang", LanguageParams(steps=2))
    assert langs == ["en"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(edge(spark), net, langs).collect()}
    assert got[0] == got[1] == got[2] == got[14] == ("und", 0.0) and got[3][0] == "en" and abs(got[13][1] - 1) < 1e-6
    assert learn(empty(spark), "doc_id", "text", "lang", LanguageParams()) == (None, [])
    assert {(r.lang_pred, r.score) for r in identify(edge(spark), None, []).collect()} == {("und", 0.0)}
