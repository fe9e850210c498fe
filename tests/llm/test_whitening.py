"""Components and whitened rows against numpy's eigenvectors."""

import itertools

import numpy as np
import pytest
from conftest import SF_SMALL

from feedspark.llm.queries import op12_whiten
from feedspark.llm.whitening import WhitenParams, fit, whiten, whole_entries


def whole(vectors):
    return np.floor(256 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64)


def brute(x):
    u = np.unique(x, axis=0)
    a = u - u.sum(axis=0) / len(u)
    e, v = np.linalg.eigh(a.T @ a / len(u))
    return u, e[::-1], v[:, ::-1]


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in enumerate(vectors)],
                                 "vec_id long, embedding array<float>")


def test_query_against_eigenvectors(spark):
    table = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()
    x = whole([r.embedding for r in table])
    u, e, v = brute(x)
    rows = {}
    for r in op12_whiten(spark, SF_SMALL).collect():
        rows.setdefault(r.vec_id, {})[r.component] = r
    assert len(rows) == len(table)
    off = x * len(u) - u.sum(axis=0)
    want = (x - u.sum(axis=0) / len(u)) @ v[:, :4] / np.sqrt(e[:4])
    got = np.array([[rows[r.vec_id][c].whitened for c in (1, 2, 3, 4)] for r in table])
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-10
    for r, d in zip(table, (off * off).sum(axis=1)):
        for c, own in rows[r.vec_id].items():
            assert (own.n, own.deviation) == (len(u), d)
            assert own.explained == pytest.approx(e[c - 1] / e.sum(), rel=1e-12) and own.identity_error < 1e-12


@pytest.mark.parametrize("vectors", [
    [[1, 0], [0, 1], [-1, 0], [0, -1]],                                   # one eigenvalue twice
    list(itertools.product([0, 1], repeat=6)),                            # one six times
    [[a, b, a + b, 2 * a, 0] for a, b in itertools.product(range(4), repeat=2)],  # rank 2
    [[1, 2], [3, 4]], [[1, 2]], [[5, 5, 5]] * 3])
def test_equal_and_missing_directions(spark, vectors):
    rows, dim = whole_entries(frame(spark, vectors))
    model = fit(rows, dim)
    u, e, _ = brute(whole(vectors))
    rank = min(4, int((e > 1e-6 * max(e[0], 1e-30)).sum())) if e[0] > 0 else 0
    if not rank:
        assert model is None and whiten(frame(spark, vectors)).count() == 0
        return
    assert len(model.values) == rank and np.allclose(model.values, e[:rank], rtol=1e-12) and model.identity_error < 1e-10


def test_early_stop_meets_equal_leading_values(spark):
    """Long vectors with leading values far above the rest, two of them equal:
    few passes, and the process beside the first one finds the twin."""
    rng = np.random.default_rng(3)
    base = np.round(rng.standard_normal((40, 120)), 2) / 8
    vectors = [np.r_[s * np.array(a), b] for b in base for s, a in ((1, [6, 0, 0]), (-1, [6, 0, 0]), (1, [0, 6, 0]), (-1, [0, 6, 0]), (1, [0, 0, 4]), (-1, [0, 0, 4]))]
    rows, dim = whole_entries(frame(spark, vectors))
    model = fit(rows, dim, WhitenParams(components=3))
    _, e, v = brute(whole(vectors))
    assert model.steps < dim and np.allclose(model.values, e[:3], rtol=1e-11)
    assert np.abs(v[:, :3].T @ model.vectors).max(axis=0).min() > 0.5 and model.identity_error < 1e-10


def test_edge_rows(spark):
    huge, nan = [3e38, -3e38, 1.0], float("nan")
    vectors = [None, [], [1, None, 2], [1, nan, 2], [1, float("inf"), 2], [1, 2], [0, 0, 0], [1, 2, 3], [1, 2, 3], [4, 1, 0], [-2, 5, 1], [7, 7, 2]]
    df = frame(spark, vectors).selectExpr("vec_id", "embedding", "'a' AS x", "1 AS n", "2 AS id")
    extra = spark.createDataFrame([(None, [1.0, 2.0, 3.0], "b", 1, 2)], df.schema)
    got = whiten(df.union(extra)).collect()
    ids = sorted((r.vec_id for r in got if r.component == 1), key=repr)
    assert ids == sorted([6, 7, 8, 9, 10, 11, None], key=repr) and {r.n for r in got} == {5}
    assert len(got) == 7 * 3 and max(r.identity_error for r in got) < 1e-10
    same = [[(r.component, r.deviation, r.whitened) for r in got if r.vec_id == i] for i in (7, 8, None)]
    assert same[0] == same[1] == same[2]
    far = whiten(frame(spark, [huge, [1, 2, 3], [0, 1, 0]])).collect()
    assert len({r.vec_id for r in far}) == 3 and any(r.deviation is None for r in far)
    assert whiten(df.limit(0)).count() == 0 and whiten(df.where("vec_id < 5")).count() == 0
