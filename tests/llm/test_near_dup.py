"""Classes of near copies against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from cases import classes, edge, edge_rows, empty, shingles
from conftest import SF_SMALL

from feedspark.llm.near_dup import NearDupParams, _tiles, components, keep_one, near_duplicates


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = {r.doc_id: shingles(r.text) for r in docs.collect()}
    want = classes(rows, 85)
    got = near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(rows[i]), c, i == c) for i, c in want.items()}


def test_large_group_of_near_copies_in_small_tiles(spark):
    """Variants of one text that differ from each other by more or less than
    the threshold, more of them than a tile holds."""
    random.seed(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(random.choice([0, 1, 2, 4, 6])):
            w[random.randrange(len(w))] = f"x{i}{random.randrange(99)}"
        rows.append((i, " ".join(w)))
    want = classes({i: shingles(t) for i, t in rows}, 85)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), params=NearDupParams(tile=8))
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_pair_that_agrees_modulo_256_in_an_earlier_band():
    """Its full keys differ there, so it is in no bucket of that band and must
    be confirmed in the first band whose key it shares."""
    p = NearDupParams()
    bands = np.arange(2 * p.bands).reshape(2, p.bands)
    bands[1, 3] = bands[0, 3]
    tile = pd.DataFrame({"key": int(bands[0, 3]), "i": 0, "j": 0, "band": 3, "id": [1, 2], "comp": [1, 2], "n": 100, "side": 2, "same": True,
                         "sig": [bytes(p.coordinates)] * 2, "bands": list(bands), "shingles": [np.arange(100, dtype=np.uint64).tobytes()] * 2})
    links = pd.concat(_tiles(p)(iter([tile])))
    assert links[["a", "b"]].to_numpy().tolist() == [[1, 2]]
    later = pd.concat(_tiles(p)(iter([tile.assign(key=int(bands[0, 7]), band=7)])))
    assert later.empty  # looked at once only


def test_edge_rows(spark):
    got = near_duplicates(edge(spark)).collect()
    sets = {r[0]: shingles(r[1]) for r in edge_rows() if r[0] is not None}
    want = classes(sets, 85)
    assert len(got) == len(edge_rows())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("links", [[], [(1, 2)], [(5, 4), (4, 3), (3, 2), (2, 9), (7, 8), (8, 8)]])
def test_components(spark, links):
    got = {r.id: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == ({} if not links else {1: 1, 2: 1} if len(links) == 1 else {2: 2, 3: 2, 4: 2, 5: 2, 9: 2, 7: 7, 8: 7})


def test_keep_one_keeps_columns(spark):
    kept = keep_one(edge(spark), params=NearDupParams(percent=80, agree=58))
    assert kept.columns == edge(spark).columns
    want = classes({r[0]: shingles(r[1]) for r in edge_rows() if r[0] is not None}, 80)
    assert {r.doc_id for r in kept.collect()} == {i for i, c in want.items() if i == c} | {None}


TEXT = " ".join(f"t{i}" for i in range(80))
OTHER = " ".join(f"o{i}" for i in range(70))


@pytest.mark.parametrize("rows,kept,components", [
    ([(0, TEXT), (1, TEXT), (1, OTHER)], [(0, TEXT), (1, OTHER)], [0, 0, 1]),
    ([(0, TEXT), (0, OTHER), (1, TEXT), (2, OTHER)], [(0, TEXT), (0, OTHER)], [0, 0, 0, 0]),
    ([(3, OTHER), (3, TEXT), (3, TEXT + " end"), (3, TEXT)], None, [3, 3, 3, 3]),
    ([(5, TEXT), (5, TEXT)], [(5, TEXT), (5, TEXT)], [5, 5]),
    ([(4, TEXT + " x"), (2, OTHER), (2, TEXT), (9, OTHER + " y"), (9, "short one"), (9, None)], [(2, OTHER), (2, TEXT), (9, "short one"), (9, None)], None)])
def test_several_texts_under_one_id(spark, rows, kept, components):
    """No text is lost: each group of near copies keeps one text."""
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = [(r.doc_id, r.text) for r in keep_one(docs, params=NearDupParams(percent=80, agree=58)).collect()]
    if kept is None:
        assert (3, OTHER) in got and 2 <= len(got) <= 3 and len({t for _, t in got}) == 2
    else:
        assert sorted(got, key=repr) == sorted(kept, key=repr)
    if components is not None:
        assert sorted(r.component_id for r in near_duplicates(docs).collect()) == sorted(components)


def test_recall_at_the_pipelines_threshold(spark):
    """Pairs planted at similarity 0.80 to 0.95: all are linked."""
    random.seed(8)
    rows, want = [], {}
    for i in range(150):
        base = [f"p{i}w{k}" for k in range(200)]
        near = list(base)
        for k in random.sample(range(200), random.choice([1, 2, 3])):
            near[k] = f"new{i}x{k}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        want[2 * i + 1] = 2 * i if 100 * len(a & b) >= 80 * len(a | b) else 2 * i + 1
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), params=NearDupParams(percent=80, agree=58)).collect()
    assert sum(w % 2 == 0 for w in want.values()) > 100
    assert {r.doc_id: r.component_id for r in got if r.doc_id % 2} == want
