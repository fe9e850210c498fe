"""The mix: permutations, targets, exact sums, texts."""

import numpy as np
import pytest
from cases import edge, edge_rows, empty, words
from conftest import SF_SMALL

from feedspark.llm.mixing import MixParams, digest, mix, mixed_documents, permute, plan, targets


@pytest.mark.parametrize("n", [1, 2, 3, 10, 64, 1000])
def test_permutation_and_inverse(n):
    p = permute(np.arange(n), n, 5)
    assert sorted(p.tolist()) == list(range(n)) and (permute(p, n, 5, inverse=True) == np.arange(n)).all()
    assert n < 64 or (p != permute(np.arange(n), n, 6)).any()


def test_targets_reshare_the_excess():
    p = MixParams()
    t = targets([100, 100, 100], p)
    assert t == [200, 250 * 2 / 3 - 250 * 2 / 3 + 250 * 2 / 3, 250 / 3] or abs(sum(t) - 450) < 1e-9 and t[0] == 200
    t = targets([1000, 1, 0, 10], p)
    assert t[1] == 2 and t[2] == 0 and t[3] == 20 and abs(sum(t) - 1516.5) < 1e-9
    assert targets([], p) == []


def test_plan_takes_exactly_the_words():
    for sizes in ([100, 7, 3], [1, 1], [128, 129, 256, 1000]):
        for s in plan([(str(i), n) for i, n in enumerate(sizes)], MixParams(block=16)):
            order = permute(np.arange(s.blocks), s.blocks, MixParams().seed + s.index)
            held = [min(16, s.size - 16 * order[j % s.blocks]) for j in range(s.slots)]
            assert sum(held[:-1]) + s.last == s.words == round(s.target) and 0 < s.last <= held[-1]


def check(rows, texts):
    for r in rows:
        assert r.size == len(words(texts.get(r.doc_id))) and 0 <= r.taken <= 2 * r.size
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    return by


def test_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = docs.collect()
    source = {r.doc_id: r.source for r in rows}
    got = digest(mix(docs)).collect()
    check(got, {r.doc_id: r.text for r in rows})
    sums, total = {}, sum(r.size for r in got)
    for r in got:
        s = sums.setdefault(source[r.doc_id], [0, 0, r.target, r.source_size])
        s[0] += r.size
        s[1] += r.taken
    assert all(size == n and abs(taken - t) <= 0.5 for size, taken, t, n in sums.values())
    assert abs(sum(t for _, _, t, _ in sums.values()) - 1.5 * total) < 1e-6
    assert sorted(map(tuple, digest(mix(docs.repartition(5))).collect())) == sorted(map(tuple, got))


def test_mixed_texts_hold_the_words_taken(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    taken = {r.doc_id: r.taken for r in digest(mix(docs)).collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = mixed_documents(docs)
    assert got.columns == docs.columns
    mixed = {r.doc_id: r.text for r in got.collect()}
    assert set(mixed) == {i for i, n in taken.items() if n}
    assert all(len(words(t)) == taken[i] and set(words(t)) <= set(words(rows[i])) for i, t in mixed.items())
    whole = [i for i, n in taken.items() if n == 2 * len(words(rows[i])) and n]
    assert whole and all(mixed[i] == rows[i].strip(" \t\n\x0b\x0c\r") + "\n" + rows[i].strip(" \t\n\x0b\x0c\r") for i in whole)


def test_every_row_is_a_document(spark):
    """Null ids, one id with several texts, and a repeated row."""
    rows = [(None, f"null id {i} " + f"w{i} " * (i + 1), "a") for i in range(8)] + [(1, "first text", "a"), (1, "second text", "b"), (2, "twice", "b"), (2, "twice", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    p = MixParams(weights=(1,), share=1.0, most=1.0, block=4)  # takes every word once
    got = [(r.doc_id, " ".join(words(r.text)), r.source) for r in mixed_documents(df, params=p).collect()]
    assert sorted(map(str, got)) == sorted(str((i, t.strip(), s)) for i, t, s in rows)
    half = MixParams(weights=(1,), share=0.5, most=1.0, block=4)
    runs = [sorted(map(str, mixed_documents(d, params=half).collect())) for d in (df, df.orderBy("text").repartition(3))]
    assert runs[0] == runs[1]


def test_edge_rows(spark):
    got = digest(mix(edge(spark))).collect()
    assert len(got) == len(edge_rows())
    check(got, {r[0]: r[1] for r in edge_rows()})
    assert sum(r.taken for r in got if not r.size) == 0
    assert digest(mix(empty(spark))).count() == 0
    assert mixed_documents(edge(spark)).columns == edge(spark).columns
