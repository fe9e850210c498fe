"""The automaton's scores against probabilities worked out word by word."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import edge, edge_rows, empty, lowered, words
from conftest import SF_SMALL
from pyspark.sql import functions as F

from feedspark.llm.backoff import BackoffParams, distinct, pack_counts, pack_sorted, score_texts, unpack_counts, unpack_sorted
from feedspark.llm.queries import op13_lm_scores


class Brute:
    def __init__(self, texts, order, strength):
        self.counts, self.order, self.strength = Counter(), order, strength
        for t in texts:
            s = ("<s>", *words(lowered(t)), "</s>")
            for k in range(1, order + 1):
                self.counts.update(s[i:i + k] for i in range(len(s) - k + 1))
        own = {g: c for g, c in self.counts.items() if len(g) == 1 and g != ("<s>",)}
        self.n, self.v = sum(own.values()), len(own)

    def prob(self, h, w):
        if not h:
            return (self.counts[w,] + 1) / (self.n + self.v + 1)
        return (self.counts[(*h, w)] + self.strength * self.prob(h[1:], w)) / (self.counts[h] + self.strength)

    def row(self, text):
        s = ("<s>", *words(lowered(text)), "</s>")
        own = [self.counts[w,] for w in s[1:]]
        return (len(own), sum(c > 0 for c in own), sum(math.log10((c + 1) / (self.n + self.v + 1)) for c in own),
                sum(math.log10(self.prob(s[max(0, i - self.order + 1):i], s[i])) for i in range(1, len(s))))


def check(got, want):
    assert len(got) == len(want)
    for (a, b) in zip(sorted(got, key=repr), sorted(want, key=repr)):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order,strength", [(1, 1.0), (2, 200.0), (3, 2.5), (4, 0.5)])
def test_against_word_by_word_probabilities(spark, order, strength):
    """Small groups and slices, so that counts come from many of both."""
    random.seed(order)
    rows = [(i, " ".join(random.choice("a b c d E f g".split()) for _ in range(random.choice([0, 1, 2, 9, 40])))) for i in range(120)]
    model = Brute([t for i, t in rows if i % 3], order, strength)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    p = BackoffParams(order=order, strength=strength, group_bytes=300, slice_grams=60)
    got = score_texts(docs, F.col("doc_id") % 3 != 0, params=p).collect()
    assert {r.train_tokens for r in got} == {model.n}
    check([(r.id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got], [(i, *model.row(t)) for i, t in rows])


def test_probabilities_of_all_continuations_add_up_to_one(spark):
    texts = ["a b a b c", "b c", "a a a", "c b a"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    asked = [f"{h} {w}".strip() for h in ("", "a", "b", "c") for w in ("a", "b", "c", "zz")]
    both = docs.union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(asked + ["", "a", "b", "c"])], docs.schema))
    got = {r.id: r.score for r in score_texts(both, F.col("doc_id") < 100, params=BackoffParams(order=2, strength=3.0)).collect()}
    model = Brute(texts, 2, 3.0)
    for h in ("a", "b", "c"):
        next_word = sum(model.prob((h,), w) for w in ("a", "b", "c", "</s>", "zz"))
        assert next_word == pytest.approx(1)
    for i, t in enumerate(asked + ["", "a", "b", "c"]):
        assert got[100 + i] == pytest.approx(model.row(t)[3])


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    model = Brute([t for i, t in rows if not held[i]], 2, BackoffParams().strength)
    got = op13_lm_scores(spark, SF_SMALL).collect()
    assert {r.train_tokens for r in got} == {model.n} and all(r.held_out == held[r.doc_id] for r in got)
    check([(r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got], [(i, *model.row(t)) for i, t in rows])
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > 1.02 * sum(r.base_score for r in out)  # logs are negative: the model is nearer to 0


def test_packing_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        values = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        assert (unpack_sorted(pack_sorted(values)) == values).all()
    for top in (0, 1, 255, 256, 70_000, 1 << 40):
        assert unpack_counts(pack_counts(np.array([0, top]))).tolist() == [0, top]
    own, first, at = distinct(np.array([0, 7, 3, 7, 0], np.uint64))
    assert own.tolist() == [3, 7] and first.tolist() == [2, 1] and at.tolist() == [-1, 1, 0, 1, -1]


def test_edge_rows(spark):
    rows = edge_rows()
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True))
    model = Brute([r[1] for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2], 2, 200.0)
    got = score_texts(edge(spark), learn, params=BackoffParams(group_bytes=2000)).collect()
    check([(r.id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got], [(r[0], *model.row(r[1])) for r in rows])
    assert score_texts(empty(spark), learn).count() == 0
    none = score_texts(edge(spark), F.lit(None).cast("boolean")).collect()
    assert {(r.n_known, r.train_tokens, r.score, r.base_score) for r in none} == {(0, 0, 0.0, 0.0)}
