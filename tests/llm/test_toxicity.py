"""Deobfuscation and held-out classification."""

import itertools
import math
import random
from collections import Counter

import pytest
from cases import edge, empty
from conftest import SF_SMALL

from feedspark.llm.queries import op5_toxicity
from feedspark.llm.toxicity import (CLASS, OTHER, SIZE, CharModel, ToxicityModel, char_model, count_trigrams, decode, lattice, learn, restore,
                                    restored_words, score_column)

PLAIN = ("the idiot and the moron saw a clown that was stupid or pathetic while every loser went home with trash "
         "and nothing of this is disgusting or worthless to anyone there ").split() * 3


@pytest.fixture(scope="module")
def chars():
    return CharModel().fit(PLAIN)


@pytest.mark.parametrize("token,word", [
    ("1d10t", "idiot"), ("m.o.r.o.n", "moron"), ("m-0-r-0-n", "moron"), ("idiooooot", "idiot"), ("cl0wn", "clown"), ("p@thetic", "pathetic"),
    ("$tupid", "stupid"), ("tr4sh", "trash"), ("l0ser!!!", "loser"), ("disgu$ting,", "disgusting"), ("the&&&", "the"), ("and###", "and"),
    ("nothing", "nothing"), ("12345", ""), ("###", ""), ("", ""), ("iddiot", "idiot"), ("mooron", "moron"), ("idddiott", "idiot"),
    ("stupid/moron", "stupid moron"), ("idiot,moron,loser,stupid,clown,trash,pathetic", "idiot moron loser stupid clown trash pathetic"),
    ("1d1" + "o" * 50 + "t", "idiot"), ("m" + "-" * 60 + "oron", "moron"), ("$tup1d_m0r0n", "stupid moron"), ("2024-01-15", ""), ("$3.50", "")])
def test_restore(chars, token, word):
    assert restore(token, chars) == word


def test_look_alikes_alone_are_decoded(chars):
    assert restore("@$$", chars).isalpha() and restore("|o$3r", chars) == "loser"


def test_spaced_letters(chars):
    assert "idiot" in restored_words("You i d i o t there", chars, {})
    assert "moron" in restored_words("a m 0 r 0 n", chars, {}) or "moron" in restored_words("x\nm 0 r 0 n", chars, {})
    assert {"idiot", "moron"} <= restored_words("so i d i o t m o r o n!", chars, {}) | restored_words("i d i o t m o r o n", chars, {})
    assert "loser" in restored_words("l  o  s  e  r", chars, {})


def value(path, chars):
    """Log probability of one path through a lattice."""
    total, before, out = 0.0, (0, 0), ""
    for x, cost in path:
        total += cost
        if x == "" or (x == " " and before == (0, 0)):
            continue
        c = 0 if x == " " else CLASS.get(x, OTHER)
        total += chars.table[(before[0] * SIZE + before[1]) * SIZE + c]
        before, out = ((0, 0) if x == " " else (before[1], c)), out + x
    if before != (0, 0):
        total += chars.table[(before[0] * SIZE + before[1]) * SIZE]
    return total, out.strip()


def test_decoding_against_all_paths(chars):
    random.seed(4)
    tokens = ["1d10t", "iddiot", "m.o.r.o.n", "@$$", "a!!b", "0-0", "l|$er", "mooron", "жж1ж", "i d i o t", "..!", "trash/idiot"]
    tokens += ["".join(random.choice("aoidtm01$!.- ") for _ in range(random.randrange(1, 8))) for _ in range(150)]
    for t in tokens:
        paths = [value(path, chars) for path in itertools.product(*lattice(t))]
        best = max(s for s, _ in paths)
        got = decode(t, chars)
        assert any(out == got and math.isclose(s, best, rel_tol=1e-12) for s, out in paths), t


def brute_trigrams(text):
    out = Counter()
    for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        s = [0, 0, *(CLASS.get(c, OTHER) for c in w), 0]
        out.update((s[i - 2] * SIZE + s[i - 1]) * SIZE + s[i] for i in range(2, len(s)))
    return dict(out)


def test_character_model_counts_whole_texts_of_all_documents(spark):
    """A word that stands behind 3,000 characters, in one of 1,500 documents."""
    rows = [(i, "opening text of every page " * 3) for i in range(1500)] + [(1500, "boilerplate again " * 200 + "Żółwik")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    model = learn(docs, labels)
    assert dict(zip(model.chars.keys.tolist(), model.chars.counts.tolist())) == brute_trigrams("\n".join(t for _, t in rows))
    assert restore("żółw1k", model.chars) == "żółwik"
    real = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text")
    got = char_model(real)
    assert dict(zip(got.keys.tolist(), got.counts.tolist())) == brute_trigrams("\n".join(r.text for r in real.collect()))
    assert count_trigrams("") [0].tolist() == [] and char_model(real.limit(0)).table is not None


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [(truth[r.doc_id], r.predicted, r.score) for r in op5_toxicity(spark, d).collect() if r.held_out and r.doc_id in truth]
    toxic, clean = [r for r in rows if r[0] == 1], [r for r in rows if r[0] == 0]
    assert sum(r[1] for r in toxic) > 0.8 * len(toxic)
    assert sum(r[1] for r in clean) < 0.01 * len(clean)


def test_edge_rows(spark, chars):
    model = ToxicityModel(chars, {}, -2.0, (4,))
    got = {r.doc_id: r.s for r in edge(spark).select("doc_id", score_column(model, "text").alias("s")).collect()}
    assert len(set(got.values())) == 1 and 0 < got[0] < 0.7
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    assert learn(edge(spark), labels) is None
    assert {r[0] for r in edge(spark).select(score_column(None, "text")).collect()} == {0.0}
    assert empty(spark).select(score_column(model, "text")).count() == 0
    both = spark.createDataFrame([(5, 0), (5, 1), (7, 0), (10, 0)], "doc_id long, toxic int")  # repeated labels, few rows
    assert learn(edge(spark), both) is not None
