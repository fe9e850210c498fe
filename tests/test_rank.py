"""TF-IDF ranking against a brute-force Python implementation of the same
definition, on whole small-fixture documents."""

import math
import re
from collections import Counter

import pytest

from conftest import SF_SMALL
from feedspark.config import RankParams
from feedspark.operators.rank import main_points, rank_sentences

P = RankParams()
STOP = set(P.stop_words)


def brute(text):
    sents = re.split(r"(?<=[.!?])\s+", text)
    n = len(sents)
    docs = []
    for s in sents:
        toks = [t for t in re.findall(r"\w{2,}", s.lower()) if t not in STOP]
        docs.append(Counter(toks + [a + " " + b for a, b in zip(toks, toks[1:])]))
    df = Counter(t for d in docs for t in d)
    if P.max_df * n < P.min_df:
        return None
    keep = {t for t, c in df.items() if P.min_df <= c <= P.max_df * n}
    if not keep:
        return None
    scores = []
    for d in docs:
        w = {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in d.items() if t in keep}
        norm = math.sqrt(sum(v * v for v in w.values()))
        scores.append(round(sum(w.values()) / norm, 9) if norm else 0.0)
    order = sorted(range(n), key=lambda i: scores[i], reverse=True)
    return [sents[i] for i in order[:P.num_points]], scores


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")


def test_main_points_match_brute_force(spark, docs):
    got = {r.doc_id: r.main_points for r in main_points(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts)
    for k, text in texts.items():
        exp = brute(text)
        if exp is None:
            assert got[k] is None, k
        else:
            assert got[k] == exp[0], k


def test_scores_match(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rank_sentences(docs, with_text=False).collect():
        exp = brute(texts[r.doc_id])
        assert exp is not None
        assert abs(exp[1][r.s_pos] - r.score) < 1e-8


def test_small_and_tied(spark):
    rows = [(1, "Only one. Two here."),
            (2, "alpha beta. alpha beta. alpha beta. alpha beta. gamma."),
            (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.main_points for r in main_points(df).collect()}
    assert got[1] is None and got[3] is None
    exp = brute(rows[1][1])
    assert got[2] == exp[0]                 # ties keep text order


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_long_articles_have_the_same_ranks(spark):
    """Every article by the spread path, whole and top; then a limit that
    sends some each way; a huge article and ones that cannot be ranked."""
    from dataclasses import replace

    from feedspark.operators.rank import rank_long_articles
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    huge = " ".join(f"Sentence {k} of words number{k % 50} and topic{k % 7}." for k in range(1500))
    docs = docs.union(spark.createDataFrame([(10_001, huge), (10_002, ""), (10_003, None), (10_004, "One. Two. Three."), (10_005, "same word. " * 9)],
                                            "doc_id long, text string"))
    for top in (None, 5):
        want = _rows(rank_sentences(docs, P, top=top))
        assert _rows(rank_long_articles(docs, P, top=top).select("doc_id", "s_pos", "rank_no", "score", "sentence")) == want
        split = rank_sentences(docs, replace(P, task_chars=1500), top=top)
        assert _rows(split.select("doc_id", "s_pos", "rank_no", "score", "sentence")) == want
    assert _rows(main_points(docs, replace(P, task_chars=1500))) == _rows(main_points(docs, P))


def test_no_stage_of_long_articles_is_keyed_by_the_article_alone(spark, monkeypatch):
    import re as regex

    from feedspark.operators import rank
    seen = []
    real = rank.settle

    def watched(df, name):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(rank, "settle", watched)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    full = rank.rank_long_articles(docs, P, with_text=False)
    seen.append(full._jdf.queryExecution().executedPlan().toString())
    alone = [p for p in seen for m in regex.findall(r"Exchange hashpartitioning\(doc_id#\d+L?, \d+\)", p)]
    # What is keyed by the article: one partial row a task (usable articles) and the ranges' sizes.
    keyed = [line for p in seen for line in p.split("\n") if regex.search(r"hashpartitioning\(doc_id#\d+L?, \d+\)", line)]
    assert len(seen) == 4 and len(keyed) == len(alone)
    for p in seen[:2]:
        assert not regex.search(r"hashpartitioning\(doc_id#\d+L?, \d+\)", p)


def _nodes(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_article_is_ranked_in_its_row(spark):
    """No sort, window, join or aggregation of rows behind the one exchange."""
    import re as regex

    from feedspark.operators.summarize import summary_and_points
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    both = summary_and_points(docs)
    for df in (rank_sentences(docs, with_text=False), rank_sentences(docs, top=5), main_points(docs), both, both.select("doc_id", "main_points")):
        p = _nodes(df)
        assert p.count("Exchange") == 1 and not regex.search(r"Sort|Window|Join|Aggregate", p)


def test_rows_that_share_an_id_are_one_article(spark):
    """Repeated ids, with one text or several, and null ids: as by the row plan;
    the other articles are not touched by them."""
    from feedspark.operators.rank import by_doc, rank_shared
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").limit(40).cache()
    text = docs.first()["text"]
    odd = docs.union(spark.createDataFrame([(7001, text), (7001, text), (7002, text), (7002, text + " More of it. And more."), (None, text), (None, "a b")],
                                           "doc_id long, text string"))
    key = lambda rows: sorted(rows, key=str)
    for top, with_text in ((None, False), (5, True)):
        want = rank_shared(by_doc(odd), P, top, with_text)
        got = rank_sentences(odd, P, top=top, with_text=with_text).select(*want.columns)
        assert key(tuple(r) for r in got.collect()) == key(tuple(r) for r in want.collect())
    got = key(tuple(map(str, r)) for r in main_points(odd).collect())
    assert len(got) == odd.count() and sum(r == ("None", "None") for r in got) == 2
    assert [r for r in got if r[0] not in ("7001", "7002", "None")] == key(tuple(map(str, r)) for r in main_points(docs).collect())


def test_long_articles_leave_their_blocks_as_counts(spark, monkeypatch):
    """An article of one block writes no term rows; of several, one a (block, term)."""
    from feedspark.operators import rank
    sizes = {}
    real = rank.settle

    def watched(df, name):
        out = real(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(rank, "settle", watched)
    long_ = " ".join(f"alpha beta number{k % 5}." for k in range(rank.BLOCK + 10))
    docs = spark.createDataFrame([(1, "alpha beta. alpha beta. alpha beta. gamma."), (2, long_), (3, "")], "doc_id long, text string")
    got = _rows(rank.rank_long_articles(docs, P).select("doc_id", "s_pos", "rank_no", "score", "sentence"))
    assert got == _rows(rank_sentences(docs, P).select("doc_id", "s_pos", "rank_no", "score", "sentence"))
    # alpha, beta, alpha beta, five numbers and their pairs with beta, and the row of the block's sentences; two blocks
    assert sizes["rank-terms"] == 2 * (3 + 5 + 5 + 1)


def _only_one_exchange(df):
    import re as regex
    p = _nodes(df)
    assert p.count("Exchange") == 1 and not regex.search(r"Sort|Window|Join|Aggregate", p)


def test_sentence_tfidf_ranks_an_article_in_its_row(spark):
    from feedspark.plans.queries import queries
    _only_one_exchange(queries()["sentence_tfidf"](spark, SF_SMALL))


def test_novel_points_takes_an_article_in_its_row(spark):
    from feedspark.plans.queries import queries
    _only_one_exchange(queries()["novel_points"](spark, SF_SMALL))


TEXTS = ["Alpha beta gamma. Beta gamma delta. Alpha gamma. Delta alpha beta.", "Beta gamma. Gamma delta alpha. Alpha beta. Beta.",
         "Alpha. Beta alpha. Gamma gamma beta. Delta. Gamma alpha beta delta.", "One. Two.", "", None, "The of and. It is. We."]


def test_ids_of_a_few_rows_are_ranked_in_one_row(spark):
    """Texts of one id in every mixture, equal and unequal lengths, empty and
    null ones: as by the row plan; more than ``FEW`` rows by that itself."""
    from itertools import combinations_with_replacement

    from feedspark.operators.rank import FEW, by_doc, rank_pooled, rank_shared
    sets = [c for k in (2, 3) for c in combinations_with_replacement(TEXTS, k)] + [TEXTS[:2] * FEW]
    docs = spark.createDataFrame([(k, t) for k, c in enumerate(sets) for t in c] + [(9001, TEXTS[0])], "doc_id long, text string").cache()
    key = lambda df, *cols: sorted(tuple(r) for r in df.select("doc_id", "rank_no", "score", *cols).collect())
    few = docs.where(f"doc_id < {len(sets) - 1}")
    for top in (None, 2, 5):
        want = rank_shared(by_doc(docs), P, top, False)
        assert key(rank_sentences(docs, P, top=top, with_text=False)) == key(want)
        assert key(rank_pooled(by_doc(few), P, top, False)) == key(rank_shared(by_doc(few), P, top, False))
    want = rank_shared(by_doc(docs), P, None, True)
    got = rank_sentences(docs, P, with_text=True)
    place = lambda df: sorted(tuple(r) for r in df.select("doc_id", "s_pos", "score", "sentence").collect())
    assert place(got) == place(want)
    p = _nodes(rank_sentences(few, P, top=5))
    assert "Window" not in p and "rank_no" in p
