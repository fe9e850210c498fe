"""Summaries and the summarize-and-post queue (SURVEY §2.11: UD1-UD4, W2,
A4, O4, F5-F7, T9).

``article_summary``: paragraphs in chunks of five -> one summary per chunk ->
joined by a space in chunk order -> at most seven sentences -> lines echoing
the prompt removed.  With the default hook all of it is one projection over
the article rows (higher-order functions on arrays, no shuffle).  A user
hook (an Arrow iterator UDF, e.g. a model loaded once per worker) gets the
chunks of a whole Arrow batch at a time, still without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.config import RankParams, SummaryParams
from feedspark.functions.text import (PROMPT_PREFIX, cap_sentences, chunks_of, drop_prompt_lines, first_sentence, is_blank, let, novel_points,
                                      text_chunks)
from feedspark.functions.udfs import SummarizerHook, summarize_chunks
from feedspark.operators.queue import mark_posted_by_url, next_to_post, summary_post_body
from feedspark.operators.rank import by_doc, with_points
from feedspark.session import settle


def lead_sentence(chunk: Column) -> Column:
    """Default summarizer, a native stand-in for a model: the chunk's first
    sentence.  It is *not* the reference's neural summary."""
    return first_sentence(chunk)


# UD1
def chunk_summaries(text: Column, hook: SummarizerHook | None = None,
                    params: SummaryParams = SummaryParams()) -> Column:
    """With a hook, each chunk reaches it behind the prompt prefix, and the
    hook gets the length parameters (it cuts its input itself)."""
    if hook is None:
        return F.transform(text_chunks(text, params.chunk_size), lead_sentence)
    chunks = chunks_of(F.split(text, "\n", -1), params.chunk_size)  # Python UDFs take no nested lambdas
    return summarize_chunks(F.transform(chunks, lambda c: F.concat(F.lit(PROMPT_PREFIX + " "), c)), hook, params)


# UD2 (A4 -> T10 -> O4 -> F6)
def article_summary(text: Column, hook: SummarizerHook | None = None,
                    params: SummaryParams = SummaryParams()) -> Column:
    combined = F.array_join(chunk_summaries(text, hook, params), " ")
    finish = lambda c: drop_prompt_lines(cap_sentences(c, params.max_sentences))
    return let(combined, finish) if hook is None else finish(combined)  # a Python hook cannot stand inside a lambda's input


# UD3
def summary_and_points(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       hook: SummarizerHook | None = None,
                       summary_params: SummaryParams = SummaryParams(),
                       rank_params: RankParams = RankParams()) -> DataFrame:
    """(doc_id, summary, main_points).  Blank text gives nulls (F5); when
    ranking fails the reference returns (None, None), so both are null."""
    # One shuffle of the text: articles partitioned by doc_id, then points and
    # summary in the article's row.  Blank text has no vocabulary, so its points
    # are null without a separate filter.
    d = with_points(by_doc(docs, id_col, text_col), rank_params)
    both = d.select("doc_id", is_blank(F.col("text")).alias("_blank"),
                    article_summary(F.col("text"), hook, summary_params).alias("summary"), "main_points")
    failed = F.col("main_points").isNull() | F.col("_blank")
    return both.select(
        "doc_id",
        F.when(failed, F.lit(None).cast("string")).otherwise(F.col("summary")).alias("summary"),
        F.when(failed, F.lit(None)).otherwise(novel_points("main_points", "summary")).alias("main_points"))


# UD4
def summarize_queue(articles: DataFrame, pages: DataFrame, n: int = 1,
                    hook: SummarizerHook | None = None,
                    summary_params: SummaryParams = SummaryParams(),
                    rank_params: RankParams = RankParams()):
    """Oldest unposted article per community -> its page -> content ->
    summary and points -> post body; then the articles with that URL marked.

    Returns (outbox, articles_after).
    """
    from feedspark.operators.pages import page_content

    # The picks are a few rows that four steps need: found once, written down.
    picked = settle(next_to_post(articles, n=n), "picked")
    pages1 = pages.join(picked.select("url").distinct(), "url", "left_semi")
    content = page_content(pages1).select("url", "content")
    # one page per URL: the content rows are few, pick deterministically
    content = content.groupBy("url").agg(F.min("content").alias("content"))
    jobs = settle(picked.join(content, "url", "left"), "jobs")
    sp = summary_and_points(jobs, id_col="article_id", text_col="content", hook=hook,
                            summary_params=summary_params, rank_params=rank_params)
    out = (jobs.join(sp.withColumnRenamed("doc_id", "article_id"), "article_id", "left")
               .select("community", "title",
                       summary_post_body(F.col("summary"), F.col("url")).alias("content"),
                       "url", "article_id", "summary", "main_points"))
    return out, mark_posted_by_url(articles, picked)
