"""Page jobs.

``page_content`` is one projection over the pages table: no shuffle, no
Python unless a page's paragraphs hold an entity.  ``page_facts`` runs the
element-by-id parser only on pages that mention one of the ids, and keeps
one row per URL so that joins against it cannot multiply rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.functions import html as H
from feedspark.functions.text import content_snippet
from feedspark.functions.udfs import container_facts


# H5 (+ A2, P6)
def page_content(pages: DataFrame, html_col: str = "html", keep=("url",)) -> DataFrame:
    return (H.with_page_content(pages.select(*keep, html_col), html_col, "pc")
            .select(*keep, "pc.content", "pc.title", "pc.meta_description",
                    F.col("pc.n_paragraphs").alias("paragraph_count"),
                    content_snippet("pc.content").alias("snippet")))


# H6-H8, one row per URL
def page_facts(pages: DataFrame) -> DataFrame:
    """(url, has_content, overview, first_p, has_summary, summary_text,
    explainer_href) per distinct URL.  Only URL and small strings leave the
    map side; duplicate URLs resolve to one page (smallest MD5 of the html), with
    partial aggregation before the shuffle."""
    # Pages claiming the same URL: the one with the smallest MD5 of its HTML
    # wins (a short key; the HTML itself never enters the aggregation).
    facts = pages.select("url", F.md5("html").alias("_h"), container_facts(F.col("html")).alias("f"))
    one = facts.groupBy("url").agg(F.min_by("f", "_h").alias("f"))
    return one.select(
        "url",
        F.coalesce(F.col("f.has_content"), F.lit(False)).alias("has_content"),
        F.col("f.content_child_p").alias("overview"),
        F.col("f.content_first_p").alias("first_p"),
        F.coalesce(F.col("f.has_summary"), F.lit(False)).alias("has_summary"),
        F.col("f.summary_text").alias("summary_text"),
        F.col("f.explainer_href").alias("explainer_href"),
    )
