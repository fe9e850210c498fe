"""Per-community posting queue (SURVEY §2.3, §2.5, §2.6, §2.8: F3, W1, O3,
T7, T8, T9, J5).

The reference walks the stored list and posts the first unposted article.
Here that is a top-k per community: ``row_number() <= n`` over
stored order, which Spark plans as a partial WindowGroupLimit before
the shuffle, so even a community holding a third of all rows sends at most
``n`` rows per map task across the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedspark import config
from feedspark.functions.text import single_line_description
from feedspark.schemas import STORED_ORDER
from feedspark.session import settle


# F3
def unposted(articles: DataFrame) -> DataFrame:
    """``posted`` false; a missing flag counts as not posted."""
    return articles.filter(~F.coalesce(F.col("posted"), F.lit(False)))


# W1 / O3
def next_to_post(articles: DataFrame, n: int = 1, by: str = "community",
                 order=STORED_ORDER) -> DataFrame:
    """The first ``n`` unposted articles of each community in stored order."""
    w = Window.partitionBy(by).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return (unposted(articles)
            .withColumn("queue_pos", F.row_number().over(w))
            .filter(F.col("queue_pos") <= n))


def _by_community(community: Column, per: dict, default):
    expr = None
    for name, value in per.items():
        expr = (F.when(community == name, value) if expr is None
                else expr.when(community == name, value))
    return default if expr is None else expr.otherwise(default)


# T7 + T8
def render_posts(picked: DataFrame, templates: dict | None = None,
                 footers: dict | None = None) -> DataFrame:
    """(community, title, content, url, article_id) per picked article.

    Templates are java format strings with positional arguments
    (1 title, 2 blog_name, 3 url, 4 one-line description, 5 footer), chosen
    per community by a CASE expression: no join, no Python.
    """
    templates = templates or config.POST_TEMPLATES
    footers = footers or {}
    c = F.col("community")
    footer = _by_community(c, {k: F.lit(v) for k, v in footers.items()}, F.lit(config.DEFAULT_FOOTER))
    args = [F.coalesce(F.col("title"), F.lit("")), F.coalesce(F.col("blog_name"), F.lit("")),
            F.coalesce(F.col("url"), F.lit("")), single_line_description("description"), footer]

    def fmt(i):
        per = {k: F.format_string(v[i], *args) for k, v in templates.items()}
        return _by_community(c, per, F.format_string(config.DEFAULT_TEMPLATE[i], *args))

    return picked.select("community", fmt(0).alias("title"), fmt(1).alias("content"), "url", "article_id")


# T9
def summary_post_body(summary, url) -> Column:
    s = F.col(summary) if isinstance(summary, str) else summary
    u = F.col(url) if isinstance(url, str) else url
    return F.concat(F.coalesce(s.cast("string"), F.lit("None")), F.lit("\n\n[Read more]("), u, F.lit(")"))


# J5
def mark_posted(articles: DataFrame, picked: DataFrame) -> DataFrame:
    """Set ``posted`` for the picked rows, by ``article_id``.  The picks (at
    most n rows per community) are settled first, so the planner knows their
    bytes and streams the article table past them when they are few."""
    hit = settle(picked.select(F.col("article_id").alias("_hit")).distinct(), "picked")
    return (articles.join(hit, articles["article_id"] == hit["_hit"], "left")
            .withColumn("posted", F.coalesce(F.col("posted"), F.lit(False)) | F.col("_hit").isNotNull())
            .drop("_hit"))


def mark_posted_by_url(articles: DataFrame, urls: DataFrame, order=STORED_ORDER) -> DataFrame:
    """Summarizer variant: the **first** stored article of each (community,
    url); each community has a list of its own."""
    key = F.struct(*[F.col(c) for c in order])
    wanted = settle(urls.select("community", "url").distinct(), "urls")
    first = (articles.join(wanted, ["community", "url"], "left_semi")
             .groupBy("community", "url").agg(F.min_by("article_id", key).alias("article_id")))
    return mark_posted(articles, first)
