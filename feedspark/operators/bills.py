"""Bill-feed enrichment (SURVEY §2.2, §2.3, §2.6, §2.7: S5, F8, J1-J4, P3-P5,
T11-T14, D4-D6, U2, O2).

The reference fetches one to three web pages per feed item, one item at a
time.  Here the pages are a table: each page is parsed once into small
facts (``operators.pages.page_facts``), and the items are left-joined to
those facts on three derived keys.  Only item columns and short strings are
shuffled, never raw HTML.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark import config, schemas
from feedspark.functions.dates import format_pub_date, format_rfc822, parse_pub_date
from feedspark.functions.text import absolute_url, bill_activity, clean_url, derived_url, vote_result
from feedspark.operators.collect import article_key
from feedspark.operators.pages import page_facts


# S5
def feed_catalog(spark: SparkSession, feeds=config.BILL_FEEDS) -> DataFrame:
    rows = [(f.feed_url, f.type, f.file, f.enabled) for f in feeds]
    return spark.createDataFrame(rows, schemas.FEED_CATALOG)


BILL_SCHEMA = ("seq long, bill_title string, bill_link string, bill_description string, bill_overview string, bill_text string, "
               "bill_summary string, pub_date string, published_at timestamp, posted boolean, type string, vote_result string, "
               "last_action string, next_step string")


# J4 (+ F8)
def feed_type_join(items: DataFrame, catalog: DataFrame, only_enabled: bool = True) -> DataFrame:
    """Attach the feed type.  The catalog is configuration with a fixed,
    handful of rows, so it is broadcast explicitly."""
    cat = catalog.filter("enabled") if only_enabled else catalog
    return items.join(F.broadcast(cat.select("feed_url", "type")), "feed_url", "inner")


def _prepare(items: DataFrame) -> DataFrame:
    pub = parse_pub_date(F.col("pubDate"))
    clean = clean_url(F.col("link"))
    return (items
            .withColumn("_pub", pub)
            .withColumn("clean_link", clean)
            .withColumn("bill_text", derived_url(F.col("clean_link"), "/text"))
            .withColumn("summary_url", derived_url(F.col("clean_link"), "/summary")))


def _spread(key):
    """Left-join key that never lets rows without a lookup pile up: a null
    key (an item of a type that needs no page, or without a link) becomes a
    per-row value no URL can equal, so those rows hash across all partitions
    instead of into the single partition of null."""
    return F.coalesce(key, F.concat(F.lit("\u0000nokey:"), F.col("seq").cast("string")))


# J1, J2, J3
def enrich(items: DataFrame, pages: DataFrame, site: str = config.BILL_SITE) -> DataFrame:
    """Overview from the item's own page (first paragraph directly under
    ``#content``), summary from ``<clean link>/summary`` for Activity items,
    and for Votes items the first paragraph of the explainer page linked
    from ``#vote_explainer``, which replaces the overview."""
    facts = page_facts(pages)
    own = facts.select(F.col("url").alias("_u1"), F.col("overview").alias("_ov1"), F.col("explainer_href").alias("_href"))
    summ = facts.select(F.col("url").alias("_u2"), F.col("summary_text").alias("_sum2"))
    expl = facts.select(F.col("url").alias("_u3"), F.col("first_p").alias("_fp3"))

    x = _prepare(items)
    x = x.join(own, _spread(x["link"]) == own["_u1"], "left")
    x = x.withColumn("_sum_key", _spread(F.when(F.col("type") == "Activity", F.col("summary_url"))))
    x = x.join(summ, x["_sum_key"] == summ["_u2"], "left")
    x = x.withColumn("_expl_url", F.when(F.col("type") == "Votes", absolute_url(site, F.col("_href"))))
    x = x.withColumn("_expl_key", _spread(F.when(F.col("_expl_url") != "", F.col("_expl_url"))))
    x = x.join(expl, x["_expl_key"] == expl["_u3"], "left")

    overview = (F.when(F.col("type") == "Votes", F.coalesce(F.col("_fp3"), F.lit("")))
                .otherwise(F.coalesce(F.col("_ov1"), F.lit(""))))
    summary = F.when(F.col("type") == "Activity", F.coalesce(F.col("_sum2"), F.lit(""))).otherwise(F.lit(""))
    return (x.withColumn("bill_overview", overview)
             .withColumn("bill_summary", summary)
             .drop("_u1", "_ov1", "_href", "_sum_key", "_u2", "_sum2",
                   "_expl_url", "_expl_key", "_u3", "_fp3"))


# P3 + P5
def to_bill_articles(enriched: DataFrame) -> DataFrame:
    t = F.col("type")
    d = F.col("description")
    act = bill_activity(d)
    return enriched.select(
        "seq",
        F.col("title").alias("bill_title"),
        F.col("link").alias("bill_link"),
        d.alias("bill_description"),
        "bill_overview", "bill_text", "bill_summary",
        format_pub_date(F.col("_pub.published_at"), F.col("_pub.offset_min")).alias("pub_date"),
        F.col("_pub.published_at").alias("published_at"),
        F.lit(False).alias("posted"),
        t.alias("type"),
        F.when(t == "Votes", F.nullif(vote_result(d), F.lit(""))).alias("vote_result"),
        F.when(t == "Activity", F.nullif(act["last_action"], F.lit(""))).alias("last_action"),
        F.when(t == "Activity", F.nullif(act["next_step"], F.lit(""))).alias("next_step"),
    )


def bill_articles(items: DataFrame, pages: DataFrame, catalog: DataFrame,
                  only_enabled: bool = True, site: str = config.BILL_SITE) -> DataFrame:
    """S1 items -> J4 -> D4, T11, T12 -> J1/J2/J3 -> P3, P5."""
    return to_bill_articles(enrich(feed_type_join(items, catalog, only_enabled), pages, site))


# U2
def union_feeds(bills: DataFrame) -> DataFrame:
    """One table of all bill types whose optional columns differ: Votes rows
    carry ``vote_result``, Activity rows ``last_action`` and ``next_step``;
    elsewhere they are null.  One pass over the enriched rows."""
    only = lambda kind, c: F.when(F.col("type") == kind, F.col(c)).alias(c)
    optional = {"vote_result": "Votes", "last_action": "Activity", "next_step": "Activity"}
    return bills.select(*[only(optional[c], c) if c in optional else F.col(c) for c in bills.columns])


# O2
def bills_newest_first(bills: DataFrame) -> DataFrame:
    return bills.orderBy(F.col("pub_date").desc_nulls_last(), F.col("seq").asc())


# P4
def bill_to_article(bills: DataFrame, community: str = "politics", run: str = "") -> DataFrame:
    """Bill rows as article rows, as the poster reads them."""
    return bills.select(
        F.lit(community).alias("community"), F.col("type").alias("blog_name"),
        F.col("bill_link").alias("url"), F.col("bill_title").alias("title"),
        F.col("bill_description").alias("description"),
        F.col("pub_date").alias("date_published"), "published_at", "posted",
        F.lit(run).alias("run"), "seq",
        article_key(F.lit(community), "type", F.lit(run), "seq").alias("article_id")).select(*schemas.ARTICLE.fieldNames())


# D6 (intent of the reference's re-formatting step)
def pub_date_rfc822(items: DataFrame) -> DataFrame:
    p = parse_pub_date(F.col("pubDate"))
    return items.select("seq", format_rfc822(p["published_at"], p["offset_min"]).alias("pub_date_rfc822"))
