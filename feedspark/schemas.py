"""Schemas of the tables the jobs read and write."""

from pyspark.sql import types as T

S, B, L, TS = T.StringType(), T.BooleanType(), T.LongType(), T.TimestampType()

# Feed entry as read from an RSS/Atom document (all strings).
FEED_ITEM = T.StructType([
    T.StructField("title", S), T.StructField("link", S),
    T.StructField("description", S), T.StructField("pubDate", S),
])

TRACKER = T.StructType([
    T.StructField("community", S),
    T.StructField("last_fetched", S),
    T.StructField("blogs", T.ArrayType(T.StructType([
        T.StructField("blog_name", S), T.StructField("rss_url", S)]))),
])

# Atom entry: the link is an attribute, the text is summary or content.
ATOM_ENTRY = T.StructType([
    T.StructField("title", S),
    T.StructField("link", T.ArrayType(T.StructType([T.StructField("_href", S), T.StructField("_rel", S)]))),
    T.StructField("summary", S), T.StructField("content", S),
    T.StructField("published", S), T.StructField("updated", S),
])

# The stored article table.  ``article_id`` names a row for good (community,
# blog, run and position in the run): joins, windows and marks use it.  Stored
# order is (published_at, run, seq, article_id); ``seq`` alone names nothing.
ARTICLE = T.StructType([
    T.StructField("article_id", S), T.StructField("community", S), T.StructField("blog_name", S),
    T.StructField("url", S), T.StructField("title", S), T.StructField("description", S),
    T.StructField("date_published", S), T.StructField("published_at", TS),
    T.StructField("posted", B), T.StructField("run", S), T.StructField("seq", L),
])
STORED_ORDER = ("published_at", "run", "seq", "article_id")

PAGE = T.StructType([T.StructField("url", S), T.StructField("html", S)])

FEED_CATALOG = T.StructType([
    T.StructField("feed_url", S), T.StructField("type", S),
    T.StructField("file", S), T.StructField("enabled", B),
])
