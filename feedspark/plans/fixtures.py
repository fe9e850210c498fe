"""Test inputs derived from the supplied tables, side by side in Spark and in
DuckDB SQL (FIXTURES.md).  Every fixture reads whole tables; nothing is
sampled or capped.

- ``dated``: each document gets one event (its timestamp and value).
- ``articles``: the stored article table (ARTICLE schema).
- ``feed_entries``: blog feed entries with HTML descriptions and twelve date
  styles, some of them no date.
- ``tracker``: one tracker row per blog, watermark 2024-01-15.
- ``bill_items``: bill feed items of three types, linked to pages.
- ``pages_rich`` / ``summary_pages`` / ``explainer_pages``: pages with the
  element ids the bill enrichment reads, holding known values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark import config
from feedspark.functions.dates import iso_date
from feedspark.functions.text import clean_url
from feedspark.operators.collect import article_key
from feedspark.schemas import ARTICLE
from feedspark.session import ensure_utc

WATERMARK = "2024-01-15"
RUN_DATE = "2024-02-01"
FEED_SITE = ".example.org"
COMMUNITY = "dnd"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_utc(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _community(lang: Column) -> Column:
    return (F.when(lang == "en", "dnd").when(lang == "de", "nfl")
            .when(lang == "fr", "science").otherwise("politics"))


def dated(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    ev = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    n = ev.select(F.count(F.lit(1))).scalar()
    # The event is found for the id alone, so that the text moves once, by doc_id
    # (further joins on doc_id find it dealt so), and no sort holds it: hashes are
    # built of the narrow sides.
    keyed = docs.select("doc_id").distinct().withColumn("_k", (F.col("doc_id") * 4999) % n)
    return docs.join(keyed.join(ev, keyed["_k"] == ev["event_id"], "inner").drop("_k", "event_id").hint("shuffle_hash"), "doc_id")


def _post_url(source: Column, doc_id: Column) -> Column:
    return F.concat(F.lit("https://"), source, F.lit(FEED_SITE + "/p/"), doc_id.cast("string"))


def _feed_url(source: Column) -> Column:
    return F.concat(F.lit("https://"), source, F.lit(FEED_SITE + "/feed"))


def _first_line(text: Column) -> Column:
    return F.split_part(text, F.lit("\n"), F.lit(1))


def articles(spark, sf_dir) -> DataFrame:
    d = dated(spark, sf_dir)
    p = table(spark, sf_dir, "pages").select("page_id", "url").hint("shuffle_hash")
    j = d.join(p, d["doc_id"] == p["page_id"], "left")
    return j.select(
        F.col("doc_id").cast("bigint").alias("seq"),
        _community(F.col("lang")).alias("community"),
        F.col("source").alias("blog_name"),
        F.coalesce(F.col("url"), _post_url(F.col("source"), F.col("doc_id"))).alias("url"),
        _first_line(F.col("text")).alias("title"),
        F.col("text").alias("description"),
        iso_date(F.col("ts")).alias("date_published"),
        F.col("ts").alias("published_at"),
        (F.col("value") < 20).alias("posted"), F.lit("").alias("run"),
    ).withColumn("article_id", article_key("community", "blog_name", "run", "seq")).select(*ARTICLE.fieldNames())


def feed_entries(spark, sf_dir) -> DataFrame:
    d = dated(spark, sf_dir)
    f = lambda pattern, tail="": F.concat(F.date_format("ts", pattern), F.lit(tail))
    rfc, iso = "EEE, dd MMM yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss"
    styles = [f(iso, "Z"), f(rfc, " +0000"), f(rfc, " -0400"), f(rfc, " GMT"), f("d MMM yyyy hh:mm:ss a"),
              f("EEE, d MMM yy HH:mm:ss", " +0000"), f("EEE MMM d HH:mm:ss yyyy"), f("EEEE, dd-MMM-yy HH:mm:ss", " GMT"),
              f("MM/dd/yyyy HH:mm:ss"), f("yyyyMMdd"), f(iso, "+02"),
              F.when(F.col("doc_id") % 24 == 11, F.lit("soon")).otherwise(f(iso, ".123456789Z"))]
    published = F.coalesce(*[F.when(F.col("doc_id") % len(styles) == i, x) for i, x in enumerate(styles)])
    link = F.concat(_post_url(F.col("source"), F.col("doc_id")),
                    F.when(F.col("doc_id") % 2 == 0, F.lit("?utm_source=feed")).otherwise(F.lit("")))
    desc = F.concat(F.lit("<p>"), F.col("text"), F.lit(" &amp;  <b>"), F.col("source"),
                    F.lit("</b> &lt;i&gt;&amp;nbsp;x</p> "))
    return d.select(
        F.col("doc_id"), F.col("doc_id").alias("entry_id"),
        _feed_url(F.col("source")).alias("feed_url"),
        link.alias("link"), _first_line(F.col("text")).alias("title"),
        desc.alias("description"), published.alias("published"))


def tracker(spark, sf_dir) -> DataFrame:
    src = table(spark, sf_dir, "documents").select("source").distinct()
    return src.select(
        F.lit(COMMUNITY).alias("community"), F.lit(WATERMARK).alias("last_fetched"),
        F.array(F.struct(F.col("source").alias("blog_name"),
                         _feed_url(F.col("source")).alias("rss_url"))).alias("blogs"))


def catalog_url(kind: str) -> str:
    return next(f.feed_url for f in config.BILL_FEEDS if f.type == kind)


def bill_items(spark, sf_dir) -> DataFrame:
    d = dated(spark, sf_dir)
    p = table(spark, sf_dir, "pages").select("page_id", "url").hint("shuffle_hash")
    j = d.join(p, d["doc_id"] == p["page_id"], "left")
    k = F.col("doc_id") % 3
    odd = F.col("doc_id") % 2 == 1
    s1 = F.split_part(F.col("text"), F.lit("."), F.lit(1))
    s2 = F.split_part(F.col("text"), F.lit("."), F.lit(2))
    activity = F.when(odd & (F.col("doc_id") % 9 == 3),
                      F.concat(F.lit("Explanation: "), s2, F.lit(" Last Action: "), s1)) \
        .otherwise(F.concat(F.lit("Last Action: "), s1, F.lit(" Explanation: "), s2))
    votes = F.concat(F.lit("On passage. Vote: Passed "), (F.col("doc_id") % 400).cast("string"), F.lit("/"),
                     (F.col("doc_id") % 35).cast("string"),
                     F.when(odd, F.lit(" Vote: recount")).otherwise(F.lit("")))
    desc = F.when(k == 0, activity).when(k == 1, votes).otherwise(_first_line(F.col("text")))
    feed = (F.when(k == 0, F.lit(catalog_url("Activity"))).when(k == 1, F.lit(catalog_url("Votes")))
            .otherwise(F.lit(catalog_url("New"))))
    rfc = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss")
    pub = F.concat(rfc, F.when(F.col("doc_id") % 2 == 0, F.lit(" +0000")).otherwise(F.lit(" -0500")))
    link = F.coalesce(F.col("url"), F.concat(F.lit("https://none.example.org/"),
                                             F.col("doc_id").cast("string"), F.lit("?x=1")))
    return j.select(F.col("doc_id").cast("bigint").alias("seq"), feed.alias("feed_url"),
                    _first_line(F.col("text")).alias("title"), link.alias("link"),
                    desc.alias("description"), pub.alias("pubDate"))


def pages_rich(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    pid = F.col("page_id").cast("string")
    meta = (F.when(F.col("page_id") % 3 == 0,
                   F.concat(F.lit('<head><meta name="description" content="page '), pid, F.lit('">')))
            .when(F.col("page_id") % 3 == 1,
                  F.concat(F.lit('<head><meta property="og:description" content="og '), pid, F.lit('">')))
            .otherwise(F.lit("<head>")))
    block = F.concat(
        F.lit("<header><p>Header words that must be dropped here "), pid, F.lit("</p></header>"),
        F.lit('<div id="content"><p>Overview of page '), pid, F.lit("</p>"),
        F.lit('<div id="libraryofcongress"><p>Part one '), pid, F.lit("</p><p>Part two</p></div>"),
        F.lit('<div id="vote_explainer"><a href="/explain/'), pid, F.lit('">why</a></div></div><article>'))
    html = F.replace(F.replace(F.col("html"), F.lit("<head>"), meta), F.lit("<article>"), block)
    return p.select("page_id", "url", html.alias("html"))


def summary_pages(spark, sf_dir) -> DataFrame:
    r = pages_rich(spark, sf_dir)
    return r.select("page_id", F.concat(clean_url(F.col("url")), F.lit("/summary")).alias("url"), "html")


def explainer_pages(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id")
    pid = F.col("page_id").cast("string")
    return p.select("page_id",
                    F.concat(F.lit(config.BILL_SITE + "/explain/"), pid).alias("url"),
                    F.concat(F.lit('<div id="content"><p>Explainer '), pid, F.lit("</p></div>")).alias("html"))


def bill_pages(spark, sf_dir) -> DataFrame:
    """All pages the bill job can reach: item pages, summaries, explainers."""
    return (pages_rich(spark, sf_dir).select("url", "html")
            .unionByName(summary_pages(spark, sf_dir).select("url", "html"))
            .unionByName(explainer_pages(spark, sf_dir).select("url", "html")))


# --------------------------------------------------------------------------
# The same views in DuckDB SQL (the oracle).  Tables are pre-registered.
# --------------------------------------------------------------------------

def _cat(kind):
    return "'" + catalog_url(kind) + "'"


DUCK_VIEWS = {
    "dated_v": """
SELECT d.doc_id, d.lang, d.source, d.text, CAST(e.ts AS TIMESTAMP) AS ts, e.value
FROM documents d JOIN events e ON e.event_id = (d.doc_id * 4999) % (SELECT count(*) FROM events)""",
    "articles_v": f"""
SELECT CAST(d.doc_id AS BIGINT) AS seq,
  CASE d.lang WHEN 'en' THEN 'dnd' WHEN 'de' THEN 'nfl' WHEN 'fr' THEN 'science' ELSE 'politics' END AS community,
  d.source AS blog_name,
  coalesce(p.url, 'https://' || d.source || '{FEED_SITE}/p/' || d.doc_id) AS url,
  split_part(d.text, chr(10), 1) AS title, d.text AS description,
  strftime(d.ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(d.ts) % 1000000 <> 0
     THEN '.' || lpad(CAST(epoch_us(d.ts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00' AS date_published,
  d.ts AS published_at, d.value < 20 AS posted,
  CASE d.lang WHEN 'en' THEN 'dnd' WHEN 'de' THEN 'nfl' WHEN 'fr' THEN 'science' ELSE 'politics' END || '|' || d.source || '||' || d.doc_id AS article_id
FROM dated_v d LEFT JOIN pages p ON p.page_id = d.doc_id""",
    "feed_v": f"""
SELECT d.doc_id, d.source, d.ts, d.text,
  'https://' || d.source || '{FEED_SITE}/feed' AS feed_url,
  'https://' || d.source || '{FEED_SITE}/p/' || d.doc_id || CASE WHEN d.doc_id % 2 = 0 THEN '?utm_source=feed' ELSE '' END AS link,
  split_part(d.text, chr(10), 1) AS title,
  '<p>' || d.text || ' &amp;  <b>' || d.source || '</b> &lt;i&gt;&amp;nbsp;x</p> ' AS description,
  CASE d.doc_id % 12 WHEN 0 THEN strftime(d.ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
    WHEN 1 THEN strftime(d.ts, '%a, %d %b %Y %H:%M:%S') || ' +0000'
    WHEN 2 THEN strftime(d.ts, '%a, %d %b %Y %H:%M:%S') || ' -0400'
    WHEN 3 THEN strftime(d.ts, '%a, %d %b %Y %H:%M:%S') || ' GMT'
    WHEN 4 THEN strftime(d.ts, '%-d %b %Y %I:%M:%S %p')
    WHEN 5 THEN strftime(d.ts, '%a, %-d %b %y %H:%M:%S') || ' +0000'
    WHEN 6 THEN strftime(d.ts, '%a %b %-d %H:%M:%S %Y')
    WHEN 7 THEN strftime(d.ts, '%A, %d-%b-%y %H:%M:%S') || ' GMT'
    WHEN 8 THEN strftime(d.ts, '%m/%d/%Y %H:%M:%S')
    WHEN 9 THEN strftime(d.ts, '%Y%m%d')
    WHEN 10 THEN strftime(d.ts, '%Y-%m-%dT%H:%M:%S') || '+02'
    ELSE CASE WHEN d.doc_id % 24 = 11 THEN 'soon' ELSE strftime(d.ts, '%Y-%m-%dT%H:%M:%S') || '.123456789Z' END END AS published,
  CASE WHEN d.doc_id % 24 = 11 THEN NULL WHEN d.doc_id % 12 = 9 THEN date_trunc('day', d.ts)
    WHEN d.doc_id % 12 = 11 THEN date_trunc('second', d.ts) + INTERVAL 123456 MICROSECOND
    ELSE date_trunc('second', d.ts) - to_hours(CASE d.doc_id % 12 WHEN 2 THEN -4 WHEN 10 THEN 2 ELSE 0 END) END AS exp_ts,
  CASE d.doc_id % 12 WHEN 2 THEN -240 WHEN 10 THEN 120 ELSE 0 END AS exp_off,
  CASE WHEN d.doc_id % 24 = 11 THEN NULL WHEN d.doc_id % 12 = 9 THEN strftime(d.ts, '%Y-%m-%dT00:00:00+00:00')
    ELSE strftime(date_trunc('second', d.ts), '%Y-%m-%dT%H:%M:%S') || CASE d.doc_id % 12 WHEN 11 THEN '.123456' ELSE '' END
      || CASE d.doc_id % 12 WHEN 2 THEN '-04:00' WHEN 10 THEN '+02:00' ELSE '+00:00' END END AS exp_iso,
  d.doc_id % 12 IN (1, 2, 3, 5, 6, 7) AND strftime(d.ts, '%a') IN ('Tue', 'Thu') AS compat_skip
FROM dated_v d""",
    "tracker_v": f"""
SELECT DISTINCT '{COMMUNITY}' AS community, source AS blog_name,
  'https://' || source || '{FEED_SITE}/feed' AS rss_url, '{WATERMARK}' AS last_fetched
FROM documents""",
    "bills_v": f"""
SELECT CAST(d.doc_id AS BIGINT) AS seq, p.page_id AS page_id,
  CASE d.doc_id % 3 WHEN 0 THEN {_cat('Activity')} WHEN 1 THEN {_cat('Votes')} ELSE {_cat('New')} END AS feed_url,
  CASE d.doc_id % 3 WHEN 0 THEN 'Activity' WHEN 1 THEN 'Votes' ELSE 'New' END AS type,
  split_part(d.text, chr(10), 1) AS title,
  coalesce(p.url, 'https://none.example.org/' || d.doc_id || '?x=1') AS link,
  CASE d.doc_id % 3
    WHEN 0 THEN CASE WHEN d.doc_id % 2 = 1 AND d.doc_id % 9 = 3
                     THEN 'Explanation: ' || split_part(d.text, '.', 2) || ' Last Action: ' || split_part(d.text, '.', 1)
                     ELSE 'Last Action: ' || split_part(d.text, '.', 1) || ' Explanation: ' || split_part(d.text, '.', 2) END
    WHEN 1 THEN 'On passage. Vote: Passed ' || (d.doc_id % 400) || '/' || (d.doc_id % 35)
                || CASE WHEN d.doc_id % 2 = 1 THEN ' Vote: recount' ELSE '' END
    ELSE split_part(d.text, chr(10), 1) END AS description,
  strftime(d.ts, '%a, %d %b %Y %H:%M:%S') || CASE WHEN d.doc_id % 2 = 0 THEN ' +0000' ELSE ' -0500' END AS pubDate,
  date_trunc('second', d.ts) AS wall_ts,
  CASE WHEN d.doc_id % 2 = 0 THEN 0 ELSE -300 END AS off_min
FROM dated_v d LEFT JOIN pages p ON p.page_id = d.doc_id""",
}

# Dependencies between the views, for building WITH clauses.
DUCK_DEPS = {
    "dated_v": (), "articles_v": ("dated_v",), "feed_v": ("dated_v",), "tracker_v": (),
    "bills_v": ("dated_v",),
}


def duck_with(*views: str, extra: dict | None = None) -> str:
    """WITH clause holding the named views and their dependencies, in order."""
    extra = extra or {}
    deps = dict(DUCK_DEPS)
    defs = dict(DUCK_VIEWS)
    for k, (sql, dep) in extra.items():
        defs[k] = sql
        deps[k] = dep
    order: list[str] = []

    def visit(v):
        for d in deps[v]:
            visit(d)
        if v not in order:
            order.append(v)

    for v in views:
        visit(v)
    return "WITH " + ",\n".join(f"{v} AS ({defs[v]})" for v in order) + "\n"
