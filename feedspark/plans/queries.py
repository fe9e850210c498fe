"""Query registry: one entry per operator of SURVEY §2, each a Spark job over
whole fixture tables, with its DuckDB oracle where SQL can state it.

Outputs hold scalar columns only (arrays are flattened or joined), integer
columns are BIGINT, timestamps are formatted strings and scores are rounded,
so that Spark and DuckDB results can be hashed and compared.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedspark import config
from feedspark.functions import dates as D
from feedspark.functions import html as H
from feedspark.functions import text as T
from feedspark.functions.udfs import unescape_html
from feedspark.operators import bills as B
from feedspark.operators import collect as C
from feedspark.operators import pages as P
from feedspark.operators import queue as Q
from feedspark.operators import rank as R
from feedspark.operators import summarize as U
from feedspark.plans import fixtures as fx
from feedspark.plans import sqlfns as s
from feedspark.plans.fixtures import RUN_DATE, WATERMARK, duck_with
from feedspark.session import scratch_path, settle
from feedspark.sources import readers, sinks

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def big(col):
    return F.col(col).cast("bigint") if isinstance(col, str) else col.cast("bigint")


WM_SQL = f"TIMESTAMP '{WATERMARK} 00:00:00'"

# ============================================================ S: sources


@register("scan_feed_items", duck_with("feed_v") + "SELECT title, link, description, published AS pubDate FROM feed_v")
def scan_feed_items(spark, d):
    path = scratch_path(spark, "rss")
    e = fx.feed_entries(spark, d).select("title", "link", "description", F.col("published").alias("pubDate"))
    e.write.format("xml").option("rootTag", "rss").option("rowTag", "item").save(path)
    return readers.read_feed_items(spark, path).select("title", "link", "description", "pubDate")


@register("scan_atom_entries", duck_with("feed_v") + "SELECT title, link, description, published AS pubDate FROM feed_v")
def scan_atom_entries(spark, d):
    path = scratch_path(spark, "atom")
    links = F.array(F.struct(F.lit("https://example.org/self").alias("_href"), F.lit("self").alias("_rel")),
                    F.struct(F.col("link").alias("_href"), F.lit("alternate").alias("_rel")))
    odd = F.col("doc_id") % 2 == 1
    e = fx.feed_entries(spark, d).select(
        "title", links.alias("link"), F.when(odd, F.col("description")).alias("summary"), F.when(~odd, F.col("description")).alias("content"),
        F.when(odd, F.col("published")).alias("published"), F.when(~odd, F.col("published")).alias("updated"))
    e.write.format("xml").option("rootTag", "feed").option("rowTag", "entry").save(path)
    return readers.read_atom_entries(spark, path).select("title", "link", "description", "pubDate")


@register("scan_tracker", duck_with("tracker_v") +
          "SELECT community, blog_name, rss_url, last_fetched FROM tracker_v")
def scan_tracker(spark, d):
    path = sinks.write_tracker(fx.tracker(spark, d), scratch_path(spark, "tracker"))
    return C.explode_feeds(readers.read_tracker(spark, path))


ARTICLE_COLS = ["article_id", "community", "blog_name", "url", "title", "description", "date_published", "posted", "seq"]


@register("scan_articles", duck_with("articles_v") + f"SELECT {', '.join(ARTICLE_COLS)} FROM articles_v")
def scan_articles(spark, d):
    path = sinks.write_articles(fx.articles(spark, d), scratch_path(spark, "articles"), fmt="json")
    return readers.read_articles(spark, path, "json-lines").select(*ARTICLE_COLS)


@register("scan_pages", "SELECT CAST(page_id AS BIGINT) AS page_id, url, html FROM pages")
def scan_pages(spark, d):
    return fx.table(spark, d, "pages").select(big("page_id").alias("page_id"), "url", "html")


CATALOG_SQL = ("SELECT * FROM (VALUES " + ", ".join(
    f"({s.q(f.feed_url)}, {s.q(f.type)}, {s.q(f.file)}, {'TRUE' if f.enabled else 'FALSE'})"
    for f in config.BILL_FEEDS) + ") AS t(feed_url, type, file, enabled)")


@register("feed_catalog", duck_with("bills_v", "cat_v", extra={"cat_v": (CATALOG_SQL, ())}) +
          "SELECT c.feed_url, c.type, c.file, c.enabled, count(*) AS n_items "
          "FROM bills_v b JOIN cat_v c ON b.feed_url = c.feed_url GROUP BY ALL")
def feed_catalog(spark, d):
    counts = fx.bill_items(spark, d).groupBy("feed_url").agg(F.count(F.lit(1)).alias("n_items"))
    return counts.join(F.broadcast(B.feed_catalog(spark)), "feed_url").select(
        "feed_url", "type", "file", "enabled", "n_items")


# ============================================================ collection

def _collect(spark, d, compat=False, once=False):
    return C.collect_batch(fx.tracker(spark, d), fx.feed_entries(spark, d), fx.articles(spark, d),
                           run_date=RUN_DATE, compat=compat, once=once)


KEY_SQL = f"'dnd|' || source || '|{RUN_DATE}|' || doc_id"
NEW_ROWS_SQL = (
    f"SELECT 'dnd' AS community, source AS blog_name, link AS url, title, {s.clean_desc('description')} AS description, "
    f"exp_iso AS date_published, FALSE AS posted, {KEY_SQL} AS article_id FROM feed_v WHERE exp_ts > {WM_SQL}")
OUT_COLS = ["community", "blog_name", "url", "title", "description", "date_published", "posted", "article_id"]
OLD_ROWS_SQL = f"SELECT {', '.join(OUT_COLS)} FROM articles_v"
ALL_ROWS_SQL = duck_with("articles_v", "feed_v") + OLD_ROWS_SQL + " UNION ALL " + NEW_ROWS_SQL


@register("collect_batch", ALL_ROWS_SQL)
def collect_batch(spark, d):
    return _collect(spark, d, once=True).articles.select(*OUT_COLS)


def with_position(ordered: DataFrame) -> DataFrame:
    """``ordered`` with each row's position (from 0): rows are numbered within
    their partition, partitions by their counts (one row each)."""
    rows = settle(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part, here = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.withColumn("_part", part).join(before, "_part").withColumn("position", F.col("_before") + here).drop("_part", "_at", "_before")


@register("articles_by_date", duck_with("articles_v", "feed_v") + f"""
SELECT community, url, article_id, date_published, row_number() OVER (ORDER BY ts, run, seq, article_id) - 1 AS position FROM (
SELECT community, url, article_id, date_published, published_at AS ts, '' AS run, seq FROM articles_v UNION ALL
SELECT 'dnd', link, {KEY_SQL}, exp_iso, exp_ts, '{RUN_DATE}', doc_id FROM feed_v WHERE exp_ts > {WM_SQL})""")
def articles_by_date(spark, d):
    return with_position(_collect(spark, d).articles.select("community", "url", "article_id", "date_published"))


@register("append_articles", duck_with("articles_v", "feed_v") +
          "SELECT community, blog_name, url, date_published, posted, article_id, FALSE AS is_new FROM articles_v UNION ALL "
          f"SELECT 'dnd', source, link, exp_iso, FALSE, {KEY_SQL}, TRUE FROM feed_v WHERE exp_ts > {WM_SQL}")
def append_articles(spark, d):
    feeds = C.explode_feeds(fx.tracker(spark, d))
    new = C.to_articles(C.since_watermark(C.dated_entries(C.entries_with_feed(fx.feed_entries(spark, d), feeds))))
    return C.append_articles(fx.articles(spark, d), new, RUN_DATE).select(
        "community", "blog_name", "url", "date_published", "posted", "article_id", (F.col("run") == RUN_DATE).alias("is_new"))


@register("collect_rejects", duck_with("feed_v") +
          "SELECT 'dnd' AS community, source AS blog_name, feed_url, link, title, published, 'date' AS reason FROM feed_v WHERE exp_ts IS NULL "
          "AND source <> 'src3' UNION ALL "
          "SELECT NULL, NULL, feed_url, link, title, published, 'feed' FROM feed_v WHERE source = 'src3'")
def collect_rejects(spark, d):
    """The feed of one source is tracked by no blog in this run."""
    tracker = fx.tracker(spark, d).where(F.col("blogs")[0]["blog_name"] != "src3")
    r = C.collect_batch(tracker, fx.feed_entries(spark, d), fx.articles(spark, d), run_date=RUN_DATE)
    return r.rejects.select("community", "blog_name", "feed_url", "link", "title", "published", "reason")


@register("explode_feeds", duck_with("feed_v", "tracker_v") +
          "SELECT CAST(f.doc_id AS BIGINT) AS doc_id, t.community, t.blog_name, t.rss_url, f.link "
          "FROM feed_v f JOIN tracker_v t ON f.feed_url = t.rss_url")
def explode_feeds(spark, d):
    e = C.entries_with_feed(fx.feed_entries(spark, d), C.explode_feeds(fx.tracker(spark, d)))
    return e.select(big("doc_id").alias("doc_id"), "community", "blog_name", F.col("feed_url").alias("rss_url"), "link")


@register("to_articles", duck_with("feed_v") +
          f"SELECT 'dnd' AS community, source AS blog_name, link AS url, title, {s.clean_desc('description')} AS description, "
          f"exp_iso AS date_published, FALSE AS posted FROM feed_v WHERE exp_ts > {WM_SQL}")
def to_articles(spark, d):
    return _collect(spark, d).new_articles.select(*OUT_COLS[:-1])


@register("new_article_count", duck_with("feed_v") +
          f"SELECT 'dnd' AS community, source AS blog_name, count(*) AS n_new FROM feed_v WHERE exp_ts > {WM_SQL} GROUP BY ALL")
def new_article_count(spark, d):
    return C.new_article_count(_collect(spark, d).new_articles)


@register("late_entries", duck_with("feed_v") +
          f"SELECT 'dnd' AS community, source AS blog_name, count(*) AS n_late FROM feed_v WHERE exp_ts <= {WM_SQL} GROUP BY ALL")
def late_entries(spark, d):
    return _collect(spark, d).late


@register("filter_dated", duck_with("feed_v") +
          "SELECT CAST(doc_id AS BIGINT) AS doc_id, CASE WHEN contains(published, 'T') THEN split_part(published, 'T', 1) "
          "ELSE published END AS date_token FROM feed_v WHERE NOT compat_skip")
def filter_dated(spark, d):
    e = C.dated_entries(fx.feed_entries(spark, d), compat=True)
    return e.select(big("doc_id").alias("doc_id"), "date_token")


@register("since_watermark", duck_with("feed_v") +
          f"SELECT CAST(doc_id AS BIGINT) AS doc_id, exp_iso AS date_published FROM feed_v WHERE exp_ts > {WM_SQL}")
def since_watermark(spark, d):
    e = C.since_watermark(C.dated_entries(fx.feed_entries(spark, d)), F.lit(WATERMARK))
    return e.select(big("doc_id").alias("doc_id"), "date_published")


@register("write_articles", ALL_ROWS_SQL)
def write_articles(spark, d):
    root = scratch_path(spark, "articles")
    sinks.write_articles(_collect(spark, d).articles, root)
    return readers.read_articles(spark, sinks.current_path(spark, root)).select(*OUT_COLS)


@register("write_tracker", duck_with("tracker_v") +
          f"SELECT community, blog_name, rss_url, '{RUN_DATE}' AS last_fetched FROM tracker_v")
def write_tracker(spark, d):
    root = scratch_path(spark, "tracker")
    sinks.write_tracker(_collect(spark, d).tracker, root)
    path = sinks.current_path(spark, root)
    return C.explode_feeds(readers.read_tracker(spark, path))


# ============================================================ dates

@register("date_token", duck_with("feed_v") +
          "SELECT CAST(doc_id AS BIGINT) AS doc_id, CASE WHEN contains(published, 'T') THEN split_part(published, 'T', 1) "
          "ELSE published END AS date_token FROM feed_v")
def date_token(spark, d):
    return fx.feed_entries(spark, d).select(big("doc_id").alias("doc_id"), D.date_token(F.col("published")).alias("date_token"))


@register("parse_published", duck_with("feed_v") +
          "SELECT CAST(doc_id AS BIGINT) AS doc_id, strftime(exp_ts, '%Y-%m-%d %H:%M:%S') AS published_utc, "
          "CAST(exp_off AS BIGINT) AS offset_min FROM feed_v")
def parse_published(spark, d):
    p = D.parse_published(F.col("published"))
    return fx.feed_entries(spark, d).select(
        big("doc_id").alias("doc_id"), F.date_format(p["published_at"], "yyyy-MM-dd HH:mm:ss").alias("published_utc"),
        p["offset_min"].cast("bigint").alias("offset_min"))


@register("iso_date", duck_with("feed_v") +
          "SELECT CAST(doc_id AS BIGINT) AS doc_id, exp_iso AS date_published FROM feed_v")
def iso_date(spark, d):
    p = D.parse_published(F.col("published"))
    return fx.feed_entries(spark, d).select(big("doc_id").alias("doc_id"),
                                            D.iso_date(p["published_at"], p["offset_min"]).alias("date_published"))


BILL_INSTANT = "(wall_ts - to_minutes(CAST(off_min AS BIGINT)))"


@register("parse_pub_date", duck_with("bills_v") +
          f"SELECT seq, strftime({BILL_INSTANT}, '%Y-%m-%d %H:%M:%S') AS published_utc, "
          "CAST(off_min AS BIGINT) AS offset_min FROM bills_v")
def parse_pub_date(spark, d):
    p = D.parse_pub_date(F.col("pubDate"))
    return fx.bill_items(spark, d).select(
        "seq", F.date_format(p["published_at"], "yyyy-MM-dd HH:mm:ss").alias("published_utc"),
        p["offset_min"].cast("bigint").alias("offset_min"))


@register("format_pub_date", duck_with("bills_v") +
          "SELECT seq, strftime(wall_ts, '%Y-%m-%d %H:%M:%S') AS pub_date FROM bills_v")
def format_pub_date(spark, d):
    p = D.parse_pub_date(F.col("pubDate"))
    return fx.bill_items(spark, d).select("seq", D.format_pub_date(p["published_at"], p["offset_min"]).alias("pub_date"))


@register("format_rfc822", duck_with("bills_v") +
          "SELECT seq, strftime(wall_ts, '%a, %d %b %Y %H:%M:%S') || CASE WHEN off_min = 0 THEN ' +0000' ELSE ' -0500' END "
          "AS pub_date_rfc822 FROM bills_v")
def format_rfc822(spark, d):
    return B.pub_date_rfc822(fx.bill_items(spark, d))


@register("watermark_ts", duck_with("tracker_v") +
          f"SELECT blog_name, '{WATERMARK} 00:00:00' AS watermark FROM tracker_v")
def watermark_ts(spark, d):
    f = C.explode_feeds(fx.tracker(spark, d))
    return f.select("blog_name", F.date_format(D.watermark_ts(F.col("last_fetched")), "yyyy-MM-dd HH:mm:ss").alias("watermark"))


# ============================================================ description text

def _feed_desc(spark, d):
    return fx.feed_entries(spark, d).select(big("doc_id").alias("doc_id"), "description")


T1_SQL = s.strip_tags("description")
T2_SQL = s.unescape(T1_SQL)
T3_SQL = f"replace({T2_SQL}, '&nbsp;', ' ')"
T4_SQL = f"regexp_replace({T3_SQL}, ' +', ' ', 'g')"


@register("strip_tags", duck_with("feed_v") + f"SELECT CAST(doc_id AS BIGINT) AS doc_id, {T1_SQL} AS s FROM feed_v")
def strip_tags(spark, d):
    return _feed_desc(spark, d).select("doc_id", T.strip_tags("description").alias("s"))


@register("unescape_entities", duck_with("feed_v") + f"SELECT CAST(doc_id AS BIGINT) AS doc_id, {T2_SQL} AS s FROM feed_v")
def unescape_entities(spark, d):
    return _feed_desc(spark, d).select("doc_id", unescape_html(T.strip_tags("description")).alias("s"))


@register("nbsp_to_space", duck_with("feed_v") + f"SELECT CAST(doc_id AS BIGINT) AS doc_id, {T3_SQL} AS s FROM feed_v")
def nbsp_to_space(spark, d):
    return _feed_desc(spark, d).select("doc_id", T.nbsp_to_space(unescape_html(T.strip_tags("description"))).alias("s"))


@register("collapse_spaces", duck_with("feed_v") + f"SELECT CAST(doc_id AS BIGINT) AS doc_id, {T4_SQL} AS s FROM feed_v")
def collapse_spaces(spark, d):
    c = T.collapse_spaces(T.nbsp_to_space(unescape_html(T.strip_tags("description"))))
    return _feed_desc(spark, d).select("doc_id", c.alias("s"))


@register("py_strip", duck_with("feed_v") + f"SELECT CAST(doc_id AS BIGINT) AS doc_id, {s.strip(T4_SQL)} AS s FROM feed_v")
def py_strip(spark, d):
    c = T.py_strip(T.collapse_spaces(T.nbsp_to_space(unescape_html(T.strip_tags("description")))))
    return _feed_desc(spark, d).select("doc_id", c.alias("s"))


@register("clean_description", duck_with("feed_v") +
          f"SELECT CAST(doc_id AS BIGINT) AS doc_id, {s.clean_desc('description')} AS s FROM feed_v")
def clean_description(spark, d):
    return _feed_desc(spark, d).select("doc_id", T.clean_description("description").alias("s"))


# ============================================================ queue

@register("unposted", duck_with("articles_v") + "SELECT seq, community FROM articles_v WHERE NOT posted")
def unposted(spark, d):
    return Q.unposted(fx.articles(spark, d)).select("seq", "community")


NEXT_SQL = ("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY published_at, seq, article_id) AS queue_pos "
            "FROM articles_v WHERE NOT posted) WHERE queue_pos <= {n}")


@register("next_to_post", duck_with("articles_v") +
          f"SELECT community, seq, url, title FROM ({NEXT_SQL.format(n=1)})")
def next_to_post(spark, d):
    return Q.next_to_post(fx.articles(spark, d)).select("community", "seq", "url", "title")


@register("one_per_run", duck_with("articles_v") +
          f"SELECT community, seq, CAST(queue_pos AS BIGINT) AS queue_pos FROM ({NEXT_SQL.format(n=3)})")
def one_per_run(spark, d):
    return Q.next_to_post(fx.articles(spark, d), n=3).select("community", "seq", big("queue_pos").alias("queue_pos"))


@register("single_line_description", duck_with("articles_v") +
          f"SELECT seq, {s.single_line('description')} AS line FROM articles_v")
def single_line_description(spark, d):
    return fx.articles(spark, d).select("seq", T.single_line_description("description").alias("line"))


def _render_sql(src: str) -> str:
    footer = s.q(config.DEFAULT_FOOTER)
    desc = s.single_line("description")
    linked = (f"'[Read full post by ' || blog_name || '](' || url || ')' || chr(10) || chr(10) || '-----' || chr(10) || chr(10) "
              f"|| {desc} || chr(10) || chr(10) || '-----' || chr(10) || ' ' || chr(10) || {footer}")
    return (f"SELECT community, CASE community WHEN 'dnd' THEN '[Blog] ' || title WHEN 'nfl' THEN '[' || blog_name || '] ' || title "
            f"ELSE title END AS title, CASE community WHEN 'dnd' THEN {linked} WHEN 'nfl' THEN {linked} "
            f"WHEN 'politics' THEN url || chr(10) || chr(10) || {desc} ELSE url END AS content, url FROM ({src})")


@register("render_posts", duck_with("articles_v") + _render_sql(NEXT_SQL.format(n=1)))
def render_posts(spark, d):
    return Q.render_posts(Q.next_to_post(fx.articles(spark, d))).select("community", "title", "content", "url")


@register("write_outbox", duck_with("articles_v") + _render_sql(NEXT_SQL.format(n=1)))
def write_outbox(spark, d):
    root = scratch_path(spark, "outbox")
    sinks.write_outbox(Q.render_posts(Q.next_to_post(fx.articles(spark, d))), root)
    return spark.read.parquet(root).select("community", "title", "content", "url")


@register("mark_posted", duck_with("articles_v") +
          f"SELECT article_id, posted OR article_id IN (SELECT article_id FROM ({NEXT_SQL.format(n=1)})) AS posted FROM articles_v")
def mark_posted(spark, d):
    a = fx.articles(spark, d)
    return Q.mark_posted(a, Q.next_to_post(a)).select("article_id", "posted")


# ============================================================ bills

PAGES_RICH_SQL = """
SELECT page_id, url,
 replace(replace(html, '<head>', CASE page_id % 3
   WHEN 0 THEN '<head><meta name="description" content="page ' || page_id || '">'
   WHEN 1 THEN '<head><meta property="og:description" content="og ' || page_id || '">'
   ELSE '<head>' END),
 '<article>', '<header><p>Header words that must be dropped here ' || page_id || '</p></header>'
   || '<div id="content"><p>Overview of page ' || page_id || '</p>'
   || '<div id="libraryofcongress"><p>Part one ' || page_id || '</p><p>Part two</p></div>'
   || '<div id="vote_explainer"><a href="/explain/' || page_id || '">why</a></div></div><article>') AS html
FROM pages"""
BILL_EXTRA = {
    "pages_rich_v": (PAGES_RICH_SQL, ()),
    # the summary page of each cleaned URL: smallest MD5 of its HTML wins
    "sum_pick_v": (f"SELECT cu || '/summary' AS url, arg_min(page_id, md5(html)) AS sum_pid FROM "
                   f"(SELECT page_id, {s.clean_url('url')} AS cu, html FROM pages_rich_v) GROUP BY ALL", ("pages_rich_v",)),
    "bills_sv": (f"SELECT b.*, sp.sum_pid FROM bills_v b LEFT JOIN sum_pick_v sp ON sp.url = {s.clean_url('b.link')} || '/summary'",
                 ("bills_v", "sum_pick_v")),
}


def bills_with(*views):
    return duck_with(*views, extra=BILL_EXTRA)



def _bills(spark, d, only_enabled=False):
    return B.bill_articles(fx.bill_items(spark, d), fx.bill_pages(spark, d), B.feed_catalog(spark),
                           only_enabled=only_enabled)


OVERVIEW_SQL = ("CASE WHEN type = 'Votes' THEN CASE WHEN page_id IS NOT NULL THEN 'Explainer ' || page_id ELSE '' END "
                "WHEN page_id IS NOT NULL THEN 'Overview of page ' || page_id ELSE '' END")
SUMMARY_SQL = ("CASE WHEN type = 'Activity' AND sum_pid IS NOT NULL THEN 'Part one ' || sum_pid || ' Part two' ELSE '' END")
BILL_ROW_SQL = (
    f"SELECT seq, title AS bill_title, link AS bill_link, description AS bill_description, {OVERVIEW_SQL} AS bill_overview, "
    f"{s.clean_url('link')} || '/text' AS bill_text, {SUMMARY_SQL} AS bill_summary, "
    f"strftime(wall_ts, '%Y-%m-%d %H:%M:%S') AS pub_date, FALSE AS posted, type, "
    f"CASE WHEN type = 'Votes' THEN nullif({s.vote_result('description')}, '') END AS vote_result, "
    f"CASE WHEN type = 'Activity' THEN nullif({s.last_action('description')}, '') END AS last_action, "
    f"CASE WHEN type = 'Activity' THEN nullif({s.next_step('description')}, '') END AS next_step FROM bills_sv")
BILL_COLS = ["seq", "bill_title", "bill_link", "bill_description", "bill_overview", "bill_text", "bill_summary",
             "pub_date", "posted", "type", "vote_result", "last_action", "next_step"]


@register("to_bill_articles", bills_with("bills_sv") + BILL_ROW_SQL)
def to_bill_articles(spark, d):
    return _bills(spark, d).select(*BILL_COLS)


@register("feed_type_join", duck_with("bills_v") + "SELECT seq, feed_url, type FROM bills_v")
def feed_type_join(spark, d):
    return B.feed_type_join(fx.bill_items(spark, d), B.feed_catalog(spark), only_enabled=False).select("seq", "feed_url", "type")


@register("enabled_feeds", duck_with("bills_v") + "SELECT seq, feed_url, type FROM bills_v WHERE type <> 'Votes'")
def enabled_feeds(spark, d):
    return B.feed_type_join(fx.bill_items(spark, d), B.feed_catalog(spark)).select("seq", "feed_url", "type")


@register("bills_with_overview", duck_with("bills_v") +
          f"SELECT seq, {OVERVIEW_SQL} AS bill_overview FROM bills_v WHERE type <> 'Votes'")
def bills_with_overview(spark, d):
    return _bills(spark, d).filter("type <> 'Votes'").select("seq", "bill_overview")


@register("bills_with_summary", bills_with("bills_sv") +
          f"SELECT seq, {SUMMARY_SQL} AS bill_summary FROM bills_sv WHERE type = 'Activity'")
def bills_with_summary(spark, d):
    return _bills(spark, d).filter("type = 'Activity'").select("seq", "bill_summary")


@register("votes_with_explainer", duck_with("bills_v") +
          f"SELECT seq, {OVERVIEW_SQL} AS bill_overview FROM bills_v WHERE type = 'Votes'")
def votes_with_explainer(spark, d):
    return _bills(spark, d).filter("type = 'Votes'").select("seq", "bill_overview")


@register("bill_typed_columns", bills_with("bills_sv") +
          f"SELECT seq, type, vote_result, last_action, next_step FROM ({BILL_ROW_SQL})")
def bill_typed_columns(spark, d):
    return _bills(spark, d).select("seq", "type", "vote_result", "last_action", "next_step")


@register("union_feeds", bills_with("bills_sv") +
          f"SELECT seq, type, bill_link, vote_result, last_action, next_step FROM ({BILL_ROW_SQL})")
def union_feeds(spark, d):
    return B.union_feeds(_bills(spark, d)).select("seq", "type", "bill_link", "vote_result", "last_action", "next_step")


@register("bills_newest_first", duck_with("bills_v") +
          "SELECT seq, strftime(wall_ts, '%Y-%m-%d %H:%M:%S') AS pub_date, "
          "row_number() OVER (ORDER BY strftime(wall_ts, '%Y-%m-%d %H:%M:%S') DESC, seq) - 1 AS position FROM bills_v WHERE type <> 'Votes'")
def bills_newest_first(spark, d):
    return with_position(B.bills_newest_first(_bills(spark, d, only_enabled=True)).select("seq", "pub_date"))


@register("bill_to_article", bills_with("bills_sv") +
          f"SELECT 'politics|' || type || '||' || seq AS article_id, seq, 'politics' AS community, type AS blog_name, bill_link AS url, "
          f"bill_title AS title, bill_description AS description, pub_date AS date_published, posted, "
          f"strftime({BILL_INSTANT}, '%Y-%m-%d %H:%M:%S') AS published_utc "
          f"FROM ({BILL_ROW_SQL.replace('FROM bills_sv', ', wall_ts, off_min FROM bills_sv')})")
def bill_to_article(spark, d):
    return B.bill_to_article(_bills(spark, d)).select(
        *ARTICLE_COLS, F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_utc"))


@register("vote_result", duck_with("bills_v") +
          f"SELECT seq, {s.vote_result('description')} AS vote_result FROM bills_v WHERE type = 'Votes'")
def vote_result(spark, d):
    b = fx.bill_items(spark, d).filter(F.col("feed_url") == fx.catalog_url("Votes"))
    return b.select("seq", T.vote_result("description").alias("vote_result"))


@register("bill_activity", duck_with("bills_v") +
          f"SELECT seq, {s.last_action('description')} AS last_action, {s.next_step('description')} AS next_step "
          "FROM bills_v WHERE type = 'Activity'")
def bill_activity(spark, d):
    b = fx.bill_items(spark, d).filter(F.col("feed_url") == fx.catalog_url("Activity"))
    a = T.bill_activity(F.col("description"))
    return b.select("seq", a["last_action"].alias("last_action"), a["next_step"].alias("next_step"))


@register("clean_url", f"SELECT CAST(page_id AS BIGINT) AS page_id, {s.clean_url('url')} AS clean FROM pages")
def clean_url(spark, d):
    return fx.table(spark, d, "pages").select(big("page_id").alias("page_id"), T.clean_url("url").alias("clean"))


@register("derived_urls", duck_with("bills_v") +
          f"SELECT seq, {s.clean_url('link')} || '/text' AS text_url, {s.clean_url('link')} || '/summary' AS summary_url FROM bills_v")
def derived_urls(spark, d):
    c = T.clean_url("link")
    return fx.bill_items(spark, d).select("seq", T.derived_url(c, "/text").alias("text_url"),
                                          T.derived_url(c, "/summary").alias("summary_url"))


# ============================================================ pages

PAGES_EXTRA = {"pages_rich_v": (PAGES_RICH_SQL, ()),
               "body_v": (f"SELECT page_id, {s.drop_boilerplate('html')} AS body FROM pages_rich_v", ("pages_rich_v",)),
               "pc_v": (f"SELECT page_id, title, {s.kept_paragraphs(s.paragraphs('body'), 'title')} AS kept, "
                        f"{s.meta_description('body')} AS meta_description FROM "
                        f"(SELECT page_id, body, {s.page_title('body')} AS title FROM body_v)", ("body_v",))}


def _rich(spark, d):
    return fx.pages_rich(spark, d).select(big("page_id").alias("page_id"), "html")


def _pc(spark, d):
    return P.page_content(fx.pages_rich(spark, d), keep=("page_id",)).withColumn("page_id", big("page_id"))


@register("drop_boilerplate", duck_with("body_v", extra=PAGES_EXTRA) + "SELECT CAST(page_id AS BIGINT) AS page_id, body FROM body_v")
def drop_boilerplate(spark, d):
    return _rich(spark, d).select("page_id", H.drop_boilerplate("html").alias("body"))


@register("page_title", duck_with("pc_v", extra=PAGES_EXTRA) + "SELECT CAST(page_id AS BIGINT) AS page_id, title FROM pc_v")
def page_title(spark, d):
    return _pc(spark, d).select("page_id", "title")


@register("meta_description", duck_with("pc_v", extra=PAGES_EXTRA) +
          "SELECT CAST(page_id AS BIGINT) AS page_id, meta_description FROM pc_v")
def meta_description(spark, d):
    return _pc(spark, d).select("page_id", "meta_description")


@register("page_paragraphs", duck_with("body_v", extra=PAGES_EXTRA) +
          f"SELECT CAST(page_id AS BIGINT) AS page_id, CAST(unnest(range(0, len(ps))) AS BIGINT) AS p_pos, unnest(ps) AS paragraph "
          f"FROM (SELECT page_id, {s.paragraphs('body')} AS ps FROM body_v)")
def page_paragraphs(spark, d):
    bodies = _rich(spark, d).select("page_id", H.drop_boilerplate("html").alias("html"))
    return (H.with_paragraphs(bodies).select("page_id", F.posexplode("paragraphs"))
            .select("page_id", big("pos").alias("p_pos"), F.col("col").alias("paragraph")))


@register("content_paragraphs", duck_with("pc_v", extra=PAGES_EXTRA) +
          "SELECT CAST(page_id AS BIGINT) AS page_id, CAST(unnest(range(0, len(kept))) AS BIGINT) AS p_pos, unnest(kept) AS paragraph "
          "FROM pc_v")
def content_paragraphs(spark, d):
    pc = H.with_page_content(_rich(spark, d), "html", "pc")
    return (pc.select("page_id", F.posexplode("pc.paragraphs"))
            .select("page_id", big("pos").alias("p_pos"), F.col("col").alias("paragraph")))


PC_SQL = "SELECT CAST(page_id AS BIGINT) AS page_id, array_to_string(kept, chr(10)) AS content, title, meta_description, " \
         "CAST(len(kept) AS BIGINT) AS paragraph_count FROM pc_v"


@register("page_content", duck_with("pc_v", extra=PAGES_EXTRA) + PC_SQL)
def page_content(spark, d):
    return _pc(spark, d).select("page_id", "content", "title", "meta_description", "paragraph_count")


@register("paragraph_count", duck_with("pc_v", extra=PAGES_EXTRA) + f"SELECT page_id, paragraph_count FROM ({PC_SQL})")
def paragraph_count(spark, d):
    return _pc(spark, d).select("page_id", "paragraph_count")


@register("join_paragraphs", duck_with("pc_v", extra=PAGES_EXTRA) + f"SELECT page_id, content FROM ({PC_SQL})")
def join_paragraphs(spark, d):
    return _pc(spark, d).select("page_id", "content")


@register("content_snippet", duck_with("pc_v", extra=PAGES_EXTRA) + f"SELECT page_id, substr(content, 1, 100) AS snippet FROM ({PC_SQL})")
def content_snippet(spark, d):
    return _pc(spark, d).select("page_id", "snippet")


# ============================================================ sentences, chunks, summaries

def _docs(spark, d):
    return fx.table(spark, d, "documents").select(big("doc_id").alias("doc_id"), "text")


@register("split_sentences",
          f"SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(unnest(range(0, len(ss))) AS BIGINT) AS s_pos, unnest(ss) AS sentence "
          f"FROM (SELECT doc_id, {s.sentences('text')} AS ss FROM documents)")
def split_sentences(spark, d):
    return (_docs(spark, d).select("doc_id", F.posexplode(T.split_sentences("text")))
            .select("doc_id", big("pos").alias("s_pos"), F.col("col").alias("sentence")))


@register("text_chunks",
          f"SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(unnest(range(0, len(cs))) AS BIGINT) AS chunk_no, unnest(cs) AS chunk "
          f"FROM (SELECT doc_id, {s.chunks('text')} AS cs FROM documents)")
def text_chunks(spark, d):
    return (_docs(spark, d).select("doc_id", F.posexplode(T.text_chunks("text")))
            .select("doc_id", big("pos").alias("chunk_no"), F.col("col").alias("chunk")))


@register("chunk_summaries",
          f"SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(unnest(range(0, len(cs))) AS BIGINT) AS chunk_no, unnest(cs) AS summary "
          f"FROM (SELECT doc_id, {s.lead_sentences(s.chunks('text'))} AS cs FROM documents)")
def chunk_summaries(spark, d):
    return (_docs(spark, d).select("doc_id", F.posexplode(U.chunk_summaries(F.col("text"))))
            .select("doc_id", big("pos").alias("chunk_no"), F.col("col").alias("summary")))


@register("combine_chunk_summaries",
          f"SELECT CAST(doc_id AS BIGINT) AS doc_id, array_to_string({s.lead_sentences(s.chunks('text'))}, ' ') AS combined FROM documents")
def combine_chunk_summaries(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(U.chunk_summaries(F.col("text")), " ").alias("combined"))


@register("cap_sentences", f"SELECT CAST(doc_id AS BIGINT) AS doc_id, {s.cap_sentences('text')} AS capped FROM documents")
def cap_sentences(spark, d):
    return _docs(spark, d).select("doc_id", T.cap_sentences("text").alias("capped"))


PROMPTED_SQL = "'summarize: ' || source || '. ' || text || '. summarize: end'"


@register("drop_prompt_lines",
          f"SELECT CAST(doc_id AS BIGINT) AS doc_id, {s.drop_prompt_lines(PROMPTED_SQL)} AS cleaned FROM documents")
def drop_prompt_lines(spark, d):
    docs = fx.table(spark, d, "documents")
    prompted = F.concat(F.lit("summarize: "), F.col("source"), F.lit(". "), F.col("text"), F.lit(". summarize: end"))
    return docs.select(big("doc_id").alias("doc_id"), T.drop_prompt_lines(prompted).alias("cleaned"))


@register("article_summary", f"SELECT CAST(doc_id AS BIGINT) AS doc_id, {s.article_summary('text')} AS summary FROM documents")
def article_summary(spark, d):
    return _docs(spark, d).select("doc_id", U.article_summary(F.col("text")).alias("summary"))


@register("summary_post_body", duck_with("articles_v") +
          f"SELECT seq, {s.article_summary('description')} || chr(10) || chr(10) || '[Read more](' || url || ')' AS body FROM articles_v")
def summary_post_body(spark, d):
    a = fx.articles(spark, d)
    return a.select("seq", Q.summary_post_body(U.article_summary(F.col("description")), F.col("url")).alias("body"))


@register("nonblank_text", f"SELECT CAST(doc_id AS BIGINT) AS doc_id, text IS NULL OR length({s.strip('text')}) = 0 AS blank FROM documents")
def nonblank_text(spark, d):
    return _docs(spark, d).select("doc_id", T.is_blank(F.col("text")).alias("blank"))


# ---- TF-IDF ranking (A5, W3, O5) and the summary with points (F7, UD3)

def rank_ctes(src: str = "documents", params=config.RankParams()) -> str:
    """The ranking chain as DuckDB CTEs over ``src`` (doc_id, text):
    sents, valid, mp (main points)."""
    ss = s.sentences("text")
    return f"""sent0 AS (SELECT doc_id, {ss} AS ss FROM {src}),
sents AS (SELECT doc_id, CAST(len(ss) AS BIGINT) AS n_sent, CAST(unnest(range(0, len(ss))) AS BIGINT) AS s_pos,
          unnest(ss) AS sentence FROM sent0),
toks AS (SELECT doc_id, n_sent, s_pos, list_filter(regexp_extract_all(lower(sentence), {s.q(R.WORD_RE)}),
          lambda t: NOT list_contains({s.stop_list()}, t)) AS tk FROM sents),
terms AS (SELECT doc_id, n_sent, s_pos, unnest(CASE WHEN len(tk) > 1 THEN list_concat(tk,
          list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1])) ELSE tk END) AS term FROM toks),
tf AS (SELECT doc_id, n_sent, s_pos, term, count(*) AS tf FROM terms GROUP BY ALL),
dfq AS (SELECT *, count(*) OVER (PARTITION BY doc_id, term) AS df FROM tf),
w AS (SELECT doc_id, s_pos, CASE WHEN df >= {params.min_df} AND df <= CAST({params.max_df} AS DOUBLE) * n_sent
          THEN tf * (ln((1 + n_sent) / (1 + df)) + 1) END AS w FROM dfq),
sc AS (SELECT doc_id, s_pos, sum(w) AS sw, sum(w * w) AS sw2 FROM w GROUP BY ALL),
scores AS (SELECT s.doc_id, s.n_sent, s.s_pos, round(coalesce(sc.sw / sqrt(sc.sw2), 0.0), {params.score_digits}) AS score
           FROM sents s LEFT JOIN sc ON s.doc_id = sc.doc_id AND s.s_pos = sc.s_pos),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, s_pos) AS BIGINT) AS rank_no,
           max(score) OVER (PARTITION BY doc_id) AS mx FROM scores),
valid AS (SELECT r.*, t.sentence FROM ranked r JOIN sents t ON r.doc_id = t.doc_id AND r.s_pos = t.s_pos
          WHERE r.mx > 0 AND CAST({params.max_df} AS DOUBLE) * r.n_sent >= {params.min_df}),
mp AS (SELECT doc_id, count(*) AS n_points, string_agg(sentence, chr(10) ORDER BY rank_no) AS main_points,
       list(sentence ORDER BY rank_no) AS pts FROM valid WHERE rank_no <= {params.num_points} GROUP BY doc_id)
"""


def rank_sql(params=config.RankParams()) -> str:
    return "WITH " + rank_ctes("documents", params)


@register("sentence_tfidf", rank_sql() + "SELECT CAST(doc_id AS BIGINT) AS doc_id, s_pos, score FROM valid")
def sentence_tfidf(spark, d):
    return R.rank_sentences(_docs(spark, d), with_text=False).select("doc_id", "s_pos", "score")


@register("rank_sentences", rank_sql() + "SELECT CAST(doc_id AS BIGINT) AS doc_id, s_pos, rank_no, score FROM valid")
def rank_sentences(spark, d):
    return R.rank_sentences(_docs(spark, d), with_text=False).select("doc_id", "s_pos", "rank_no", "score")


@register("rank_long_articles", rank_sql() + "SELECT CAST(doc_id AS BIGINT) AS doc_id, s_pos, rank_no, score FROM valid")
def rank_long_articles(spark, d):
    """All articles ranked as those larger than a task are."""
    return R.rank_long_articles(_docs(spark, d), with_text=False).select("doc_id", "s_pos", "rank_no", "score")


@register("main_points", rank_sql() +
          "SELECT CAST(d.doc_id AS BIGINT) AS doc_id, mp.n_points, mp.main_points FROM documents d LEFT JOIN mp ON d.doc_id = mp.doc_id")
def main_points(spark, d):
    m = R.main_points(_docs(spark, d))
    return m.select("doc_id", F.size("main_points").cast("bigint").alias("n_points"),
                    F.array_join("main_points", "\n").alias("main_points")).select(
        "doc_id", F.when(F.col("main_points").isNull(), F.lit(None).cast("bigint")).otherwise(F.col("n_points")).alias("n_points"),
        "main_points")


def summary_ctes(src: str) -> str:
    """sp, nov: summary and novel points per doc of ``src`` (after rank_ctes)."""
    return f"""sp AS (
SELECT d.doc_id, {s.article_summary('d.text')} AS summary, mp.pts FROM {src} d JOIN mp ON d.doc_id = mp.doc_id
WHERE NOT (d.text IS NULL OR length({s.strip('d.text')}) = 0)),
nov AS (SELECT doc_id, summary, list_filter(pts, lambda p: NOT contains(summary, p)) AS np FROM sp)
"""


SUMMARY_POINTS_SQL = rank_sql() + ", " + summary_ctes("documents") + """
SELECT CAST(d.doc_id AS BIGINT) AS doc_id, nov.summary, CAST(len(nov.np) AS BIGINT) AS n_points,
       array_to_string(nov.np, chr(10)) AS main_points
FROM documents d LEFT JOIN nov ON d.doc_id = nov.doc_id"""


def _summary_points(spark, d):
    sp = U.summary_and_points(_docs(spark, d))
    return sp.select("doc_id", "summary", F.size("main_points").cast("bigint").alias("n_points"),
                     F.array_join("main_points", "\n").alias("main_points")).select(
        "doc_id", "summary",
        F.when(F.col("main_points").isNull(), F.lit(None).cast("bigint")).otherwise(F.col("n_points")).alias("n_points"),
        "main_points")


@register("summary_and_points", SUMMARY_POINTS_SQL)
def summary_and_points(spark, d):
    return _summary_points(spark, d)


@register("novel_points", SUMMARY_POINTS_SQL.replace(
    "SELECT CAST(d.doc_id AS BIGINT) AS doc_id, nov.summary, CAST(len(nov.np) AS BIGINT) AS n_points,\n       array_to_string(nov.np, chr(10)) AS main_points",
    "SELECT CAST(d.doc_id AS BIGINT) AS doc_id, CAST(len(nov.np) AS BIGINT) AS n_points,\n       array_to_string(nov.np, chr(10)) AS main_points"))
def novel_points(spark, d):
    return _summary_points(spark, d).select("doc_id", "n_points", "main_points")


# ---- the queue that summarizes (UD4)

QUEUE_SQL = (duck_with("articles_v") + f""",
picked AS ({NEXT_SQL.format(n=1)}),
pbody AS (SELECT url, {s.drop_boilerplate('html')} AS body FROM pages),
ppc AS (SELECT url, {s.kept_paragraphs(s.paragraphs('body'), 'title')} AS kept
        FROM (SELECT url, body, {s.page_title('body')} AS title FROM pbody)),
pcontent AS (SELECT url, min(array_to_string(kept, chr(10))) AS content FROM ppc GROUP BY url),
jobs AS (SELECT p.community, p.title, p.url, p.article_id, c.content FROM picked p LEFT JOIN pcontent c ON p.url = c.url),
docsq AS (SELECT article_id AS doc_id, content AS text FROM jobs),
""" + rank_ctes("docsq") + ", " + summary_ctes("docsq") + """
SELECT j.community, j.title, coalesce(nov.summary, 'None') || chr(10) || chr(10) || '[Read more](' || j.url || ')' AS content,
       j.url, array_to_string(nov.np, chr(10)) AS main_points
FROM jobs j LEFT JOIN nov ON j.article_id = nov.doc_id""")


@register("summarize_queue", QUEUE_SQL)
def summarize_queue(spark, d):
    out, _ = U.summarize_queue(fx.articles(spark, d), fx.table(spark, d, "pages").select("url", "html"))
    return out.select("community", "title", "content", "url", F.array_join("main_points", "\n").alias("main_points"))


# ---- streaming (ST1): rows-only check in the driver, value check in tests

@register("collect_stream", duck_with("feed_v") +
          f"SELECT 'dnd' AS community, source AS blog_name, link AS url, title, {s.clean_desc('description')} AS description, "
          "exp_iso AS date_published, FALSE AS posted, 'dnd|' || source || '|stream|' || doc_id AS article_id FROM feed_v WHERE exp_ts IS NOT NULL")
def collect_stream(spark, d):
    from feedspark.streaming.collect_stream import collect_stream_once
    return collect_stream_once(spark, fx.feed_entries(spark, d), fx.tracker(spark, d)).select(*OUT_COLS)


def queries() -> dict[str, QueryFn]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
