"""Feed collection (SURVEY §2.2, §2.4, §2.6, §2.7, §2.11: P1, P2, F1, F2,
U1, O1, L1, A1, ST2).

The reference polls every feed of a community, keeps entries dated strictly
after the stored ``last_fetched`` day, cleans them, appends them to the
article table, re-sorts it and advances the date.  Here that is one
DataFrame chain; the only shuffle is the join of entries to their feed, which
the planner turns into a broadcast when the feed list's size allows.  New rows
get a key of their own (``article_key``) and are appended; nothing stored is
read for that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.functions.dates import date_token, iso_date, parse_published, watermark_ts
from feedspark.functions.text import cleaned, stripped_description
from feedspark.schemas import ARTICLE, STORED_ORDER
from feedspark.session import settle


# P1
def explode_feeds(tracker: DataFrame) -> DataFrame:
    """One row per tracked feed: (community, blog_name, rss_url, last_fetched)."""
    return (tracker
            .select("community", "last_fetched", F.explode("blogs").alias("b"))
            .select("community", F.col("b.blog_name").alias("blog_name"),
                    F.col("b.rss_url").alias("rss_url"), "last_fetched"))


def entries_with_feed(entries: DataFrame, feeds: DataFrame) -> DataFrame:
    """Attach blog and watermark to each entry by its feed URL.  Feed lists
    are configuration; the planner broadcasts them by size, and AQE splits a
    hot feed if it does not."""
    return entries.join(feeds, entries["feed_url"] == feeds["rss_url"], "inner").drop("rss_url")


# D1 + D2
def with_dates(entries: DataFrame, compat: bool = False) -> DataFrame:
    """Add ``date_token``, ``published_at``, ``offset_min``, ``date_published``.

    ``compat=True`` keeps the reference's cut at the first 'T' (which drops
    'Tue'/'Thu' dates and the time of ISO dates); the default parses the
    whole string.  Rows whose token is empty or does not parse have a null
    ``published_at``.  The parsed date is generated, not projected: filters on
    it stay behind it, so that each date is parsed once.
    """
    raw = F.coalesce(F.col("published"), F.lit(""))
    token = date_token(raw) if compat else raw
    parsed = entries.withColumn("date_token", token).select("*", F.explode(F.array(parse_published(F.col("date_token")))).alias("_p"))
    return (parsed.withColumn("published_at", F.col("_p.published_at"))
            .withColumn("offset_min", F.col("_p.offset_min"))
            .drop("_p")
            .withColumn("date_published", iso_date("published_at", "offset_min")))


# F1
def dated_entries(entries: DataFrame, compat: bool = False) -> DataFrame:
    """``with_dates`` without the rows whose token is empty.  Rows whose token
    does not parse keep a null ``published_at``; see ``rejects``."""
    return with_dates(entries, compat).filter(F.length("date_token") > 0)


REJECT_COLUMNS = ["entry_id", "feed_url", "link", "title", "published"]


def all_entries(entries: DataFrame, feeds: DataFrame, compat: bool = False) -> DataFrame:
    """Every entry with its blog, if one tracks its feed, and its date."""
    matched = entries.join(feeds, entries["feed_url"] == feeds["rss_url"], "left").drop("rss_url")
    return with_dates(matched, compat)


def rejects(found: DataFrame, extra: tuple = ()) -> DataFrame:
    """What no article can be made of ``all_entries``: entries whose feed no
    blog tracks (``feed``), without a date (``no date``; F1 drops them) or with
    one that does not parse (``date``; the reference raises)."""
    reason = (F.when(F.col("blog_name").isNull(), "feed").when(F.length("date_token") == 0, "no date")
              .when(F.col("published_at").isNull(), "date"))
    return (found.withColumn("reason", reason).filter(F.col("reason").isNotNull())
            .select("community", "blog_name", *REJECT_COLUMNS, *extra, "reason"))


def with_broken(rejected: DataFrame, broken: DataFrame | None) -> DataFrame:
    """The rejects and one row (``document``) for each broken file (file)."""
    if broken is None:
        return rejected
    return rejected.unionByName(broken.select("file", F.lit("document").alias("reason")), allowMissingColumns=True)


def usable_entries(found: DataFrame) -> DataFrame:
    """The entries of ``all_entries`` that articles can be made of."""
    return found.filter(F.col("blog_name").isNotNull() & F.col("published_at").isNotNull())


# F2
def since_watermark(dated: DataFrame, last_fetched: Column | str = "last_fetched") -> DataFrame:
    """Strictly later than midnight UTC of ``last_fetched``."""
    lf = F.col(last_fetched) if isinstance(last_fetched, str) else last_fetched
    return dated.filter(F.col("published_at") > watermark_ts(lf))


# L1
def late_entries(dated: DataFrame, last_fetched: Column | str = "last_fetched") -> DataFrame:
    """Entries dated on or before the watermark day: dropped for good.
    Count per blog (partial aggregation before the shuffle)."""
    lf = F.col(last_fetched) if isinstance(last_fetched, str) else last_fetched
    late = dated.filter(F.col("published_at") <= watermark_ts(lf))
    return late.groupBy("community", "blog_name").agg(F.count(F.lit(1)).alias("n_late"))


def with_clean_descriptions(entries: DataFrame, needed: Column | None = None) -> DataFrame:
    """Descriptions cleaned; null where ``needed`` does not hold."""
    raw = stripped_description("description")
    stripped = entries.select("*", F.explode(F.array(raw if needed is None else F.when(needed, raw))).alias("_stripped"))
    return stripped.withColumn("description", cleaned("_stripped")).drop("_stripped")


# P2
def to_articles(new_entries: DataFrame) -> DataFrame:
    """Article rows: cleaned description, ISO date, ``posted`` false.  Keeps
    ``entry_id`` (a stable id given at read time) for the append order."""
    return article_rows(with_clean_descriptions(new_entries))


def article_rows(clean: DataFrame) -> DataFrame:
    """``to_articles`` of entries whose descriptions are clean."""
    return clean.select(
        "community", "blog_name",
        F.col("link").alias("url"),
        F.col("title"),
        "description",
        "date_published", "published_at",
        F.lit(False).alias("posted"),
        F.col("entry_id"),
    )


def article_key(community, blog_name, run, seq) -> Column:
    """The row's name for good: community|blog|run|position, '|' in names
    written as '%7C'."""
    part = lambda c: F.replace(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")), F.lit("|"), F.lit("%7C"))
    return F.concat_ws("|", part(community), part(blog_name), part(run), part(seq))


# U1
def append_articles(existing: DataFrame, new: DataFrame, run: str) -> DataFrame:
    """existing + new, duplicates kept."""
    return existing.unionByName(key_new(new, run).select(*existing.columns))


def key_new(new: DataFrame, run: str) -> DataFrame:
    """New article rows in the stored schema.  ``seq`` is the entry's position
    in this run, so stored order breaks date ties as the reference does:
    earlier runs first, then feed order."""
    return (new.withColumn("run", F.lit(run)).withColumn("seq", F.col("entry_id"))
            .withColumn("article_id", article_key("community", "blog_name", "run", "seq"))
            .select(*ARTICLE.fieldNames()))


# O1
def articles_by_date(articles: DataFrame, compat: bool = False) -> DataFrame:
    """Stored order: by instant, then run and position; compat mode sorts the
    ISO strings as the reference does (not time order for mixed offsets)."""
    key = "date_published" if compat else STORED_ORDER[0]
    return articles.orderBy(F.col(key).asc_nulls_first(), *[F.col(c).asc() for c in STORED_ORDER[1:]])


# A1
def new_article_count(new_articles: DataFrame) -> DataFrame:
    return new_articles.groupBy("community", "blog_name").agg(F.count(F.lit(1)).alias("n_new"))


# K2 (value part; the write is in sources.sinks)
def advance_tracker(tracker: DataFrame, run_date: str, seen_feeds: DataFrame | None = None) -> DataFrame:
    """Set ``last_fetched`` to the run date (a UTC 'yyyy-MM-dd' argument).
    With ``seen_feeds`` (rss_url) a feed of which this run has seen no entry
    keeps its date, in a tracker row of its own, so nothing of it is lost."""
    if seen_feeds is None:
        return tracker.withColumn("last_fetched", F.lit(run_date))
    feeds = explode_feeds(tracker)
    seen = seen_feeds.select("rss_url").distinct().withColumn("_seen", F.lit(True))
    dated = feeds.join(seen, "rss_url", "left").withColumn(
        "last_fetched", F.when(F.col("_seen"), F.lit(run_date)).otherwise(F.col("last_fetched")))
    return (dated.groupBy("community", "last_fetched")  # a community's feed list: configuration
            .agg(F.array_sort(F.collect_list(F.struct("blog_name", "rss_url"))).alias("blogs"))
            .select("community", "last_fetched", "blogs"))


@dataclass
class CollectResult:
    articles: DataFrame      # existing and new rows, stored order
    new_articles: DataFrame  # rows added by this run
    new_rows: DataFrame      # the same rows in the stored schema, with their key
    late: DataFrame          # per-blog count of entries behind the watermark
    rejects: DataFrame       # entries without a tracked feed, a date, or a date that parses
    tracker: DataFrame       # tracker, advanced for the feeds that this run has seen


# ST2
def collect_batch(tracker: DataFrame, entries: DataFrame, existing: DataFrame,
                  run_date: str, compat: bool = False, dedupe: bool = False, run: str | None = None,
                  once: bool = False, extra: tuple = ()) -> CollectResult:
    """S2 -> P1 -> D2/F1 -> F2 -> T6 -> P2 -> U1 -> O1, plus L1, A1 and K2.

    ``entries`` has feed_url, link, title, description, published and
    ``entry_id``; ``existing`` has the ARTICLE schema; ``run`` names this run
    in the keys of its rows (default: the run date).  ``dedupe=True`` (off by
    default: the reference keeps duplicates) drops new rows whose (community,
    blog_name, url) is already stored, and repeats within the run.
    ``once=True`` writes the dated entries to the scratch folder, with the
    cleaned descriptions of those that become articles and no others, for callers
    that use several of the results or sort them: then each date is parsed, each
    description cleaned and each text written once.  ``extra`` columns
    of the entries are carried into the rejects.
    """
    run = run or run_date
    feeds = explode_feeds(tracker)
    found = all_entries(entries, feeds, compat)
    if once:
        is_new = F.col("blog_name").isNotNull() & (F.col("published_at") > watermark_ts(F.col("last_fetched")))
        found = settle(with_clean_descriptions(found, is_new), "entries")
    usable = usable_entries(found)
    new = (article_rows if once else to_articles)(since_watermark(usable))
    if dedupe:
        own = ["community", "blog_name", "url"]
        new = (new.join(existing.select(*own), own, "left_anti")
                  .groupBy(*own).agg(F.min_by(F.struct(*new.columns), "entry_id").alias("r"))
                  .select("r.*"))
    if once and dedupe:
        new = settle(new, "new-articles")
    return CollectResult(
        articles=articles_by_date(append_articles(existing, new, run), compat=compat),
        new_articles=new.drop("entry_id"),
        new_rows=key_new(new, run),
        late=late_entries(usable),
        rejects=rejects(found, extra),
        tracker=advance_tracker(tracker, run_date, entries.select(F.col("feed_url").alias("rss_url"))),
    )
