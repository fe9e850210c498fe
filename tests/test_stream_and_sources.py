"""Readers, sinks, and the streaming collector (batch = stream)."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from feedspark.operators.collect import dated_entries, entries_with_feed, explode_feeds, to_articles
from feedspark.plans import fixtures as fx
from feedspark.sources import readers, sinks
from feedspark.streaming.collect_stream import collect_stream_once

RSS = """<?xml version="1.0"?>
<rss><channel><title>feed</title>
<item><title>One &amp; only</title><link>https://a/1?x=1</link>
<description><![CDATA[<p>Hello <b>world</b></p>]]></description><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item>
<group><item><title>Deep</title><link>https://a/2</link><description>d</description>
<pubDate>Wed, 03 Jan 2024 10:00:00 -0500</pubDate></item></group>
<item><title>No date</title><link>https://a/3</link><description>x</description></item>
</channel></rss>"""


def test_read_rss_items(spark):
    d = tempfile.mkdtemp(prefix="rss-")
    with open(os.path.join(d, "feed.xml"), "w") as f:
        f.write(RSS)
    items = {r.link: r for r in readers.read_feed_items(spark, d).collect()}
    assert set(items) == {"https://a/1?x=1", "https://a/2", "https://a/3"}
    assert items["https://a/1?x=1"].title == "One & only"
    assert items["https://a/1?x=1"].description == "<p>Hello <b>world</b></p>"
    assert items["https://a/3"].pubDate is None
    assert readers.read_feed_items(spark, d, strict=True).count() == 2


def test_tracker_and_articles_round_trip(spark):
    t = fx.tracker(spark, SF_SMALL)
    root = tempfile.mkdtemp(prefix="trk-")
    path = sinks.write_tracker(t, root)
    back = explode_feeds(readers.read_tracker(spark, path))
    assert back.count() == explode_feeds(t).count()
    one = os.path.join(tempfile.mkdtemp(prefix="trk1-"), "t.json")
    with open(one, "w") as f:
        f.write('{"community": "dnd", "last_fetched": "2024-01-15", "blogs": '
                '[{"blog_name": "a", "rss_url": "u1"}, {"blog_name": "b", "rss_url": "u2"}]}')
    assert explode_feeds(readers.read_tracker(spark, one, multi_line=True)).count() == 2
    a = fx.articles(spark, SF_SMALL)
    p = sinks.write_articles(a, tempfile.mkdtemp(prefix="art-") + "/articles")
    assert readers.read_articles(spark, p).count() == a.count()


def test_batch_equals_stream(spark):
    entries = fx.feed_entries(spark, SF_SMALL)
    tracker = fx.tracker(spark, SF_SMALL)
    cols = ["community", "blog_name", "url", "title", "description", "date_published", "posted"]
    batch = to_articles(dated_entries(entries_with_feed(entries, explode_feeds(tracker)))) \
        .filter(F.col("published_at").isNotNull()).select(*cols)
    stream = collect_stream_once(spark, entries.repartition(3), tracker).select(*cols)
    assert stream.count() == batch.count() > 0
    assert stream.exceptAll(batch).count() == 0 and batch.exceptAll(stream).count() == 0


ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>feed</title><link href="https://a/"/>
<entry><title>One</title><link rel="self" href="https://a/self"/><link rel="alternate" href="https://a/1"/>
<summary>short</summary><content>long</content><published>2024-01-05T10:00:00Z</published><updated>2024-01-06T10:00:00Z</updated></entry>
<entry><title>Two</title><link href="https://a/2"/><content>text</content><updated>2024-01-07T10:00:00Z</updated></entry>
<entry><title>Three</title></entry></feed>"""


def test_read_atom_entries(spark):
    d = tempfile.mkdtemp(prefix="atom-")
    with open(os.path.join(d, "feed.xml"), "w") as f:
        f.write(ATOM)
    got = {r.title: (r.link, r.description, r.pubDate) for r in readers.read_atom_entries(spark, d).collect()}
    assert got == {"One": ("https://a/1", "short", "2024-01-05T10:00:00Z"), "Two": ("https://a/2", "text", "2024-01-07T10:00:00Z"),
                   "Three": (None, None, None)}
    with open(os.path.join(d, "rss.xml"), "w") as f:
        f.write(RSS)
    assert {r.file: r.n for r in readers.read_entries(spark, d).groupBy("file").agg(F.count("*").alias("n")).collect()} == {
        "feed.xml": 3, "rss.xml": 3}


def test_current_version(spark):
    root = tempfile.mkdtemp(prefix="cur-") + "/t"
    t = fx.tracker(spark, SF_SMALL)
    sinks.write_tracker(t, root)
    newest = sinks.write_tracker(t.withColumn("last_fetched", F.lit("2025-01-01")), root)
    assert sinks.current_path(spark, root) == newest
    assert sinks.current_path(spark, root + "-never") == root + "-never"


def test_stream_dedupe_within_watermark(spark):
    import tempfile as tf
    from feedspark.streaming.collect_stream import ENTRY_COLUMNS, start_collect_stream
    entries = fx.feed_entries(spark, SF_SMALL).select(*ENTRY_COLUMNS)
    root = tf.mkdtemp(prefix="sdd-")
    entries.unionByName(entries.withColumn("entry_id", F.col("entry_id") + 100000)) \
        .repartition(2).write.parquet(f"{root}/landing")
    q = start_collect_stream(spark, f"{root}/landing", entries.schema, fx.tracker(spark, SF_SMALL),
                             f"{root}/sink", f"{root}/ckpt", dedupe_delay="3650 days")
    q.awaitTermination()
    out = spark.read.parquet(f"{root}/sink")
    assert out.count() == out.select("blog_name", "url").distinct().count() == 192  # 8 of 200 dates do not parse


def _landing(root):
    """RSS, Atom and damaged files with every kind of entry, a map and a tracker."""
    os.makedirs(f"{root}/landing")
    files = {"rss0.xml": RSS, "rss1.xml": RSS.replace("https://a/", "https://a1/"), "atom.xml": ATOM,
             "stray.xml": RSS.replace("https://a/", "https://s/"),
             "twins.xml": "<rss><channel>" + 2 * ("<item><title>T</title><link>https://t/1</link><description>d</description>"
                                                  "<pubDate>Mon, 15 Jan 2024 10:00:00 GMT</pubDate></item>") + "</channel></rss>",
             "late.xml": RSS.replace("2024 10", "2020 10"), "soon.xml": RSS.replace("Mon, 01 Jan 2024 10:00:00 +0000", "soon"),
             "cut.xml": RSS[:RSS.index("<group>") + 40], "text.xml": "no feed at all", "empty.xml": ""}
    for name, text in files.items():
        with open(f"{root}/landing/{name}", "w") as f:
            f.write(text)
    return files


FEEDS = [(n, "u-" + n) for n in ("rss0.xml", "rss1.xml", "atom.xml", "twins.xml", "late.xml", "soon.xml", "cut.xml")]
BLOGS = [(u.removeprefix("u-").removesuffix(".xml"), u) for _, u in FEEDS]
TRACKER_DDL = "community string, last_fetched string, blogs array<struct<blog_name:string,rss_url:string>>"


def _state(spark, root):
    from feedspark.sources import runs
    arts = runs.articles(spark, f"{root}/articles").collect()
    rejects = runs.reports(spark, f"{root}/articles", "rejects", "file string, link string, title string, reason string").collect()
    late = runs.reports(spark, f"{root}/articles", "late", "blog_name string, n_late long").collect()
    return arts, rejects, late


ARTICLES = {"rss0": 2, "rss1": 2, "atom": 2, "twins": 2, "late": 2, "soon": 1, "cut": 1}
REJECTS = {("rss0.xml", "no date"): 1, ("rss1.xml", "no date"): 1, ("late.xml", "no date"): 1, ("soon.xml", "no date"): 1, ("soon.xml", "date"): 1,
           ("atom.xml", "no date"): 1, ("stray.xml", "feed"): 3, ("cut.xml", "document"): 1, ("text.xml", "document"): 1}


def _check(arts, rejects):
    from collections import Counter
    assert Counter(r.blog_name for r in arts) == ARTICLES
    assert len({r.article_id for r in arts}) == len(arts)  # also of entries that agree in link and date
    assert Counter((r.file, r.reason) for r in rejects) == REJECTS


def test_feed_files_land_once_in_articles_or_rejects(spark):
    """RSS, Atom, undated, unparsed, unmatched entries and broken files; late
    counts as the batch job's; files that arrive later are a batch of their own."""
    from feedspark.plans.jobs import collect_job
    from feedspark.streaming.collect_stream import start_feed_files
    root = tempfile.mkdtemp(prefix="feeds-")
    _landing(root)
    feeds = spark.createDataFrame(FEEDS, "file string, feed_url string")
    tracker = spark.createDataFrame([("dnd", "2023-12-31", BLOGS)], TRACKER_DDL)
    args = (spark, f"{root}/landing", feeds, tracker, f"{root}/articles", root, f"{root}/ckpt")
    for _ in range(2):  # the second call finds nothing new
        start_feed_files(*args, files_per_batch=4).awaitTermination()
    arts, rejects, late = _state(spark, root)
    _check(arts, rejects)
    order = sorted((r for r in arts if r.blog_name == "rss0"), key=lambda r: r.seq)
    assert [r.title for r in order] == ["One & only", "Deep"]  # the feed's order
    sinks.write_tracker(tracker, f"{root}/b/tracker")
    entries, broken = readers.read_feed_files(spark, f"{root}/landing", feeds)
    collect_job(spark, f"{root}/b/tracker", entries, f"{root}/b/articles", f"{root}/b", "2024-02-01", broken=broken)
    batch, batch_rejects, batch_late = _state(spark, f"{root}/b")
    n_late = {r.blog_name: r.n_late for r in batch_late}
    assert n_late == {"late": 2} and {r.blog_name: r.n_late for r in late} == n_late
    assert sorted((r.file, r.reason) for r in batch_rejects) == sorted((r.file, r.reason) for r in rejects)
    assert len(batch) == len(arts) - 2  # the stream keeps the late entries, the batch only counts them
    with open(f"{root}/landing/more.xml", "w") as f:
        f.write(RSS)
    start_feed_files(*args).awaitTermination()
    assert len(_state(spark, root)[1]) == len(rejects) + 3  # more.xml is of no feed


@pytest.mark.parametrize("step", ["articles", "rejects", "late", "commit", "after"])
def test_killed_batch_lands_once(spark, monkeypatch, step):
    """The batch dies at each of its steps, and the stream is started again."""
    from pyspark.errors import StreamingQueryException

    from feedspark.sources import runs
    from feedspark.streaming import collect_stream
    root = tempfile.mkdtemp(prefix="killed-")
    _landing(root)
    feeds = spark.createDataFrame(FEEDS, "file string, feed_url string")
    tracker = spark.createDataFrame([("dnd", "2024-01-01", BLOGS)], TRACKER_DDL)

    def run():
        collect_stream.start_feed_files(spark, f"{root}/landing", feeds, tracker, f"{root}/articles", root, f"{root}/ckpt").awaitTermination()

    with monkeypatch.context() as m:
        holder, name = {"articles": (runs, "write_rows"), "rejects": (sinks, "write_report"), "late": (sinks, "write_report"),
                        "commit": (runs, "commit"), "after": (runs, "commit")}[step]
        real = getattr(holder, name)

        def dying(*a, **k):
            if step in ("articles", "after", "rejects") or (step == "late" and a[1].endswith("late")):
                real(*a, **k)  # what it writes is there when the batch dies
            if step != "late" or a[1].endswith("late"):
                raise RuntimeError("killed")
            return real(*a, **k)

        m.setattr(holder, name, dying)
        with pytest.raises(StreamingQueryException):
            run()
    if step != "after":
        assert _state(spark, root) == ([], [], [])  # nothing of it is visible
    run()
    _check(*_state(spark, root)[:2])


def test_import_article_file(spark):
    import json
    import tempfile as tf
    rows = [{"blog_name": "b", "url": f"u{i}", "title": f"t{i}", "description": "d",
             "date_published": f"2024-01-0{i + 1}T10:00:00+00:00", "posted": i == 0} for i in range(3)]
    rows.append({"blog_name": "b", "url": "u3", "title": "t3", "date_published": "2024-01-01T09:00:00-05:00",
                 "posted": False})
    d = tf.mkdtemp(prefix="imp-")
    with open(f"{d}/details.json", "w") as f:
        json.dump(rows, f, indent=4)
    from feedspark.operators.queue import next_to_post
    a = readers.import_article_file(spark, f"{d}/details.json", "dnd")
    both = a.unionByName(readers.import_article_file(spark, f"{d}/details.json", "nfl"))
    assert both.select("article_id").distinct().count() == 8
    got = a.orderBy("seq").collect()
    assert [r.url for r in got] == ["u0", "u1", "u2", "u3"] and got[3].description == ""
    # 09:00-05:00 is 14:00 UTC on Jan 1: after u0 (posted) and before u1
    assert [r.url for r in next_to_post(a, n=2).orderBy("queue_pos").collect()] == ["u3", "u1"]
