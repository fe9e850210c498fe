"""End-to-end jobs over files: collect then post then summarize."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from feedspark.plans import fixtures as fx
from feedspark.operators.queue import mark_posted, next_to_post
from feedspark.plans import jobs
from feedspark.sources import readers, runs, sinks

NEW = 191  # entries of the fixture after the watermark


def test_collect_post_summarize(spark):
    root = tempfile.mkdtemp(prefix="jobs-")
    sinks.write_tracker(fx.tracker(spark, SF_SMALL), f"{root}/tracker")
    a0 = fx.articles(spark, SF_SMALL)
    sinks.append_article_rows(a0, f"{root}/articles")
    entries = fx.feed_entries(spark, SF_SMALL)
    res = jobs.collect_job(spark, f"{root}/tracker", entries, f"{root}/articles", root, "2024-02-01")
    arts = runs.articles(spark, f"{root}/articles")
    assert arts.count() == a0.count() + NEW and readers.read_articles(spark, res["articles"]).count() == NEW
    assert arts.select("article_id").distinct().count() == arts.count()
    trk = readers.read_tracker(spark, sinks.current_path(spark, f"{root}/tracker"))
    assert {r.last_fetched for r in trk.collect()} == {"2024-02-01"}
    assert spark.read.json(res["rejects"]).groupBy("reason").count().collect()[0] == ("date", 8)

    n = arts.select("community").distinct().count()
    for k in (1, 2):  # nothing stored is rewritten; the outbox says what was posted
        jobs.post_job(spark, f"{root}/articles", f"{root}/outbox")
        out = spark.read.parquet(f"{root}/outbox")
        assert out.count() == out.select("article_id").distinct().count() == k * n
    p1 = next_to_post(arts)
    p2 = next_to_post(mark_posted(arts, p1))
    assert {r.article_id for r in out.collect()} == {r.article_id for r in p1.collect()} | {r.article_id for r in p2.collect()}
    marked = jobs.post_job(spark, f"{root}/articles", f"{root}/outbox", f"{root}/marked")
    after = readers.read_articles(spark, sinks.current_path(spark, f"{root}/marked/articles"))
    assert marked["articles"] and after.filter("posted").count() == arts.filter("posted").count() + 3 * n

    fx.table(spark, SF_SMALL, "pages").select("url", "html").write.parquet(f"{root}/pages")
    summ = jobs.summarize_job(spark, f"{root}/articles", f"{root}/pages", f"{root}/outbox2")
    o2 = spark.read.parquet(summ["outbox"])
    assert o2.count() == n and o2.filter(F.col("content").contains("[Read more](")).count() == n


RSS_DOC = """<rss><channel>{}</channel></rss>"""
RSS_ITEM = "<item><title>{0}</title><link>https://x/{0}</link><description>d</description><pubDate>{1}</pubDate></item>"


def _feed_files(root):
    os.makedirs(f"{root}/feeds")
    files = {"a.xml": [("a1", "Mon, 15 Jan 2024 10:00:00 GMT"), ("a2", "soon"), ("a3", "Mon, 01 Jan 2024 10:00:00 GMT")],
             "b.xml": [("b1", "Mon, 15 Jan 2024 10:00:00 GMT")], "stray.xml": [("s1", "Mon, 15 Jan 2024 10:00:00 GMT")]}
    for name, items in files.items():
        with open(f"{root}/feeds/{name}", "w") as f:
            f.write(RSS_DOC.format("".join(RSS_ITEM.format(*i) for i in items)))
    with open(f"{root}/map.json", "w") as f:
        f.write('{"file": "a.xml", "feed_url": "https://a/feed"}\n{"file": "b.xml", "feed_url": "https://b/feed"}\n')
    with open(f"{root}/tracker.json", "w") as f:
        f.write('{"community": "dnd", "last_fetched": "2024-01-10", "blogs": [{"blog_name": "A", "rss_url": "https://a/feed"}, '
                '{"blog_name": "C", "rss_url": "https://c/feed"}]}')


def test_cli_from_rss_files_to_articles(spark, capsys):
    root = tempfile.mkdtemp(prefix="cli-")
    _feed_files(root)
    jobs.main(["collect", "--tracker", f"{root}/tracker.json", "--tracker-multiline", "--feeds", f"{root}/feeds", "--feed-map", f"{root}/map.json",
               "--articles", f"{root}/articles", "--out", f"{root}/out", "--run-date", "2024-02-01"])
    res = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    rows = readers.read_articles(spark, res["articles"]).collect()
    assert [(r.blog_name, r.url) for r in rows] == [("A", "https://x/a1")]
    rejects = {(r.link, r.reason) for r in spark.read.json(res["rejects"]).collect()}
    assert rejects == {("https://x/a2", "date"), ("https://x/b1", "feed"), ("https://x/s1", "feed")}
    assert [(r.blog_name, r.n_late) for r in spark.read.json(res["late"]).collect()] == [("A", 1)]
    tracker = {b.blog_name: r.last_fetched for r in readers.read_tracker(spark, res["tracker"]).collect() for b in r.blogs}
    assert tracker == {"A": "2024-02-01", "C": "2024-01-10"}  # nothing of C was seen


def test_cli_needs_a_feed_map():
    with pytest.raises(SystemExit):
        jobs.main(["collect", "--tracker", "t", "--feeds", "f", "--articles", "a", "--out", "o", "--run-date", "2024-02-01"])


def test_stream_job_feeds_the_queue(spark):
    root = tempfile.mkdtemp(prefix="stream-")
    _feed_files(root)
    args = (spark, f"{root}/tracker.json", f"{root}/feeds", readers.read_feed_map(spark, f"{root}/map.json"), f"{root}/articles", f"{root}/out")
    for _ in range(2):  # the second call finds nothing new
        res = jobs.stream_job(*args, tracker_multi_line=True)
    rows = runs.articles(spark, res["articles"])
    assert sorted(r.url for r in rows.collect()) == ["https://x/a1", "https://x/a3"]
    assert rows.select("article_id").distinct().count() == 2
    assert {(r.link, r.reason) for r in runs.reports(spark, res["articles"], "rejects", "link string, reason string").collect()} == {
        ("https://x/a2", "date"), ("https://x/b1", "feed"), ("https://x/s1", "feed")}
    jobs.post_job(spark, f"{root}/articles", f"{root}/outbox")
    assert [r.url for r in spark.read.parquet(f"{root}/outbox").collect()] == ["https://x/a3"]


@pytest.mark.parametrize("step", ["write_rows", "write_report", "stage_tracker", "commit", "publish"])
def test_killed_collect_run_is_run_again(spark, monkeypatch, step):
    """Each row is there once, the tracker never ahead of the articles, also
    when the job dies between the commit and the pointer."""
    root = tempfile.mkdtemp(prefix="again-")
    _feed_files(root)
    feeds = readers.read_feed_map(spark, f"{root}/map.json")

    def run(tracker, multi_line=False):
        entries, broken = readers.read_feed_files(spark, f"{root}/feeds", feeds)
        return jobs.collect_job(spark, tracker, entries, f"{root}/articles", f"{root}/out", "2024-02-01", tracker_multi_line=multi_line, broken=broken)

    def state():
        rows = runs.articles(spark, f"{root}/articles").collect()
        rejects = runs.reports(spark, f"{root}/articles", "rejects", "link string, reason string").collect()
        return sorted(r.url for r in rows), sorted((r.link, r.reason) for r in rejects)

    whole = (["https://x/a1"], [("https://x/a2", "date"), ("https://x/b1", "feed"), ("https://x/s1", "feed")])
    holder = runs if step in ("write_rows", "commit") else sinks
    with monkeypatch.context() as m:
        real = getattr(holder, step)

        def dying(*a, **k):
            if step not in ("commit", "publish"):
                real(*a, **k)
            raise RuntimeError("killed")

        m.setattr(holder, step, dying)
        with pytest.raises(RuntimeError):
            run(f"{root}/tracker.json", True)
    committed = step == "publish"
    assert state() == (whole if committed else ([], []))
    if committed:  # the next run reads the committed tracker, though no pointer names it
        run(f"{root}/out/tracker")
        assert state()[0] == whole[0]
    else:
        run(f"{root}/tracker.json", True)
        assert state() == whole
    path = runs.tracker_path(spark, f"{root}/articles", f"{root}/out/tracker")
    assert {b.blog_name: r.last_fetched for r in readers.read_tracker(spark, path).collect() for b in r.blogs} == {"A": "2024-02-01", "C": "2024-01-10"}


def test_merged_runs_hold_the_same_rows(spark):
    root = tempfile.mkdtemp(prefix="merge-")
    a = fx.articles(spark, SF_SMALL)
    sinks.append_article_rows(a.where("seq % 3 = 0"), f"{root}/articles")
    for k in (1, 2):
        run = runs.next_run(spark, f"{root}/articles", "part")
        runs.commit(spark, f"{root}/articles", run, {"articles": runs.write_rows(a.where(f"seq % 3 = {k}"), f"{root}/articles", run)})
    before = sorted(r.article_id for r in jobs.stored_articles(spark, f"{root}/articles").collect())
    assert len(before) == a.count() and runs.next_run(spark, f"{root}/articles", "part") == "part.0002"
    path = runs.merge_runs(spark, f"{root}/articles")
    assert sorted(r.article_id for r in jobs.stored_articles(spark, f"{root}/articles").collect()) == before
    assert [r.paths["articles"] for r in runs.log_of(spark, f"{root}/articles")] == [path]
    assert runs.find(spark, f"{root}/articles", "part.0001") is not None  # still known, so not taken again


def test_posting_reads_open_articles_only_after_a_merge(spark):
    """The same picks before and after merges; what a merge knew as posted is
    not read by the poster, and the whole table still holds it, marked."""
    from feedspark.operators.queue import next_to_post as picks
    roots = [tempfile.mkdtemp(prefix="open-") for _ in range(2)]
    a = fx.articles(spark, SF_SMALL)
    ids = lambda df: sorted(r.article_id for r in df.select("article_id").collect())
    for root in roots:
        sinks.append_article_rows(a, f"{root}/articles")
    plain, merged = roots
    for k in range(3):
        for root in roots:
            jobs.post_job(spark, f"{root}/articles", f"{root}/outbox", n=2)
        assert ids(spark.read.parquet(f"{plain}/outbox")) == ids(spark.read.parquet(f"{merged}/outbox"))
        if k < 2:
            runs.merge_runs(spark, f"{merged}/articles", f"{merged}/outbox")
            state = jobs.queue_state(spark, f"{merged}/articles", f"{merged}/outbox", whole=False)
            assert not any("-posted/" in f for f in state.inputFiles())
            assert runs.sent_since(spark, f"{merged}/articles", f"{merged}/outbox").count() == 0
            assert state.where("posted").count() == 0 and ids(picks(state)) == ids(picks(jobs.queue_state(spark, f"{plain}/articles", f"{plain}/outbox")))
    states = [jobs.queue_state(spark, f"{root}/articles", f"{root}/outbox") for root in roots]
    rows = [sorted((r.article_id, r.posted) for r in s.select("article_id", "posted").collect()) for s in states]
    assert rows[0] == rows[1] and len(rows[0]) == a.count()
    run = runs.next_run(spark, f"{merged}/articles", "more")  # new articles after a merge are open
    more = a.limit(3).withColumn("article_id", F.concat(F.lit("new|"), "article_id")).withColumn("posted", F.lit(False))
    runs.commit(spark, f"{merged}/articles", run, {"articles": runs.write_rows(more, f"{merged}/articles", run)})
    assert runs.open_articles(spark, f"{merged}/articles").where("article_id LIKE 'new|%'").count() == 3


def test_dedupe_option(spark):
    from feedspark.operators.collect import collect_batch
    e = fx.feed_entries(spark, SF_SMALL)
    twice = e.unionByName(e.withColumn("entry_id", F.col("entry_id") + 100000))
    t, a = fx.tracker(spark, SF_SMALL), fx.articles(spark, SF_SMALL)
    empty = a.filter(F.lit(False))
    plain = collect_batch(t, twice, empty, "2024-02-01").new_articles.count()
    dd = collect_batch(t, twice, empty, "2024-02-01", dedupe=True).new_articles.count()
    assert plain == 2 * dd == 2 * NEW
    # against the stored table, entries whose URL is already stored go too
    stored = collect_batch(t, twice, a, "2024-02-01", dedupe=True).new_articles
    own = ["community", "blog_name", "url"]  # each community has a list of its own
    assert stored.join(a.select(*own), own, "left_semi").count() == 0 < stored.count()


def test_bills_job_from_rss_files(spark):
    from xml.sax.saxutils import escape

    from feedspark import config
    root = tempfile.mkdtemp(prefix="bills-")
    items = fx.bill_items(spark, SF_SMALL).collect()      # 200 rows: test input only
    by_feed = {}
    for r in items:
        by_feed.setdefault(r.feed_url, []).append(
            f"<item><title>{escape(r.title)}</title><link>{escape(r.link)}</link>"
            f"<description>{escape(r.description)}</description><pubDate>{r.pubDate}</pubDate></item>")
    os.makedirs(f"{root}/rss")
    for f in config.BILL_FEEDS:
        with open(f"{root}/rss/{f.file}", "w") as fh:
            fh.write("<rss><channel>" + "".join(by_feed.get(f.feed_url, [])) + "</channel></rss>")
    fx.bill_pages(spark, SF_SMALL).write.parquet(f"{root}/pages")
    for _ in range(2):  # bills whose URL the queue holds are not appended again
        res = jobs.bills_job(spark, jobs.bill_items_from_files(spark, f"{root}/rss"), f"{root}/pages", f"{root}/out",
                             articles_root=f"{root}/articles")
    out = spark.read.json(res["bills"])
    n_enabled = sum(1 for r in items if r.feed_url != fx.catalog_url("Votes"))
    assert out.count() == n_enabled
    assert out.filter("type = 'Activity' AND bill_summary LIKE 'Part one %'").count() > 0
    stored = runs.articles(spark, f"{root}/articles")
    assert stored.count() == stored.select("article_id").distinct().count() == n_enabled
    jobs.post_job(spark, f"{root}/articles", f"{root}/outbox")
    posted = spark.read.parquet(f"{root}/outbox").collect()
    oldest = min(stored.collect(), key=lambda r: (r.published_at, r.run, r.seq))
    assert [(r.community, r.url) for r in posted] == [("politics", oldest.url)]
