"""Queue: stored order, ties, all posted, mark by URL; rendered layouts."""

import datetime as dt

from pyspark.sql import functions as F

from feedspark.operators.queue import mark_posted, mark_posted_by_url, next_to_post, render_posts
from feedspark.schemas import ARTICLE

T0 = dt.datetime(2024, 1, 1, 10, 0)


def _articles(spark, rows):
    full = [(f"{c}|{b}||{seq}", c, b, u, "T" + str(seq), "line1\nline2\r", "iso", ts, p, "", seq) for seq, c, b, u, ts, p in rows]
    return spark.createDataFrame(full, ARTICLE)


def test_ties_and_all_posted(spark):
    a = _articles(spark, [(5, "dnd", "b", "u5", T0, False), (3, "dnd", "b", "u3", T0, False),
                          (1, "dnd", "b", "u1", T0, True), (2, "nfl", "b", "u2", T0, True)])
    got = [(r.community, r.seq) for r in next_to_post(a).collect()]
    assert got == [("dnd", 3)]          # equal dates: lower seq first; nfl has nothing left
    assert sorted(r.seq for r in next_to_post(a, n=5).collect()) == [3, 5]


def test_mark_posted(spark):
    a = _articles(spark, [(1, "dnd", "b", "u", T0, False), (2, "dnd", "b", "u", T0, False),
                          (3, "dnd", "b", "v", T0, False)])
    marked = {r.seq: r.posted for r in mark_posted(a, next_to_post(a)).collect()}
    assert marked == {1: True, 2: False, 3: False}
    by_url = {r.seq: r.posted for r in mark_posted_by_url(a, a.filter("seq = 2").select("community", "url")).collect()}
    assert by_url == {1: True, 2: False, 3: False}   # first stored article with that URL


def test_render_layouts(spark):
    a = _articles(spark, [(i, c, "blog", "https://x/" + c, T0, False)
                          for i, c in enumerate(["dnd", "nfl", "politics", "science"])])
    posts = {r.community: r for r in render_posts(next_to_post(a), footers={"dnd": "F"}).collect()}
    assert posts["dnd"].title == "[Blog] T0"
    assert posts["dnd"].content == ("[Read full post by blog](https://x/dnd)\n\n-----\n\nline1 line2"
                                    "\n\n-----\n \nF")
    assert posts["nfl"].title == "[blog] T1"
    assert posts["politics"].content == "https://x/politics\n\nline1 line2"
    assert posts["science"].content == "https://x/science"


def test_compat_sort_orders_strings(spark):
    """ISO strings with mixed offsets are not in time order."""
    from feedspark.operators.collect import articles_by_date, dated_entries
    rows = [(1, "f", "a", "t", "d", "2024-01-01T09:00:00-05:00"),   # 14:00 UTC
            (2, "f", "b", "t", "d", "2024-01-01T12:00:00+00:00")]   # 12:00 UTC
    e = spark.createDataFrame(rows, "entry_id long, feed_url string, link string, title string, "
                                    "description string, published string")
    d = dated_entries(e).withColumn("seq", e["entry_id"]).withColumns({"run": F.lit(""), "article_id": F.col("link")})
    assert [r.link for r in articles_by_date(d).collect()] == ["b", "a"]               # by instant
    assert [r.link for r in articles_by_date(d, compat=True).collect()] == ["a", "b"]  # by string


def test_communities_keep_their_own_queue(spark):
    """Equal positions and equal URLs in two communities are two articles."""
    a = _articles(spark, [(0, "dnd", "b", "u", T0, False), (0, "nfl", "b", "u", T0, False),
                          (1, "dnd", "b", "v", T0, False), (1, "nfl", "b", "w", T0, False)])
    first = next_to_post(a)
    assert {r.article_id for r in first.collect()} == {"dnd|b||0", "nfl|b||0"}
    marked = {r.article_id for r in mark_posted(a, first.filter("community = 'dnd'")).filter("posted").collect()}
    assert marked == {"dnd|b||0"}
    by_url = {r.article_id for r in mark_posted_by_url(a, first).filter("posted").collect()}
    assert by_url == {"dnd|b||0", "nfl|b||0"}


def test_one_feed_of_two_blogs_gives_two_keys(spark):
    from feedspark.operators.collect import collect_batch
    tracker = spark.createDataFrame([("dnd", "2024-01-01", [("one", "u"), ("two", "u")])],
                                    "community string, last_fetched string, blogs array<struct<blog_name:string,rss_url:string>>")
    e = spark.createDataFrame([(7, "u", "l", "t", "d", "2024-01-05")], "entry_id long, feed_url string, link string, "
                              "title string, description string, published string")
    new = collect_batch(tracker, e, spark.createDataFrame([], ARTICLE), "2024-02-01").new_rows
    assert {r.article_id for r in new.collect()} == {"dnd|one|2024-02-01|7", "dnd|two|2024-02-01|7"}


def test_collected_text_is_written_once(spark, monkeypatch):
    """once=True: one scratch table, descriptions of new rows only; same results."""
    from conftest import SF_SMALL
    from feedspark.operators import collect as C
    from feedspark.plans import fixtures as fx
    seen = []
    real = C.settle

    def watched(df, name):
        seen.append(real(df, name))
        return seen[-1]

    monkeypatch.setattr(C, "settle", watched)
    args = fx.tracker(spark, SF_SMALL), fx.feed_entries(spark, SF_SMALL), fx.articles(spark, SF_SMALL), "2024-02-01"
    once, plain = C.collect_batch(*args, once=True), C.collect_batch(*args)
    rows = lambda df: sorted(map(str, df.collect()))
    for part in ("articles", "new_articles", "new_rows", "late", "rejects"):
        assert rows(getattr(once, part)) == rows(getattr(plain, part)), part
    assert len(seen) == 1
    assert seen[0].where("description IS NOT NULL").count() == once.new_rows.count() < seen[0].count()


def test_text_of_dated_documents_moves_once_unsorted(spark):
    from conftest import SF_SMALL
    from feedspark.plans import fixtures as fx
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = fx.articles(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert p.count("ShuffledHashJoin") == 2  # with the id's event and with its page
    assert p.count("text#") and not [x for x in p.split("\n") if " Sort " in x and "doc_id" in x]
    assert p.count("hashpartitioning(doc_id") == 3  # text, its narrow side's ids (distinct, then joined back)


def test_written_articles_are_sorted_once(spark, tmp_path):
    from conftest import SF_SMALL
    from feedspark.operators.collect import articles_by_date
    from feedspark.plans import fixtures as fx
    from feedspark.sources import sinks
    articles = fx.articles(spark, SF_SMALL)
    path = sinks.write_articles(articles_by_date(articles), str(tmp_path / "a"))
    assert sorted(map(str, spark.read.parquet(path).select(*articles.columns).collect())) == sorted(map(str, articles.collect()))
    plan = sinks.clustered(articles_by_date(articles))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1
