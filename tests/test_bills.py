"""Bill enrichment: the cases where the reference fails give empty strings."""

import hashlib

from feedspark import config
from feedspark.operators import bills as B

SITE = config.BILL_SITE
ACT, VOTES, NEW = (f.feed_url for f in config.BILL_FEEDS)


def _items(spark, rows):
    return spark.createDataFrame(
        [(seq, feed, "t", link, desc, "Mon, 01 Jan 2024 10:00:00 +0000") for seq, feed, link, desc in rows],
        "seq long, feed_url string, title string, link string, description string, pubDate string")


def test_enrichment_edge_cases(spark):
    pages = spark.createDataFrame([
        ("https://b/1?x", '<div id="content"><div><p>deep</p></div><p>own 1</p></div>'),
        ("https://b/1/summary", '<div id="libraryofcongress"><p>s1</p><p>s2</p></div>'),
        ("https://b/2", "<p>no content element</p>"),
        ("https://b/3", '<div id="content"><p>o3</p><div id="vote_explainer"><a href="/e3">x</a></div></div>'),
        (SITE + "/e3", '<div id="content"><div><p>explained</p></div></div>'),
        ("https://b/4", '<div id="content"><p>o4</p><div id="vote_explainer">no link</div></div>'),
    ], "url string, html string")
    items = _items(spark, [
        (1, ACT, "https://b/1?x", "Last Action: a Explanation: b"),
        (2, ACT, "https://b/2", "Last Action: a"),
        (3, VOTES, "https://b/3", "Vote: Passed 1/1"),
        (4, VOTES, "https://b/4", "Vote:"),
        (5, NEW, "https://b/none", "d"),
    ])
    got = {r.seq: r for r in B.bill_articles(items, pages, B.feed_catalog(spark), only_enabled=False).collect()}
    assert (got[1].bill_overview, got[1].bill_summary, got[1].bill_text) == ("own 1", "s1 s2", "https://b/1/text")
    assert (got[1].last_action, got[1].next_step) == ("a", "b")
    assert (got[2].bill_overview, got[2].bill_summary, got[2].last_action) == ("", "", None)
    assert (got[3].bill_overview, got[3].vote_result) == ("explained", "Passed 1/1")
    assert (got[4].bill_overview, got[4].vote_result) == ("", None)
    assert (got[5].bill_overview, got[5].bill_summary, got[5].pub_date) == ("", "", "2024-01-01 10:00:00")
    # only enabled feeds by default: the Votes items go
    assert {r.seq for r in B.bill_articles(items, pages, B.feed_catalog(spark)).collect()} == {1, 2, 5}


def test_duplicate_page_urls_pick_smallest_md5(spark):
    htmls = ['<div id="content"><p>first</p></div>', '<div id="content"><p>second</p></div>']
    pages = spark.createDataFrame([("https://b/9", h) for h in htmls], "url string, html string")
    items = _items(spark, [(9, NEW, "https://b/9", "d")])
    got = B.bill_articles(items, pages, B.feed_catalog(spark)).first()
    win = min(htmls, key=lambda h: hashlib.md5(h.encode()).hexdigest())
    assert got.bill_overview == ("first" if "first" in win else "second")
