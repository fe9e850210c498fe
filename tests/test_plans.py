"""Physical plan shape: the properties the design relies on at scale."""

from conftest import SF_SMALL
from feedspark.operators import bills as B
from feedspark.operators.pages import page_content
from feedspark.operators.queue import next_to_post
from feedspark.operators.rank import rank_sentences
from feedspark.plans import fixtures as fx
from feedspark.plans.queries import queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_page_content_has_no_exchange(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    p = plan(page_content(pages))
    assert "Exchange" not in p


def test_next_to_post_limits_before_shuffle(spark):
    p = plan(next_to_post(fx.articles(spark, SF_SMALL)))
    part = p.index("WindowGroupLimit") if "Partial" in p else -1
    assert "Partial" in p and "Final" in p
    # the partial limit sits below (after, in text) the exchange on community
    assert p.rindex("Partial") > p.index("Exchange hashpartitioning(community")
    assert part >= 0


def test_catalog_is_broadcast(spark):
    p = plan(B.feed_type_join(fx.bill_items(spark, SF_SMALL), B.feed_catalog(spark)))
    assert "BroadcastHashJoin" in p


def test_ranking_shuffles_text_once(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    p = plan(rank_sentences(docs, with_text=False))
    assert p.count("Exchange") == 1 and "REPARTITION_BY_COL" in p


def test_summary_is_per_row(spark):
    from pyspark.sql import functions as F
    from feedspark.operators.summarize import article_summary
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    p = plan(docs.select(article_summary(F.col("text"))))
    assert "Exchange" not in p


def test_scan_prunes_columns(spark):
    p = plan(queries()["page_title"](spark, SF_SMALL))
    assert "ReadSchema: struct<page_id:bigint,html:string>" in p


def test_registered_queries_deal_nothing_round_robin(spark):
    for name in ("page_content", "article_summary", "split_sentences", "scan_pages", "text_chunks"):
        p = plan(queries()[name](spark, SF_SMALL))
        assert "RoundRobin" not in p and "Exchange" not in p, name


def test_union_of_bills_is_one_pass(spark):
    bills = B.bill_articles(fx.bill_items(spark, SF_SMALL), fx.bill_pages(spark, SF_SMALL), B.feed_catalog(spark), only_enabled=False)
    assert plan(B.union_feeds(bills)).count("Scan parquet") == plan(bills).count("Scan parquet")


def test_summarize_queue_reads_articles_for_the_picks_and_the_marks_only(spark):
    from feedspark.operators.summarize import summarize_queue
    out, _ = summarize_queue(fx.articles(spark, SF_SMALL), fx.table(spark, SF_SMALL, "pages").select("url", "html"))
    assert "documents.parquet" not in plan(out)  # the picks were found once and are read back
