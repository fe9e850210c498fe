"""The reference's scripts as jobs over files.

    python -m feedspark.plans.jobs collect   --tracker T --feeds F --feed-map M --articles A --out O --run-date 2024-02-01
    python -m feedspark.plans.jobs stream    --tracker T --feeds F --feed-map M --articles A --out O
    python -m feedspark.plans.jobs post      --articles A --outbox X [--n 1]
    python -m feedspark.plans.jobs summarize --articles A --pages P --outbox X [--n 1]
    python -m feedspark.plans.jobs bills     --items I --pages P --articles A --out O
    python -m feedspark.plans.jobs merge     --articles A [--outbox X]

Nothing that is stored is rewritten: a run's new articles are committed with
its rejects, late counts and tracker by one row of the table's log
(``sources.runs``), so a job that died can simply be run again; and the outbox is
the record of what was posted: an article counts as posted by its stored flag or
by an outbox row with its key.  ``--rewrite`` (collect, post, summarize) writes
a whole new version of the article table in stored order instead, as the
reference rewrites its file.  ``merge`` rewrites the table's many small runs as
one.  What was written is printed as JSON.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark import schemas
from feedspark.operators import bills as B
from feedspark.operators import collect as C
from feedspark.operators import queue as Q
from feedspark.operators import summarize as U
from feedspark.session import ensure_utc, settle
from feedspark.sources import readers, runs, sinks


def stored_articles(spark: SparkSession, root: str) -> DataFrame:
    """The current article table: the committed runs; the newest version if
    it is written in versions; empty if nothing is stored yet."""
    path = sinks.current_path(spark, root)
    return readers.read_articles(spark, path) if path != root else runs.articles(spark, root)


def collect_job(spark, tracker_root, entries: DataFrame, articles_root, out_root, run_date, compat=False,
                dedupe=False, tracker_multi_line=False, rewrite=False, broken: DataFrame | None = None):
    """Collect one run: article rows, rejects, late counts and the tracker,
    committed together.  A job that died is run again with the same arguments;
    what it had written is overwritten.  ``tracker_multi_line=True`` for a
    tracker file holding one JSON object (or an array), as the reference
    stores it."""
    ensure_utc(spark)
    run = runs.next_run(spark, articles_root, run_date)
    tracker = readers.read_tracker(spark, runs.tracker_path(spark, articles_root, tracker_root), multi_line=tracker_multi_line)
    extra = ("file",) if "file" in entries.columns else ()
    r = C.collect_batch(tracker, entries, stored_articles(spark, articles_root), run_date, compat=compat, dedupe=dedupe, run=run,
                        once=True, extra=extra)
    if rewrite:
        out = {"articles": sinks.write_articles(r.articles, f"{out_root}/articles")}
    else:
        out = {"articles": runs.write_rows(r.new_rows, articles_root, run)}
    out |= {"rejects": sinks.write_report(C.with_broken(r.rejects, broken), f"{out_root}/rejects", run),
            "late": sinks.write_report(r.late, f"{out_root}/late", run),
            "tracker": sinks.stage_tracker(r.tracker, f"{out_root}/tracker")}
    runs.commit(spark, articles_root, run, {k: v for k, v in out.items() if not (rewrite and k == "articles")})
    sinks.publish(spark, f"{out_root}/tracker", out["tracker"])  # for readers without the log
    return out | {"run": run}


def queue_state(spark, articles_root, outbox_root, whole: bool = True) -> DataFrame:
    """Articles with ``posted`` as stored or as the outbox shows; without
    ``whole`` those only that the last merge did not know as posted."""
    versioned = sinks.current_path(spark, articles_root) != articles_root
    articles = stored_articles(spark, articles_root) if whole or versioned else runs.open_articles(spark, articles_root)
    sent = runs.sent_since(spark, articles_root, outbox_root)
    if sent is None:
        return articles
    sent = sent.withColumnRenamed("article_id", "_sent")
    return (articles.join(sent, articles["article_id"] == sent["_sent"], "left")
            .withColumn("posted", F.coalesce(F.col("posted"), F.lit(False)) | F.col("_sent").isNotNull())
            .drop("_sent"))


def post_job(spark, articles_root, outbox_root, out_root=None, n=1, footers=None):
    """Render the next articles into the outbox; with ``out_root`` also write
    the marked article table as a new version."""
    ensure_utc(spark)
    state = queue_state(spark, articles_root, outbox_root, whole=bool(out_root))
    picked = settle(Q.next_to_post(state, n=n), "picked")
    marked = Q.mark_posted(state, picked) if out_root else None
    if out_root:  # before the outbox grows: the state reads it
        path = sinks.write_articles(marked, f"{out_root}/articles")
    sinks.write_outbox(Q.render_posts(picked, footers=footers), outbox_root)
    return {"outbox": outbox_root} | ({"articles": path} if out_root else {})


def summarize_job(spark, articles_root, pages_path, outbox_root, out_root=None, n=1, hook=None):
    ensure_utc(spark)
    state = queue_state(spark, articles_root, outbox_root, whole=bool(out_root))
    outbox, marked = U.summarize_queue(state, readers.read_pages(spark, pages_path), n=n, hook=hook)
    outbox = settle(outbox.select("community", "title", "content", "url", "article_id"), "outbox")
    if out_root:
        path = sinks.write_articles(marked, f"{out_root}/articles")
    sinks.write_outbox(outbox, outbox_root)
    return {"outbox": outbox_root} | ({"articles": path} if out_root else {})


def bill_items_from_files(spark, items_path) -> DataFrame:
    """RSS items of the bill feeds; each file is mapped to its feed URL by the
    catalog's file name (the catalog is a handful of rows: broadcast)."""
    items = readers.read_feed_items(spark, items_path)
    cat = B.feed_catalog(spark).select("feed_url", "file")
    named = items.withColumn("file", F.element_at(F.split(F.col("source_file"), "/"), -1))
    return (named.join(F.broadcast(cat), "file")
                 .select(F.col("entry_id").alias("seq"), "feed_url", "title", "link", "description", "pubDate"))


def bills_job(spark, items: DataFrame, pages_path, out_root, only_enabled=True, articles_root=None, run="bills"):
    """Enriched bills, newest first; with ``articles_root`` the bills whose
    URL the queue does not hold yet are appended to the article table."""
    ensure_utc(spark)
    pages = readers.read_pages(spark, pages_path)
    path = sinks.new_version_path(f"{out_root}/bills")
    B.bills_newest_first(B.bill_articles(items, pages, B.feed_catalog(spark), only_enabled)).write.mode("errorifexists").json(path)
    sinks.publish(spark, f"{out_root}/bills", path)
    if not articles_root:
        return {"bills": path}
    bills = spark.read.schema(B.BILL_SCHEMA).json(path)
    name = runs.next_run(spark, articles_root, run)
    known = stored_articles(spark, articles_root).select("community", "url")
    rows = B.bill_to_article(bills, run=name).join(known, ["community", "url"], "left_anti")
    out = {"articles": runs.write_rows(rows.select(*schemas.ARTICLE.fieldNames()), articles_root, name)}
    runs.commit(spark, articles_root, name, out)
    return {"bills": path} | out


def stream_job(spark, tracker_root, feeds_path, feed_map: DataFrame, articles_root, out_root, tracker_multi_line=False):
    """Drain the feed files that arrived since the last call: each entry lands
    once, in the article table or in the rejects."""
    from feedspark.streaming.collect_stream import start_feed_files

    ensure_utc(spark)
    tracker = readers.read_tracker(spark, runs.tracker_path(spark, articles_root, tracker_root), multi_line=tracker_multi_line)
    start_feed_files(spark, feeds_path, feed_map, tracker, articles_root, out_root, f"{out_root}/checkpoint").awaitTermination()
    return {"articles": articles_root, "rejects": f"{out_root}/rejects", "late": f"{out_root}/late"}


NEEDS = {"collect": ("tracker", "feeds", "feed_map", "articles", "out", "run_date"),
         "stream": ("tracker", "feeds", "feed_map", "articles", "out"), "post": ("articles", "outbox"),
         "summarize": ("articles", "pages", "outbox"), "bills": ("items", "pages", "out"), "merge": ("articles",)}


def main(argv=None):
    ap = argparse.ArgumentParser(prog="feedspark-jobs")
    ap.add_argument("job", choices=sorted(NEEDS))
    for name in ("tracker", "feeds", "feed-map", "articles", "pages", "items", "outbox", "out", "run-date"):
        ap.add_argument(f"--{name}")
    ap.add_argument("--n", type=int, default=1)
    for name in ("compat", "dedupe", "tracker-multiline", "rewrite"):
        ap.add_argument(f"--{name}", action="store_true")
    a = ap.parse_args(argv)
    if missing := [f"--{n.replace('_', '-')}" for n in NEEDS[a.job] + (("out",) if a.rewrite else ()) if not getattr(a, n)]:
        ap.error(f"{a.job} needs {', '.join(missing)}")
    spark = SparkSession.builder.appName(f"feedspark-{a.job}").getOrCreate()
    out = a.out if a.rewrite else None
    if a.job == "collect":
        entries, broken = readers.read_feed_files(spark, a.feeds, readers.read_feed_map(spark, a.feed_map))
        res = collect_job(spark, a.tracker, entries, a.articles, a.out, a.run_date, a.compat, a.dedupe, a.tracker_multiline, a.rewrite, broken)
    elif a.job == "stream":
        res = stream_job(spark, a.tracker, a.feeds, readers.read_feed_map(spark, a.feed_map), a.articles, a.out, a.tracker_multiline)
    elif a.job == "post":
        res = post_job(spark, a.articles, a.outbox, out, a.n)
    elif a.job == "summarize":
        res = summarize_job(spark, a.articles, a.pages, a.outbox, out, a.n)
    elif a.job == "merge":
        res = {"articles": runs.merge_runs(spark, a.articles, a.outbox)}
    else:
        res = bills_job(spark, bill_items_from_files(spark, a.items), a.pages, a.out, articles_root=a.articles)
    print(json.dumps(res))


if __name__ == "__main__":
    main()
