"""Incremental feed collection as a stream.

The reference polls with a stored date and skips anything dated on or
before it.  A file stream replaces that date: the source's checkpoint
records which feed files were already read, so every new file is processed
exactly once and nothing is dropped for being dated "too early".

``start_feed_files`` streams the names of new files; each batch reads its RSS and
Atom files like the batch job (same readers, same chain without the date filter
F2) and lands them in several sinks: articles, rejects (feed, no date, date,
document) and the counts of entries behind the tracker's date (L1).  A batch is
one run of the article table (``sources.runs``), named by the query and the batch
number.  A batch that died before its commit is run again by Spark with the same
files and number and overwrites what is there; one that died after it is
recognised and skipped.  So each entry lands once.

``start_entries`` does the same for a stream of entries that are rows already.
``start_collect_stream`` writes the articles of such a stream to a plain file
sink, optionally without re-published entries (an event-time watermark with
``dropDuplicatesWithinWatermark``; off by default: the reference keeps
duplicates).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.operators.collect import (all_entries, dated_entries, entries_with_feed, explode_feeds, key_new, late_entries, rejects,
                                         to_articles, usable_entries, with_broken)
from feedspark.session import scratch_path, settle
from feedspark.sources import readers, runs, sinks

ENTRY_COLUMNS = ["entry_id", "feed_url", "link", "title", "description", "published"]


def article_stream(entries_stream: DataFrame, tracker: DataFrame, compat: bool = False,
                   dedupe_delay: str | None = None) -> DataFrame:
    """Streaming entries -> rows of the article table (stream-static join to
    the feeds).  Their run is ``stream``; the entry id completes the key."""
    arts = to_articles(dated_entries(entries_with_feed(entries_stream, explode_feeds(tracker)), compat=compat))
    arts = arts.filter(F.col("published_at").isNotNull())
    if dedupe_delay:
        arts = (arts.withWatermark("published_at", dedupe_delay)
                    .dropDuplicatesWithinWatermark(["community", "blog_name", "url"]))
    return key_new(arts, "stream")


def _land(spark: SparkSession, entries: DataFrame, tracker: DataFrame, articles_root: str, out_root: str, run: str,
          key: str | None = None, broken: DataFrame | None = None, compat: bool = False) -> None:
    """Write one batch to its sinks and commit it.  ``key`` names the run in
    the rows' keys, where ``entry_id`` is unique beyond the batch."""
    found = settle(all_entries(entries, explode_feeds(tracker), compat), "stream-entries")
    usable = usable_entries(found)
    extra = ("file",) if "file" in entries.columns else ()
    paths = {"articles": runs.write_rows(key_new(to_articles(usable), key or run), articles_root, run),
             "rejects": sinks.write_report(with_broken(rejects(found, extra), broken), f"{out_root}/rejects", run),
             "late": sinks.write_report(late_entries(usable), f"{out_root}/late", run)}
    runs.commit(spark, articles_root, run, paths)


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The name that the checkpoint gives its query for good."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]


def _each_batch(spark: SparkSession, checkpoint: str, articles_root: str, land):
    """``land(batch, run)``, unless the batch's run is committed already."""
    def batch_of(batch: DataFrame, number: int) -> None:
        run = f"stream-{_query_id(spark, checkpoint)[:8]}.{number:08d}"
        if runs.find(spark, articles_root, run) is None:
            land(batch, run)

    return batch_of


def _start(writer, checkpoint: str, available_now: bool):
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


FILES = "path string, modificationTime timestamp, length long, content binary"


def start_feed_files(spark: SparkSession, landing: str, feed_map: DataFrame, tracker: DataFrame, articles_root: str, out_root: str,
                     checkpoint: str, compat: bool = False, available_now: bool = True, files_per_batch: int = 10_000):
    """Collect the RSS and Atom files that arrive in ``landing``.  Of a batch
    the driver sees the names of its files, at most ``files_per_batch``."""
    names = (spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).load(landing).select("path"))

    def land(batch: DataFrame, run: str) -> None:
        paths = sorted(r["path"] for r in batch.collect())
        if paths:
            entries, broken = readers.read_feed_files(spark, paths, feed_map)
            _land(spark, entries, tracker, articles_root, out_root, run, broken=broken, compat=compat)

    return _start(names.writeStream.foreachBatch(_each_batch(spark, checkpoint, articles_root, land)), checkpoint, available_now)


def start_entries(spark: SparkSession, entries_stream: DataFrame, tracker: DataFrame, articles_root: str, out_root: str,
                  checkpoint: str, compat: bool = False, available_now: bool = True):
    """Collect a stream of entries that carry an ``entry_id`` of their own."""
    def land(batch: DataFrame, run: str) -> None:
        _land(spark, batch, tracker, articles_root, out_root, run, key="stream", compat=compat)

    return _start(entries_stream.writeStream.foreachBatch(_each_batch(spark, checkpoint, articles_root, land)), checkpoint, available_now)


def start_collect_stream(spark: SparkSession, landing: str, schema, tracker: DataFrame,
                         sink: str, checkpoint: str, compat: bool = False,
                         dedupe_delay: str | None = None, available_now: bool = True,
                         fmt: str = "parquet", options: dict | None = None):
    """Start the collector over files of entries arriving in ``landing``."""
    reader = spark.readStream.format(fmt).schema(schema)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    arts = article_stream(reader.load(landing), tracker, compat, dedupe_delay)
    writer = (arts.writeStream.format("parquet").partitionBy("community").option("checkpointLocation", checkpoint)
              .outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(sink)


def collect_stream_once(spark: SparkSession, entries: DataFrame, tracker: DataFrame, compat: bool = False) -> DataFrame:
    """Land ``entries`` as files (as many as the input has partitions), drain
    them through the stream, and return the article table."""
    root = scratch_path(spark, "stream")
    land = entries.select(*ENTRY_COLUMNS)
    land.write.parquet(f"{root}/landing")
    stream = spark.readStream.schema(land.schema).parquet(f"{root}/landing")
    start_entries(spark, stream, tracker, f"{root}/articles", root, f"{root}/checkpoint", compat=compat).awaitTermination()
    return runs.articles(spark, f"{root}/articles")
