"""Sinks.

Tables are never overwritten in place: each whole-table write goes to a new
version folder, and only then is a pointer row appended under
``<root>/_current``, so a failed or retried job never leaves a half-written
table behind, and the next run finds the newest whole version with
``current_path``.  Spark's file commit protocol makes each version folder, and
each pointer row, all-or-nothing.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.schemas import STORED_ORDER

POINTER = "_current"


def new_version_path(root: str) -> str:
    return f"{root.rstrip('/')}/v={time.strftime('%Y%m%dT%H%M%S')}-{time.time_ns() % 1_000_000:06d}"


def publish(spark: SparkSession, root: str, path: str) -> None:
    """Name ``path`` as the current version of ``root``."""
    (spark.createDataFrame([(time.time_ns(), path)], "at long, path string").coalesce(1)
     .write.mode("append").json(f"{root.rstrip('/')}/{POINTER}"))


def current_path(spark: SparkSession, root: str) -> str:
    """The newest published version of ``root``; ``root`` itself if it has
    never been written in versions."""
    from feedspark.sources.readers import exists

    pointer = f"{root.rstrip('/')}/{POINTER}"
    if not exists(spark, pointer):
        return root
    return spark.read.schema("at long, path string").json(pointer).agg(F.max_by("path", "at")).first()[0]


# K1
def write_articles(articles: DataFrame, root: str, fmt: str = "parquet",
                   partition_by: tuple = ("community",)) -> str:
    """Write the whole article table as a new version; returns its path.
    Partitioned by community so per-community jobs prune to one folder; rows
    are in stored order within each file.
    JSON output is UTF-8, non-ASCII text unescaped."""
    path = new_version_path(root)
    if tuple(partition_by) == ("community",) and {"community", *STORED_ORDER} <= set(articles.columns):
        articles = clustered(articles)  # as the writer wants the rows: one exchange and sort, instead of the caller's order and the writer's
    w = articles.write.mode("errorifexists").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    publish(articles.sparkSession, root, path)
    return path


def clustered(rows: DataFrame) -> DataFrame:
    """Rows dealt by ranges of (community, stored order), so that a large
    community, also one whose dates are all alike, fills many tasks, and in
    stored order within each file."""
    return rows.repartitionByRange("community", *STORED_ORDER).sortWithinPartitions("community", *STORED_ORDER)


def append_article_rows(rows: DataFrame, root: str) -> str:
    """Put rows directly under ``root`` (imports; jobs commit runs, see
    ``sources.runs``)."""
    clustered(rows).write.mode("append").partitionBy("community").parquet(root)
    return root


# K2
def write_tracker(tracker: DataFrame, root: str) -> str:
    """The advanced tracker (configuration: one file), written only after the
    articles that it covers."""
    path = stage_tracker(tracker, root)
    publish(tracker.sparkSession, root, path)
    return path


def stage_tracker(tracker: DataFrame, root: str) -> str:
    """A tracker version that is not published yet."""
    path = new_version_path(root)
    tracker.coalesce(1).write.mode("errorifexists").json(path)
    return path


def write_report(rows: DataFrame, root: str, run: str) -> str:
    """A run's rejects or late counts, in the run's folder under ``root``
    (what an earlier attempt has left there is overwritten)."""
    path = f"{root.rstrip('/')}/run={run}"
    rows.write.mode("overwrite").json(path)
    return path


# K3
def write_outbox(posts: DataFrame, root: str) -> str:
    """Append rendered posts to the outbox as a batch (named by the time),
    partitioned by community.  A separate delivery process reads new outbox files
    and posts them; readers that know a batch skip it and all before it."""
    batch = time.strftime("%Y%m%dT%H%M%S") + f"-{time.time_ns() % 1_000_000_000:09d}"
    posts.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch", "community").parquet(root)
    return root
