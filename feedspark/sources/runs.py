"""Committed runs of the article table (K1, K2, ST1, ST2).

A run writes its article rows to a folder of its own under the table's root,
its rejects, late counts and tracker under the output root, and then one row to
the table's log.  That row, written last and all-or-nothing, is what makes the
run part of the table: readers take the folders that the log names and no
others.  A run that dies before it leaves folders that nobody reads; the next
attempt has the same name (runs of a name are numbered by what is committed) and
overwrites them.  So after any number of failures each row is there once, and the
tracker never gets ahead of the articles.

``merge_runs`` rewrites the folders of many small runs as one, in stored order, and
logs it as the new beginning.  With the outbox it folds in what was posted: open
articles go to one folder, those posted since the last merge to another that is
never written again, and the outbox up to there need not be read any more.  So the
poster reads open articles and the outbox since the last merge (``open_articles``,
``sent_since``), whatever the table's age.  One writer at a time per table.
"""

from __future__ import annotations

import functools
import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark import schemas
from feedspark.session import settle
from feedspark.sources import readers, sinks

LOG = "_runs"
LOG_SCHEMA = "run string, at long, replaces boolean, paths map<string,string>"


@dataclass(frozen=True)
class Run:
    run: str
    at: int
    replaces: bool
    paths: dict[str, str] = field(default_factory=dict)


def log_of(spark: SparkSession, root: str) -> list[Run]:
    """The committed runs of the table at ``root``, oldest first: one row a
    run since the last merge, a few bytes each."""
    path = f"{root.rstrip('/')}/{LOG}"
    if not readers.exists(spark, path):
        return []
    runs = sorted((Run(r["run"], r["at"], r["replaces"], dict(r["paths"] or {})) for r in spark.read.schema(LOG_SCHEMA).json(path).collect()),
                  key=lambda r: r.at)
    begin = max((k for k, r in enumerate(runs) if r.replaces), default=0)
    return runs[begin:]


def find(spark: SparkSession, root: str, run: str) -> Run | None:
    """The committed run of that name, also one that a merge has replaced."""
    path = f"{root.rstrip('/')}/{LOG}"
    if not readers.exists(spark, path):
        return None
    row = spark.read.schema(LOG_SCHEMA).json(path).where(F.col("run") == run).orderBy("at").first()
    return row and Run(row["run"], row["at"], row["replaces"], dict(row["paths"] or {}))


def next_run(spark: SparkSession, root: str, name: str) -> str:
    """``name`` with the number of its committed runs: a retry of a run that
    did not commit gets the same name again."""
    path = f"{root.rstrip('/')}/{LOG}"
    done = spark.read.schema(LOG_SCHEMA).json(path).where(F.col("run").startswith(name + ".")).count() if readers.exists(spark, path) else 0
    return f"{name}.{done:04d}"


def folder_of(root: str, run: str) -> str:
    return f"{root.rstrip('/')}/batch={re.sub(r'[^A-Za-z0-9.-]', '_', run)}"


def write_rows(rows: DataFrame, root: str, run: str) -> str:
    """The article rows of an uncommitted run (a leftover is overwritten)."""
    path = folder_of(root, run)
    sinks.clustered(rows).write.mode("overwrite").partitionBy("community").parquet(path)
    return path


def commit(spark: SparkSession, root: str, run: str, paths: dict[str, str], replaces: bool = False) -> None:
    """Make the run part of the table; ``paths['articles']`` holds its rows."""
    (spark.createDataFrame([(run, time.time_ns(), replaces, paths)], LOG_SCHEMA).coalesce(1)
     .write.mode("append").json(f"{root.rstrip('/')}/{LOG}"))


def _read(spark: SparkSession, root: str, folders: list[str], direct: bool) -> DataFrame:
    """Rows of ``folders``, and those that lie directly under ``root``."""
    own = [p for p in folders if readers.exists(spark, p)]
    loose = [f"{root.rstrip('/')}/community=*"] * (direct and readers.holds(spark, f"{root.rstrip('/')}/community=*"))
    parts = [spark.read.schema(schemas.ARTICLE).option("basePath", root).parquet(*paths).select(*schemas.ARTICLE.fieldNames())
             for paths in (loose, own) if paths]  # the folders differ in depth
    return functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schemas.ARTICLE)


def _done(runs: list[Run]) -> list[str]:
    """Folders of articles that were posted before the last merge."""
    return [p for p in (runs[0].paths.get("posted", "") if runs else "").split("|") if p]


def articles(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all committed runs; before the first merge also rows that
    were put directly under ``root`` (an imported table)."""
    runs = log_of(spark, root)
    return _read(spark, root, [r.paths["articles"] for r in runs if r.paths.get("articles")] + _done(runs), not (runs and runs[0].replaces))


def open_articles(spark: SparkSession, root: str) -> DataFrame:
    """``articles`` without those that the last merge knew as posted."""
    runs = log_of(spark, root)
    return _read(spark, root, [r.paths["articles"] for r in runs if r.paths.get("articles")], not (runs and runs[0].replaces))


def sent_since(spark: SparkSession, root: str, outbox_root: str) -> DataFrame | None:
    """Keys (article_id) of the outbox batches that no merge has folded in."""
    if not readers.exists(spark, outbox_root):
        return None
    runs = log_of(spark, root)
    upto = runs[0].paths.get("outbox_upto", "") if runs else ""
    return spark.read.parquet(outbox_root).where(F.col("batch") > F.lit(upto)).select("article_id").distinct()


def reports(spark: SparkSession, root: str, kind: str, schema) -> DataFrame:
    """Rejects or late counts (``kind``) of all committed runs, with the run."""
    parts = [(r.run, r.paths[kind]) for r in log_of(spark, root) if r.paths.get(kind) and readers.exists(spark, r.paths[kind])]
    out = spark.createDataFrame([], schema).withColumn("run", F.lit(""))
    if not parts:
        return out
    names = spark.createDataFrame([(p.rstrip("/").rsplit("/", 1)[-1], run) for run, p in parts], "_folder string, run string")
    rows = spark.read.schema(schema).json([p for _, p in parts]).withColumn("_folder", F.element_at(F.split("_metadata.file_path", "/"), -2))
    return rows.join(names, "_folder").select(*out.columns)


def tracker_path(spark: SparkSession, root: str, tracker_root: str) -> str:
    """The tracker that the newest committed run has left under
    ``tracker_root``; else what is published there."""
    own = [r.paths["tracker"] for r in log_of(spark, root) if r.paths.get("tracker", "").startswith(tracker_root.rstrip("/") + "/")]
    return own[-1] if own else sinks.current_path(spark, tracker_root)


def merge_runs(spark: SparkSession, root: str, outbox_root: str | None = None) -> str:
    """Write the rows that are not known as posted as one folder in stored
    order, with ``outbox_root`` those that were posted since as another, and make
    both the table's beginning; the old folders stay until their retention
    ends.  Returns the folder of open articles."""
    before, run = log_of(spark, root), next_run(spark, root, "merged")
    rows, done, upto = open_articles(spark, root), _done(before), (before[0].paths.get("outbox_upto", "") if before else "")
    sent = sent_since(spark, root, outbox_root) if outbox_root else None
    paths = {}
    if sent is not None:
        upto = spark.read.parquet(outbox_root).agg(F.max("batch")).first()[0] or upto
        rows = rows.join(sent.withColumn("_sent", F.lit(True)), "article_id", "left")
        rows = rows.withColumn("posted", F.coalesce("posted", F.lit(False)) | F.coalesce("_sent", F.lit(False))).select(*schemas.ARTICLE.fieldNames())
        rows = settle(rows, "marked")
        done = [*done, write_rows(rows.where("posted"), root, f"{run}-posted")]
        rows = rows.where("NOT posted")
    paths["articles"] = write_rows(rows, root, run)
    trackers = [r.paths["tracker"] for r in before if "tracker" in r.paths]
    paths |= {"posted": "|".join(done), "outbox_upto": upto} | ({"tracker": trackers[-1]} if trackers else {})
    commit(spark, root, run, paths, replaces=True)
    return paths["articles"]
