"""Readers.  Fetching over HTTP is upstream of these:
feeds, trackers, article tables and pages are files or tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedspark import schemas
from feedspark.session import settle


# S1
def read_feed_items(spark: SparkSession, path: str, row_tag: str = "item",
                    schema=schemas.FEED_ITEM, strict: bool = False) -> DataFrame:
    """Every ``<item>`` of RSS documents at ``path`` (any depth), one row
    each, plus ``source_file`` and a stable ``entry_id``.  A missing child is
    null; ``strict=True`` keeps only items that have all four children (the
    reference raises on the first one that does not)."""
    df = (spark.read.format("xml").option("rowTag", row_tag)
          .option("ignoreSurroundingSpaces", "false")
          .schema(schema).load(path)
          .withColumn("source_file", F.col("_metadata.file_path"))
          .withColumn("entry_id", F.monotonically_increasing_id()))
    if strict:
        df = df.filter(F.greatest(*[F.col(f.name).isNull() for f in schema.fields]) == F.lit(False))
    return df


def read_atom_entries(spark: SparkSession, path: str) -> DataFrame:
    """Every Atom ``<entry>`` at ``path`` with the columns of
    ``read_feed_items``: the alternate link (or else the first), published or
    else updated, summary or else content."""
    df = (spark.read.format("xml").option("rowTag", "entry").option("ignoreSurroundingSpaces", "false")
          .schema(schemas.ATOM_ENTRY).load(path))
    return df.select(*_atom_columns("pubDate"), F.col("_metadata.file_path").alias("source_file"),
                     F.monotonically_increasing_id().alias("entry_id"))


def _atom_columns(date: str) -> list:
    links = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    link = F.coalesce(F.get(links, 0), F.get(F.col("link"), 0))["_href"]
    return ["title", link.alias("link"), F.coalesce("summary", "content").alias("description"),
            F.coalesce("published", "updated").alias(date)]


def read_feed_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Items of RSS files and entries of Atom files, as feed entries with the
    name of their file, and a row with ``broken`` for what a file holds that is
    no readable XML.  Within a file ``entry_id`` follows the feed's order."""
    def rows(tag, schema, select):
        schema = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
        df = (spark.read.format("xml").option("rowTag", tag).option("ignoreSurroundingSpaces", "false")
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).schema(schema).load(path))
        broken = F.col(BROKEN).isNotNull() & F.col("title").isNull()  # Spark reads the marker beside another column only
        return df.select(*select, F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), broken.alias("broken"))

    items = rows("item", schemas.FEED_ITEM, ["link", "title", "description", F.col("pubDate").alias("published")])
    entries = rows("entry", schemas.ATOM_ENTRY, _atom_columns("published"))
    return items.unionByName(entries).withColumn("entry_id", F.monotonically_increasing_id())


BROKEN = "_broken"


def read_entries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The feed entries of RSS and Atom files, with the name of their file."""
    return read_feed_rows(spark, path).where(~F.col("broken")).select("entry_id", "file", "link", "title", "description", "published")


def read_feed_files(spark: SparkSession, path: str | list[str], feed_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feed entries of RSS and Atom files, and the files that are broken
    (unreadable in part or as a whole; Spark's readers pass over files without a
    byte).  ``feed_map`` (file, feed_url) says which feed a file was fetched
    from; entries of other files have no feed.  The files are parsed once."""
    rows = settle(read_feed_rows(spark, path).join(feed_map, "file", "left"), "feed-rows")
    return rows.where(~F.col("broken")).drop("broken"), rows.where("broken").select("file").distinct()


def read_feed_map(spark: SparkSession, path: str) -> DataFrame:
    """Which feed a file was fetched from: JSON lines of (file, feed_url)."""
    return spark.read.schema("file string, feed_url string").json(path).distinct()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def holds(spark: SparkSession, pattern: str) -> bool:
    """Whether any path fits the glob ``pattern``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


# S2
def read_tracker(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Tracker JSON: one object per line (as ``write_tracker`` writes it), or
    with ``multi_line=True`` a file holding one object or an array of them."""
    return spark.read.schema(schemas.TRACKER).option("multiLine", multi_line).json(path)


# S3
def read_articles(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """``fmt``: parquet, json (one array a file) or json-lines."""
    reader = spark.read.schema(schemas.ARTICLE)
    if fmt == "json-lines":
        fmt = "json"
    elif fmt == "json":
        reader = reader.option("multiLine", True)
    return reader.format(fmt).load(path)


# Article files as the reference stores them: one JSON array of objects with
# blog_name, url, title, description, date_published (ISO) and posted.
STORED_ARTICLE = "blog_name string, url string, title string, description string, " \
                 "date_published string, posted boolean"


def import_article_file(spark: SparkSession, path: str, community: str, run: str = "") -> DataFrame:
    """Read an article file in the reference's format into the ARTICLE
    schema.  The array order is the stored order, so ``seq`` is the row's
    position in its file (one file is one task; ids increase in file order);
    the key holds the community and ``run`` (give each further file of a
    community its own); ``published_at`` is parsed from the ISO string."""
    from feedspark.functions.dates import parse_published
    from feedspark.operators.collect import article_key

    df = spark.read.schema(STORED_ARTICLE).option("multiLine", True).json(path)
    p = parse_published(F.col("date_published"))
    return df.select(
        F.monotonically_increasing_id().alias("seq"), F.lit(community).alias("community"),
        "blog_name", "url", "title", F.coalesce(F.col("description"), F.lit("")).alias("description"),
        "date_published", p["published_at"].alias("published_at"),
        F.coalesce(F.col("posted"), F.lit(False)).alias("posted"), F.lit(run).alias("run")).withColumn(
        "article_id", article_key("community", "blog_name", "run", "seq")).select(*schemas.ARTICLE.fieldNames())


# S4
def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("url", "html")
