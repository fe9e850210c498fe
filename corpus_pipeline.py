"""The corpus pipeline: documents through the stages of STAGES.

Each stage takes the rows that its predecessor kept, written as Parquet and
read again; all but the last return the columns of documents.  SQL cannot
express the trained networks, so there is no oracle; ``tests/llm`` holds each
stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.llm import language, toxicity
from feedspark.llm.common import crc32_mod3, fresh, materialize, table
from feedspark.llm.mixing import MixParams, mixed_documents
from feedspark.llm.near_dup import NearDupParams, keep_one
from feedspark.llm.packing import PackParams, pack

#: A document whose pooled language probability is lower is in no known language.
LEAST_LANGUAGE_SCORE = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold stay (null texts: no evidence)."""
    p, own = toxicity.ToxicityParams(), crc32_mod3(F.col("doc_id")) != 1
    model = toxicity.learn(docs.where(own), table(spark, sf_dir, "labels").where(own), params=p)
    score = fresh(docs, "_score")
    return docs.withColumn(score, toxicity.score_column(model, "text", p)).where(F.col(score) < p.threshold).drop(score)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no learned language, go."""
    p = language.LanguageParams()
    net, langs = language.learn(docs.where(crc32_mod3(F.col("doc_id")) != 1), "doc_id", "text", "lang", p)
    if net is None:  # nothing to learn from: only the letters decide
        return docs.where(language.has_letter(F.col("text")))
    pred, score = fresh(docs, "_pred"), fresh(docs, "_score")
    found = language.identify(docs, net, langs, "text", pred, score, p)
    return found.where((F.col(pred) != language.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).drop(pred, score)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (similarity 0.8)."""
    return keep_one(docs, params=NearDupParams(percent=80, agree=58))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document; n_chars follows them."""
    out = mixed_documents(docs, params=MixParams())
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack(docs, params=PackParams())


STAGES = [("toxicity", drop_toxic), ("language", known_language), ("near_dup", near_dup), ("mixing", mix_sources), ("packing", pack_sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
