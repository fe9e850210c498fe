"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.llm.backoff import BackoffParams, score_texts
from feedspark.llm.common import crc32_mod3, table
from feedspark.llm.language import LanguageParams, identify, learn
from feedspark.llm.licences import oracle as licence_oracle
from feedspark.llm.licences import scan
from feedspark.llm.mixing import MixParams, digest, mix
from feedspark.llm.near_dup import NearDupParams, near_duplicates
from feedspark.llm.neighbours import NeighbourParams, nearest
from feedspark.llm.packing import PackParams, pack
from feedspark.llm.quality import apply_rules, base_rule, default_rules
from feedspark.llm.resampling import ResampleParams, resample
from feedspark.llm.sharding import ShardParams, assign
from feedspark.llm.token_counts import apply_edits, build_trees, edit
from feedspark.llm.toxicity import ToxicityParams, score_column
from feedspark.llm.toxicity import learn as learn_toxicity
from feedspark.llm.whitening import WhitenParams, whiten


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(mix(table(spark, sf_dir, "documents"), params=MixParams(weights=(5, 2, 1), share=1.5, most=2.0)))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net, langs = learn(docs.where(crc32_mod3(F.col("doc_id")) != 1), "doc_id", "text", "lang", LanguageParams())
    held_out = F.coalesce(crc32_mod3(F.col("doc_id")) == 1, F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", held_out, "text"), net, langs).drop("text")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), params=PackParams(length=2048))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    own, p = crc32_mod3(F.col("doc_id")), ToxicityParams()
    model = learn_toxicity(docs.where(own != 1), table(spark, sf_dir, "labels").where(own != 1), params=p)
    return (docs.select("doc_id", F.coalesce(own == 1, F.lit(False)).alias("held_out"), score_column(model, "text", p).alias("score"))
            .withColumn("predicted", (F.col("score") >= p.threshold).cast("int")))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    metadata = {"id": F.col("doc_id"), "length": F.log2(F.octet_length("text") + 1), "source": F.crc32("source"), "lang": F.crc32("lang")}
    return (assign(docs, metadata, params=ShardParams(shards=24))
            .withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
            .select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), params=NeighbourParams(k=5))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), params=NearDupParams(percent=85))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of all documents, and three edits of each, at places that follow
    from its id: a word is put in, a passage is cut, the beginning is repeated
    at the end."""
    docs = table(spark, sf_dir, "documents")
    n = F.length("text")
    place = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(n, F.lit(1)))
    edits = F.array(edit(place(1), F.lit(3), F.coalesce("source", F.lit(""))), edit(place(2), F.lit(120), F.lit("")),
                    edit(n + 1000, F.lit(0), F.substring("text", 1, 200)))
    done = apply_edits(build_trees(docs.select("doc_id", "text", edits.alias("edits"))))
    return done.select("doc_id", "tokens_before", "tokens_after", F.length("text_after").cast("long").alias("chars_after"), "reencoded_chars",
                       F.crc32("text_after").alias("text_crc32"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    figures = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    found = apply_rules(docs, default_rules())
    return found.select(*figures, base_rule().alias("base_failed"), (F.col("kept") & ~base_rule()).alias("kept"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), params=ResampleParams(percent=5, least_words=20))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), params=WhitenParams(components=4, scale=256))


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % 7 == 2, F.lit(False))
    scored = score_texts(docs, ~held_out("doc_id"), params=BackoffParams(order=2))
    return scored.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_licences": op2_licences,
    "op3_language": op3_language,
    "op4_pack": op4_pack,
    "op5_toxicity": op5_toxicity,
    "op6_shards": op6_shards,
    "op7_neighbours": op7_neighbours,
    "op8_near_dup": op8_near_dup,
    "op9_token_counts": op9_token_counts,
    "op10_quality": op10_quality,
    "op11_resample": op11_resample,
    "op12_whiten": op12_whiten,
    "op13_lm_scores": op13_lm_scores,
}
ORACLES: dict[str, str] = {
    "op2_licences": licence_oracle(),
    "op7_neighbours": """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END), 'sum') = 0
    AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END), 'sum') > 0
), n AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS len FROM v
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (q.len * c.len) AS score
  FROM n q JOIN n c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_quality": r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), f AS (
  SELECT doc_id, text, words, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         len(string_split(text, chr(10))) AS all_lines
  FROM w
), spans AS (
  SELECT doc_id, i, words[i:i + 4] AS five FROM (SELECT doc_id, words, unnest(range(1, n_words - 3)) AS i FROM f)
), again AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS c FROM spans
), covered AS (
  SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS own FROM again WHERE c > 1
), r AS (
  SELECT doc_id, sum(own)::BIGINT AS n FROM covered GROUP BY doc_id
), g AS (
  SELECT f.doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, all_lines, text
  FROM f LEFT JOIN r USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR n_repeat_words * 100 > n_words * 20) AS base_failed,
       NOT (n_words < 10 OR n_repeat_words * 100 > n_words * 20 OR n_symbols * 10 > word_chars
            OR word_chars < n_words * 2 OR word_chars > n_words * 25 OR n_dup_lines * 2 > all_lines
            OR length(regexp_replace(text, '[^\p{L}]', '', 'g')) * 2 < word_chars) AS kept
FROM g""",
}
