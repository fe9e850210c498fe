"""Importance resampling of documents towards a target distribution.

A text's features are its runs of 1 to 3 words, hashed into buckets.  Bucket
counts of the whole corpus and of the target texts give each bucket a gain (the
log ratio of the smoothed shares); the gains are an array of fixed length, and
a document's weight is the sum of the array's entries at its features.  With a
Gumbel variate drawn from the id added, the highest scores are a sample without
replacement in proportion to the importance weights.

The draw is a parallel sort by regular sampling:

1. the scores of each partition are sorted: a run;
2. regular samples of all runs (every ``stride``-th entry) give regular
   splitters, which cut the runs into segments;
3. segments are exchanged and merged by one task each; the number of entries
   in the segments before it gives every entry its exact rank.

Segments that lie behind the last drawn rank are neither exchanged nor merged.
The driver sees the bucket counts (``buckets`` numbers), at most
``segments ** 2`` samples and one count a segment, at any corpus size.  Equal
keys are told apart by the row, so that they split over segments too.

Defined results: a null text has no feature and weight 0.  A null id draws its
variate from the text ``42:`` and stands behind all other ids in a tie.
Repeated rows are rows of their own, with equal scores and different ranks.
Without documents or target texts the formula holds with zero counts.  Extra
columns are left alone.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedspark.llm.common import bounded_batches, chunks, fresh, giving_back, lower_ascii, materialize, text_bytes, words_of


@dataclass(frozen=True)
class ResampleParams:
    buckets: int = 10_000
    grams: int = 3
    scale: int = 1000
    seed: int = 42
    #: Share of the documents with at least ``least_words`` words that is drawn.
    percent: int = 5
    least_words: int = 20
    #: Entries that a segment of the sort should hold, and the most segments.
    segment_rows: int = 20_000
    segments: int = 512


# ---- crc32 of word runs, on arrays -------------------------------------------

def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_BYTE = _byte_table()
_DIGIT = 64


def _shift_tables() -> list[np.ndarray]:
    """Tables that move a crc past zero bytes: entry [k, j, v] of the table of
    digit d is what byte j of value v becomes behind ``k * 64 ** d`` bytes."""
    base = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None])
    out, one = [], None
    for _ in range(4):
        table = np.empty((_DIGIT + 1, 4, 256), np.uint32)
        table[0] = base
        for k in range(1, _DIGIT + 1):
            c = table[k - 1]
            table[k] = _BYTE[c & 255] ^ (c >> 8) if one is None else _moved(c, one)
        one = table[_DIGIT]
        out.append(np.ascontiguousarray(table[:_DIGIT]))
    return out


def _moved(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


_SHIFT = _shift_tables()
_SPACE_CRC = np.uint32(zlib.crc32(b" "))


def join_crc(a: np.ndarray, b: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """crc32 of the joined texts behind the crcs ``a`` and ``b``."""
    for digit, table in enumerate(_SHIFT):
        own = b_len >> (6 * digit)
        if digit and not own.any():
            break
        flat, at = table.ravel(), (own & (_DIGIT - 1)) << 10
        a = (flat[at + (a & 255)] ^ flat[at + 256 + (a >> 8 & 255)]
             ^ flat[at + 512 + (a >> 16 & 255)] ^ flat[at + 768 + (a >> 24)])
    return a ^ b


def crc_of(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """crc32 of each span."""
    lens = np.minimum(stops - starts, _DIGIT + 1).astype(np.uint8)
    order = np.argsort(lens, kind="stable")[::-1]
    first, lens = starts[order], lens[order]
    c = np.full(len(order), 0xFFFFFFFF, np.uint32)
    live = np.searchsorted(-lens.astype(np.int16), -np.arange(_DIGIT + 1))  # spans longer than j bytes
    for j in range(_DIGIT):
        if not (n := int(live[j])):
            break
        c[:n] = _BYTE[(c[:n] ^ data[first[:n] + j]) & 255] ^ (c[:n] >> 8)
    out = np.empty(len(order), np.uint32)
    out[order] = ~c
    for i in order[:live[_DIGIT]]:
        out[i] = zlib.crc32(data[starts[i]:stops[i]])
    return out


_SEPARATOR = np.ones(256, bool)
_SEPARATOR[0x30:0x3A] = _SEPARATOR[0x61:0x7B] = _SEPARATOR[0x80:] = False


def features(data: np.ndarray, offs: np.ndarray, p: ResampleParams) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each row, and for each run length the rows (ascending) and
    buckets of all runs."""
    data = lower_ascii(data)
    starts, stops, rows = words_of(data, offs, _SEPARATOR)
    word, lens = crc_of(data, starts, stops), stops - starts
    out, run = [], word
    for n in range(p.grams):
        if n:
            spaced = join_crc(run[:-1], np.full(max(0, len(run) - 1), _SPACE_CRC), np.ones(max(0, len(run) - 1), np.int64))
            run = join_crc(spaced, word[n:], lens[n:])
        inside = rows[:len(run)] == rows[n:] if n else slice(None)
        out.append((rows[:len(run)][inside], run[inside] % np.uint32(p.buckets)))
    return np.bincount(rows, minlength=len(offs) - 1), out


# ---- counts and scores --------------------------------------------------------

def bucket_counts(df: DataFrame, text_col: str, p: ResampleParams) -> np.ndarray:
    """Features of all texts in each bucket: summed in each task, then by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(p.buckets, np.int64)
        for batch in batches:
            data, offs = text_bytes(batch.column(0))
            for lo, hi in chunks(offs):
                for _, own in features(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], p)[1]:
                    sums += np.bincount(own, minlength=p.buckets)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(sums[held])], ["bucket", "n"])

    rows = (df.select(F.col(text_col).cast("string")).where(F.col(text_col).isNotNull())
            .mapInArrow(giving_back(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(p.buckets, np.int64)
    for r in rows:  # at most p.buckets
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray, p: ResampleParams) -> np.ndarray:
    """floor(scale * ln of the smoothed target share over the corpus share)."""
    up = (target + 1.0) * (float(corpus.sum()) + p.buckets)
    down = (corpus + 1.0) * (float(target.sum()) + p.buckets)
    return np.floor(p.scale * np.log(up / down)).astype(np.int64)


def variate(doc_id, p: ResampleParams) -> int:
    """The Gumbel variate of an id, in units of 1 / scale."""
    h = int(hashlib.sha256(f"{p.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return int(np.floor(-p.scale * np.log(-np.log((h + 0.5) / 4294967296))))


def scores(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           target_col: str = "text", params: ResampleParams = ResampleParams(), row: str | None = None) -> DataFrame:
    """(id, n_features, n_words, weight, score, row) of every row of ``df``,
    as a written table; ``row``: a long column of ``df`` to carry, else a
    number is given to each row."""
    p = params
    bounded_batches(df.sparkSession)
    gain = gains(bucket_counts(df, text_col, p), bucket_counts(target, target_col, p), p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            for lo, hi in chunks(offs):
                words, found = features(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], p)
                n, weight = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                for rows, own in found:
                    ends = np.searchsorted(rows, np.arange(hi - lo + 1))
                    sums = np.concatenate([[0], np.cumsum(gain[own])])
                    n += np.diff(ends)
                    weight += np.diff(sums[ends])
                ids = batch.column(0).slice(lo, hi - lo)
                noise = np.array([variate(i, p) for i in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids, *[pa.array(a) for a in (n, words.astype(np.int64), weight, weight + noise)], batch.column(2).slice(lo, hi - lo)],
                    ["id", "n_features", "n_words", "weight", "score", "row"])

    given = F.col(row) if row else F.monotonically_increasing_id()
    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), given.cast("long").alias("row"))
    return materialize(own.mapInArrow(giving_back(run), "id long, n_features long, n_words long, weight long, score long, row long"), "dsir-scores")


# ---- parallel sorting by regular sampling ----------------------------------------

KEY = ["down", "id_", "row"]


def _segment_of(splitters: list[tuple[int, int, int]]):
    """Column function: how many splitters are smaller than the key."""
    firsts = np.array([s[0] for s in splitters], np.int64)

    @F.pandas_udf(T.IntegerType())
    def segment(down: pd.Series, id_: pd.Series, row: pd.Series) -> pd.Series:
        key = down.to_numpy()
        low, high = np.searchsorted(firsts, key), np.searchsorted(firsts, key, "right")
        tied = np.flatnonzero(low != high)
        if len(tied):  # equal to a splitter's score: the whole key decides
            i, r = id_.to_numpy(), row.to_numpy()
            low[tied] = [bisect.bisect_left(splitters, (key[k], i[k], r[k])) for k in tied]
        return pd.Series(low.astype(np.int32))

    return segment(*KEY)


def ranked(scored: DataFrame, take: int, entries: int, params: ResampleParams = ResampleParams()) -> DataFrame:
    """``scored`` (id, score, row, ...; ``entries`` rows) with the column
    ``rank``: 1 for the highest score, ties to smaller ids; null behind
    ``take``."""
    p = params
    unranked = F.lit(None).cast("long").alias("rank")
    if take <= 0:
        return scored.select("*", unranked)
    keyed = scored.withColumns({"down": -F.col("score"), "id_": F.coalesce("id", F.lit((1 << 63) - 1))})
    runs = keyed.sortWithinPartitions(*KEY).withColumn("place", F.monotonically_increasing_id() % (1 << 33))
    runs = materialize(runs, "dsir-runs")
    parts = max(1, min(p.segments, -(-entries // p.segment_rows)))
    stride = max(1, entries // (parts * parts))
    samples = sorted(tuple(r) for r in runs.where(F.col("place") % stride == stride // 2).select(*KEY).collect())  # about parts ** 2
    splitters = [samples[k * len(samples) // parts] for k in range(1, parts)] if samples else []
    placed = materialize(runs.drop("place").withColumn("segment", _segment_of(splitters) if splitters else F.lit(0)), "dsir-segments")
    sizes = {r["segment"]: r["n"] for r in placed.groupBy("segment").agg(F.count("*").alias("n")).collect()}  # one number a segment
    before = [0]
    for s in range(parts):
        before.append(before[-1] + sizes.get(s, 0))
    last = max(s for s in range(parts) if before[s] < take)
    local = F.row_number().over(Window.partitionBy("segment").orderBy(*KEY))
    rank = (local + F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), F.col("segment") + 1)).cast("long")
    front = placed.where(F.col("segment") <= last).withColumn("rank", F.when(rank <= take, rank))
    rest = placed.where(F.col("segment") > last).select("*", unranked)
    return front.unionByName(rest).drop("segment", "down", "id_")


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             params: ResampleParams = ResampleParams(), row: str | None = None) -> DataFrame:
    """(id, n_features, n_words, weight, score, row, rank) of every row; the
    rank of rows that are not drawn is null."""
    p = params
    scored = scores(df, target, id_col, text_col, target_col, p, row)
    eligible = F.col("n_words") >= p.least_words
    n = scored.where(eligible).count()
    drawn = ranked(scored.where(eligible), p.percent * n // 100, n, p)
    return drawn.unionByName(scored.where(~eligible).withColumn("rank", F.lit(None).cast("long")))


def resampled_documents(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        target_col: str = "text", params: ResampleParams = ResampleParams()) -> DataFrame:
    """The drawn rows of ``df``, all columns as they are."""
    row, key = fresh(df, "_row"), fresh(df, "_key")
    docs = materialize(df.withColumn(row, F.monotonically_increasing_id()), "dsir-input")
    drawn = resample(docs, target, id_col, text_col, target_col, params, row).where("rank IS NOT NULL")
    return docs.join(drawn.select(F.col("row").alias(key)), F.col(row) == F.col(key), "left_semi").drop(row)
