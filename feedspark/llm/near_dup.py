"""Near-duplicate documents by circulant MinHash.

A document's set holds its distinct five-word shingles (64-bit hashes).  One
permutation sigma maps shingles to a circle of 2^32 places; a second one, pi,
shifted along the circle by k places, gives coordinate k of the signature:
``min over x of pi(sigma(x) + k)``.  Two permutations thus make all
coordinates.  Coordinates are banded, documents that share a band are
candidates, and every link is confirmed on the full sets.

Equal sets are folded to one representative first.  A bucket (band value) of
any size is never expanded into all pairs:

1. every member is paired with the bucket's smallest member; pairs whose
   signatures agree well enough are confirmed, and the links give components;
2. only buckets that still hold several components are looked at again, in
   tiles of bounded size spread over tasks: signatures are compared as
   matrices, and pairs of different components that may reach the threshold
   are confirmed on their sets there; only links that join components leave
   the task.

So no link between different components is lost in a bucket, however large.
With 24 bands of 4, a pair at 0.85 shares no band with probability 2e-8; the
signature filter (at least 64 of 96 coordinates) fails such a pair with
about 5e-7.

Defined results: null or empty text, or none but white space: empty set, own
component.  Every text is looked at, also if several rows with different texts
share an id; a component is named by its smallest id, and ``keep_one`` keeps one
text of it (rows repeated with id and text are one document).  A null id links
nothing: component null, kept.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedspark.llm.common import bounded_batches, chunks, fresh, giving_back, lower_ascii, materialize, mix64, span_hashes, text_bytes, words_of


@dataclass(frozen=True)
class NearDupParams:
    words: int = 5
    #: A link has 100 * intersection >= percent * union.
    percent: int = 85
    bands: int = 24
    rows: int = 4
    #: Coordinates that must agree (in their low 8 bits) before sets are compared.
    agree: int = 64
    #: Members on a side of a tile when a bucket's components are compared.
    tile: int = 1024

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows


# ---- sets and signatures, inside tasks --------------------------------------

def shingle_sets(data: np.ndarray, offs: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    data = lower_ascii(data)
    starts, stops, rows = words_of(data, offs)
    hashed = span_hashes(data, starts, stops)
    first = np.searchsorted(rows, np.arange(len(offs)))
    odd = mix64(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(0, len(hashed) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for i in range(words):
        rolled += hashed[i:i + n] * odd[i]
    rolled = mix64(rolled)
    out = []
    for lo, hi in zip(first[:-1], first[1:]):
        if hi - lo >= words:
            own = np.sort(rolled[lo:hi - words + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif hi > lo:  # fewer words: the whole sequence as one
            own = (hashed[lo:hi] * odd[:hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
            out.append(mix64(np.array([own], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Signature rows of non-empty sets, by two permutations of which the
    second is shifted from one coordinate to the next."""
    sigma = np.concatenate(sets)
    sigma = (sigma >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((coordinates, len(sets)), np.uint32)
    buf, tmp = np.empty_like(sigma), np.empty_like(sigma)
    for k in range(coordinates):
        np.add(sigma, np.uint32(k), out=buf)
        np.right_shift(buf, 16, out=tmp)
        np.bitwise_xor(buf, tmp, out=buf)
        np.multiply(buf, np.uint32(0x85EBCA6B), out=buf)
        np.right_shift(buf, 13, out=tmp)
        np.bitwise_xor(buf, tmp, out=buf)
        np.multiply(buf, np.uint32(0xC2B2AE35), out=buf)
        np.right_shift(buf, 16, out=tmp)
        np.bitwise_xor(buf, tmp, out=buf)
        np.minimum.reduceat(buf, starts, out=out[k])
    return out.T


SKETCH = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("content", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType()),
    T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])


def _sketches(p: NearDupParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            data, offs = text_bytes(batch.column(1))
            for lo, hi in chunks(offs):
                sets = shingle_sets(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], p.words)
                yield _sketch_batch(ids.slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), sets, p)

    return run


def _sums(x: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two sums over a set, which name it."""
    return x.sum(dtype=np.uint64), mix64(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)


def _sketch_batch(ids: pa.Array, content: pa.Array, sets: list[np.ndarray], p: NearDupParams) -> pa.RecordBatch:
    n = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(n)
    f1, f2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    bands: list = [[] for _ in sets]
    sig: list = [b""] * len(sets)
    step = 0
    while step < len(full):  # so many rows at a time that their shingles stay in the cache
        upto = step + max(1, int(np.searchsorted(np.cumsum(n[full[step:]]), 100_000, "right")))
        part = full[step:upto]
        own = [sets[i] for i in part]
        s = signatures(own, p.coordinates)
        folded = np.zeros((len(part), p.bands), np.uint64)
        for j in range(p.rows):
            folded = mix64(folded * np.uint64(0x9E3779B97F4A7C15) + s[:, j::p.rows])
        folded = mix64(folded + np.arange(p.bands, dtype=np.uint64))
        small = s.astype(np.uint8)
        for i, row, narrow, x in zip(part, folded.view(np.int64), small, own):
            bands[i], sig[i] = row, narrow.tobytes()
            f1[i], f2[i] = _sums(x)
        step = upto
    return pa.RecordBatch.from_arrays(
        [ids.cast(pa.int64()), content, pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)),
         pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())], [f.name for f in SKETCH])


def _sets(p: NearDupParams):
    """The sets of (node, text, f1, f2) rows; a row whose text is not the
    node's (its id has several texts) goes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            want = np.stack([batch.column(k).to_numpy().view(np.uint64) for k in (2, 3)], axis=1)
            for lo, hi in chunks(offs):
                sets = shingle_sets(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], p.words)
                own = [k for k, s in enumerate(sets) if _sums(s) == tuple(want[lo + k])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(own, pa.int64())),
                     pa.array([sets[k].tobytes() for k in own], pa.binary())], ["id", "shingles"])

    return run


@F.pandas_udf(T.IntegerType())
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Coordinates in which two signatures agree."""
    if not len(a):
        return pd.Series([], dtype="int32")
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).sum(axis=1, dtype=np.int32))


@F.pandas_udf(T.LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the intersection of two sorted sets."""
    out = np.empty(len(a), np.int64)
    for i, (x, y) in enumerate(zip(a, b)):
        both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]))
        out[i] = np.count_nonzero(both[1:] == both[:-1])
    return pd.Series(out)


# ---- candidates --------------------------------------------------------------

def _size_fits(a: str, b: str, percent: int):
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


def _sets_of(nodes: DataFrame, reps: DataFrame, texts: DataFrame, p: NearDupParams) -> DataFrame:
    """(id, shingles): the full sets of the given nodes.  They grow with the
    corpus: both sides are shuffled, at any size."""
    wanted = reps.join(nodes.distinct(), "id", "left_semi").select(F.col("id").alias("node"), F.col("doc").alias("id"), "f1", "f2")
    rows = texts.join(wanted.hint("merge"), "id").dropDuplicates(["id", "node", "text"])  # repeated rows; dealt by id already
    return materialize(rows.select("node", "text", "f1", "f2").mapInArrow(giving_back(_sets(p)), "id long, shingles binary"), "nd-sets")


def _confirm(pairs: DataFrame, sets: DataFrame, p: NearDupParams) -> DataFrame:
    """The pairs (a, b) that reach the threshold on their full sets."""
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(a, "a").join(b, "b")
    common = both.select("a", "b", (F.length("sa") / 8).cast("long").alias("na"),
                         (F.length("sb") / 8).cast("long").alias("nb"), _common("sa", "sb").alias("c"))
    return materialize(common.where(F.col("c") * 100 >= (F.col("na") + F.col("nb") - F.col("c")) * p.percent)
                       .select("a", "b"), "nd-1-links")


TILE_LINKS = "a long, b long"


def _tiles(p: NearDupParams):
    """Rows arrive sorted by (key, i, j).  A tile's members are compared as
    matrices of signatures and confirmed on their sets; a pair is looked at in
    the first band whose full key it shares only, and only while its components are not
    joined yet, so no more links leave a tile than it has members."""
    def compare(t: pd.DataFrame) -> tuple[list[int], list[int]]:
        same, band = bool(t["same"].iat[0]), int(t["band"].iat[0])
        ids, n = t["id"].to_numpy(), t["n"].to_numpy()
        sig = np.frombuffer(b"".join(t["sig"]), np.uint8).reshape(len(t), -1)
        own = np.stack([np.asarray(x, np.int64) for x in t["bands"]])  # full keys: a signature's 8 bits may agree by chance
        roots = np.unique(t["comp"].to_numpy(), return_inverse=True)[1]
        sets = [np.frombuffer(x, np.uint64) for x in t["shingles"]]
        side = t["side"].to_numpy()
        columns = np.flatnonzero(side != 0)
        links: tuple[list[int], list[int]] = [], []
        for k in np.flatnonzero(side != 1).tolist():
            fit = columns[ids[columns] > ids[k]] if same else columns
            fit = fit[roots[fit] != roots[k]]
            fit = fit[np.minimum(n[fit], n[k]) * 100 >= np.maximum(n[fit], n[k]) * p.percent]
            if not len(fit):
                continue
            agree = (sig[fit] == sig[k]).sum(axis=1)
            keep = agree >= p.agree
            keep &= (own[fit] == own[k]).argmax(axis=1) == band
            fit = fit[keep][np.argsort(-agree[keep], kind="stable")]
            for other in fit.tolist():
                if roots[other] == roots[k]:
                    continue
                both = np.sort(np.concatenate([sets[k], sets[other]]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if common * 100 >= (n[k] + n[other] - common) * p.percent:
                    links[0].append(int(ids[k]))
                    links[1].append(int(ids[other]))
                    roots[roots == roots[other]] = roots[k]
        return links

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            if rest is not None:
                frame = pd.concat([rest, frame], ignore_index=True)
            if not len(frame):
                continue
            key = frame[["key", "i", "j"]].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            bounds = [0, *cuts.tolist()]
            found = [compare(frame.iloc[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:])]
            yield pd.DataFrame({"a": [x for f in found for x in f[0]], "b": [x for f in found for x in f[1]]}, dtype="int64")
            rest = frame.iloc[bounds[-1]:]
        if rest is not None and len(rest):
            a, b = compare(rest)
            yield pd.DataFrame({"a": a, "b": b}, dtype="int64")

    return run


# ---- components ---------------------------------------------------------------

def components(links: DataFrame) -> DataFrame:
    """(id, comp): the smallest id that each id of ``links`` (a, b) reaches.

    Alternates the large-star and the small-star step until nothing changes.
    Each step is a partial aggregate and a join with one row per id on one
    side, so a hub with any number of neighbours can be split over tasks; each
    round is written to the shared scratch folder."""
    links = links.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct()
    links = materialize(links, "cc")
    last = None
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        out = (large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .union(small.select("u", F.col("m").alias("v"))).distinct())
        links = materialize(out, "cc")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    return links.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(
        links.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


def _classified(df: DataFrame, id_col: str, text_col: str, p: NearDupParams) -> DataFrame:
    """(id, content, n, root, component) of every row: ``content`` hashes the
    text, ``root`` numbers the component, ``component`` is its smallest id."""
    bounded_batches(df.sparkSession)
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch = materialize(texts.select("id", "text", F.xxhash64("text").alias("content")).mapInArrow(giving_back(_sketches(p)), SKETCH), "nd-sketch")
    # One node for each distinct set, numbered; ``doc`` is one of the ids that hold it.
    reps = materialize(
        sketch.where("n > 0 AND id IS NOT NULL").groupBy("f1", "f2", "n")
        .agg(F.min("id").alias("doc"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
        .withColumn("id", F.monotonically_increasing_id()), "nd-reps")

    banded = reps.select(F.posexplode("bands").alias("band", "key"), "id")
    buckets = materialize(banded.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("members"))
                          .where("members > 1"), "nd-buckets")
    in_bucket = materialize(banded.join(buckets, "key"), "nd-members")
    pairs = in_bucket.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    facts = reps.select("id", "n", "sig", "bands")
    of = lambda c: facts.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))
    likely = (pairs.join(of("a"), "a").join(of("b"), "b").where(_size_fits("na", "nb", p.percent))
              .where(_agreement("sa", "sb") >= p.agree).select("a", "b"))
    sets = _sets_of(in_bucket.select("id"), reps, texts, p)  # of all documents that share a band with another one
    links = _confirm(likely, sets, p)
    first = materialize(components(links), "nd-comp")

    placed = (in_bucket.where("members > 2").join(first, "id", "left")
              .select("key", "band", "id", F.coalesce("comp", "id").alias("comp")))
    open_keys = (placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"))
                 .where("lo <> hi").select("key", F.ceil(F.col("m") / p.tile).cast("int").alias("parts")))
    sides = materialize(
        placed.join(open_keys, "key").join(facts, "id")
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        .select("key", "band", "id", "comp", "n", "sig", "bands", "own",
                F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        .select("key", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "comp", "n", "sig", "bands",
                F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
                (F.col("own") == F.col("other")).alias("same")), "nd-sides")
    links2 = materialize(
        sides.join(sets, "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        .mapInPandas(giving_back(_tiles(p)), TILE_LINKS).distinct(), "nd-2-links")
    if links2.isEmpty():
        return _named(sketch, reps, first.select(F.col("id").alias("rep"), F.col("comp").alias("root")))
    named = first.select(F.col("id").alias("x"), "comp")
    up = (links2.join(named.withColumnRenamed("x", "a").withColumnRenamed("comp", "ca"), "a", "left")
          .join(named.withColumnRenamed("x", "b").withColumnRenamed("comp", "cb"), "b", "left")
          .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    second = components(up).select(F.col("id").alias("comp"), F.col("comp").alias("root"))
    alone = second.select(F.col("comp").alias("id"), "comp").join(first, "id", "left_anti")
    final = (first.union(alone).join(second, "comp", "left")
             .select(F.col("id").alias("rep"), F.coalesce("root", "comp").alias("root")))
    return _named(sketch, reps, final)


def _named(sketch: DataFrame, reps: DataFrame, final: DataFrame) -> DataFrame:
    nodes = (reps.select("f1", "f2", "n", "doc", F.col("id").alias("rep")).join(final, "rep", "left")
             .withColumn("root", F.coalesce("root", "rep")))
    names = nodes.groupBy("root").agg(F.min("doc").alias("component"))
    by_set = nodes.join(names, "root").select("f1", "f2", "n", "root", "component")
    return (sketch.join(by_set, ["f1", "f2", "n"], "left")
            .select("id", "content", "n", F.when(F.col("id").isNotNull(), F.col("root")).alias("root"),
                    F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    params: NearDupParams = NearDupParams()) -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id, kept."""
    return (_classified(df, id_col, text_col, params)
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             params: NearDupParams = NearDupParams()) -> DataFrame:
    """The rows of ``df`` that stay: of each component the text of its
    smallest id (of several such texts, one).  Rows repeated with id and text
    stay or go together; rows without an id or a word stay; all columns are
    returned."""
    own, content = fresh(df, "_drop"), fresh(df, "_content")
    classes = materialize(_classified(df, id_col, text_col, params).where("root IS NOT NULL").select("id", "content", "root").distinct(), "nd-classes")
    stays = classes.groupBy("root").agg(F.min(F.struct("id", "content")).alias("m"))
    gone = (classes.join(stays, "root").where(F.struct("id", "content") != F.col("m"))
            .select(F.col("id").alias(own), F.col("content").alias(content)).hint("merge"))
    match = (F.col(id_col).cast("long") == F.col(own)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(content))
    return df.join(gone, match, "left_anti")
