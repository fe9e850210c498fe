"""Mixing sources to target weights.

The words of a source's documents, one after the other, form a stream that is
cut into blocks of fixed length.  A source's target (its weighted share,
bounded by a multiple of its size, the excess reshared) gives its number of
slots.  Every output shard draws how many of its slots each source gets from a
multinomial distribution; the few draws by which a source's total misses its
slots are settled at the end.  A source's slot number j is mapped through a
pseudorandom permutation of its block indexes (slot j takes block
perm(j mod blocks) in round j div blocks), and slots and blocks are joined by
index.  A source's last slot is cut short, so that the words taken equal its
target rounded to a whole word.

Positions in a stream are prefix sums in which a hot source is spread over
many tasks; draws, slots and blocks are rows of distributed tables.  Only one
row for each source (its size) reaches the driver.

Defined results: a null or empty text has size 0 and is never taken; a null
source is a source, last in order; sources of size 0 have target 0; an empty
table gives an empty mix.  Repeated rows are separate documents with equal
results up to the blocks drawn; a null id is carried.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedspark.llm.common import bounded_batches, fresh, materialize, mix64, prefix_sums

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixParams:
    #: Weights of the sources in order, repeating.
    weights: tuple[float, ...] = (5, 2, 1)
    #: Words of the mix, as a multiple of all words.
    share: float = 1.5
    #: A target is at most so many times its source's size.
    most: float = 2.0
    block: int = 128
    shard_slots: int = 4096
    seed: int = 2024


@dataclass(frozen=True)
class Source:
    """A source's plan: ``slots`` blocks are taken, ``words`` in all, of the
    last one only ``last`` words."""
    index: int
    name: str | None
    size: int
    target: float
    blocks: int
    slots: int
    words: int
    last: int


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[float], p: MixParams) -> list[float]:
    """Shares of ``share`` times the total by weight; whatever would exceed
    ``most`` times a source's size is reshared among the others."""
    weights = [p.weights[i % len(p.weights)] for i in range(len(sizes))]
    out, rest, free = [0.0] * len(sizes), p.share * sum(sizes), set(range(len(sizes)))
    while free:
        total = sum(weights[i] for i in sorted(free))
        full = [i for i in sorted(free) if rest * weights[i] / total > p.most * sizes[i]]
        if not full:
            for i in free:
                out[i] = rest * weights[i] / total
            break
        for i in full:
            out[i] = p.most * sizes[i]
        rest -= sum(out[i] for i in full)
        free -= set(full)
    return out


def permute(index: np.ndarray, size: int, key: int, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1: a four-round Feistel network
    on the least even number of bits, walked until it falls inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix64(np.arange(1, 5, dtype=np.uint64) + np.uint64(key * 0x9E3779B97F4A7C15 % (1 << 64)))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (mix64(left + k) & mask), left
            else:
                left, right = right, left ^ (mix64(right + k) & mask)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def plan(sizes: Sequence[tuple[str | None, int]], p: MixParams) -> list[Source]:
    """``sizes``: (source, words), in order."""
    out = []
    for i, ((name, size), target) in enumerate(zip(sizes, targets([s for _, s in sizes], p))):
        words, blocks = round(target), -(-size // p.block)
        if not blocks or not words:
            out.append(Source(i, name, size, target, blocks, 0, 0, 0))
            continue
        rounds, rest = divmod(words, size)
        short = p.block - (size - (blocks - 1) * p.block)  # what the last block lacks
        at = int(permute(np.array([blocks - 1]), blocks, p.seed + i, inverse=True)[0])
        held = lambda n: n * p.block - (short if at < n else 0)  # noqa: E731 words in a round's first n slots
        extra = -(-rest // p.block)
        extra += held(extra) < rest
        if extra:
            before, slots = held(extra - 1), rounds * blocks + extra
        else:
            before, slots, rest = held(blocks - 1), rounds * blocks, size
        out.append(Source(i, name, size, target, blocks, slots, words, rest - before))
    return out


@dataclass
class Mix:
    """``docs``: the rows with source_index, size and stream position;
    ``taken``: shard, source_index, slot, round, block, position (that of the
    document's row), doc_start, length: the words that the mix takes."""
    sources: list[Source]
    docs: DataFrame
    taken: DataFrame


def _by_source(sources: list[Source], value) -> Column:
    """A literal for each source, looked up by source_index."""
    return F.element_at(F.array(*[F.lit(value(s)) for s in sources]), F.col("source_index") + 1)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        params: MixParams = MixParams(), row: Column | None = None, content: Column | None = None) -> Mix:
    """``row`` and ``content``, if given, are columns of ``df`` carried in
    ``docs``: a key of each row's own, and a hash of its content that orders
    rows of one id and size."""
    p = params
    extra = [c.alias(n) for c, n in ((row, "row"), (content, "content")) if c is not None]
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), *extra)
    rows = materialize(rows, "mix-sizes")
    found = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    names = sorted((s for s in found if s is not None)) + [None] * (None in found)
    sources = plan([(s, found[s]) for s in names], p)
    spark = df.sparkSession
    order = spark.createDataFrame([(s.name, s.index) for s in sources], "name string, source_index int")
    docs = rows.join(F.broadcast(order), rows["source"].eqNullSafe(order["name"])).drop("name")  # one row a source
    order_by = ["doc_id", "size"] + ["content"] * (content is not None)
    docs = materialize(prefix_sums(docs, ["source_index"], order_by, "size", "position"), "mix-docs")
    slots = _slots(spark, sources, p)
    first, last = F.floor(F.col("position") / p.block), F.floor((F.col("position") + F.col("size") - 1) / p.block)
    pieces = (docs.where("size > 0").select("source_index", "position", "size", F.explode(F.sequence(first, last)).alias("block"))
              .withColumn("at", F.greatest(F.col("position") - F.col("block") * p.block, F.lit(0)))
              .withColumn("doc_start", F.greatest(F.col("block") * p.block - F.col("position"), F.lit(0)))
              .withColumn("length", F.least(F.col("size") - F.col("doc_start"), F.lit(p.block) - F.col("at"))))
    taken = (slots.join(pieces, ["source_index", "block"])
             .withColumn("length", F.least("length", F.col("words") - F.col("at"))).where("length > 0")
             .select("shard", "source_index", "slot", "round", "block", "position", "doc_start", "length"))
    return Mix(sources, docs, taken)


def _slots(spark, sources: list[Source], p: MixParams) -> DataFrame:
    """shard, source_index, slot (of the source), round, block, words."""
    total = sum(s.slots for s in sources)
    schema = "shard long, source_index int, slot long, round long, block long, words long"
    if not total:
        return spark.createDataFrame([], schema)
    shares = np.array([s.slots / total for s in sources])
    shards = -(-total // p.shard_slots)

    def draw(frames):
        for frame in frames:
            for shard in frame["id"].tolist():
                n = min(p.shard_slots, total - shard * p.shard_slots)
                counts = np.random.default_rng([p.seed, shard]).multinomial(n, shares / shares.sum())
                yield pd.DataFrame({"shard": shard, "source_index": np.arange(len(counts), dtype=np.int32), "drawn": counts})

    drawn = spark.range(shards).mapInPandas(draw, "shard long, source_index int, drawn long")
    drawn = materialize(prefix_sums(drawn, ["source_index"], ["shard"], "drawn", "first"), "mix-draws")
    sums = {r["source_index"]: r["n"] for r in drawn.groupBy("source_index").agg(F.sum("drawn").alias("n")).collect()}
    lacking = [(shards, s.index, k, min(p.shard_slots, s.slots - k)) for s in sources
               for k in range(sums[s.index], s.slots, p.shard_slots)]  # far fewer than the shards
    settled = spark.createDataFrame(lacking, "shard long, source_index int, first long, drawn long")
    all_slots = _by_source(sources, lambda s: s.slots).cast("long")
    slots = (drawn.select("shard", "source_index", "first", "drawn").union(settled)
             .withColumn("drawn", F.least("drawn", all_slots - F.col("first"))).where("drawn > 0")
             .select("shard", "source_index", F.explode(F.sequence("first", F.col("first") + F.col("drawn") - 1)).alias("slot")))

    @F.pandas_udf(T.LongType())
    def block_of(slot: pd.Series, source: pd.Series) -> pd.Series:
        out = np.empty(len(slot), np.int64)
        own, at = source.to_numpy(), slot.to_numpy()
        for i in np.unique(own):
            here = own == i
            out[here] = permute(at[here] % sources[i].blocks, sources[i].blocks, p.seed + int(i))
        return pd.Series(out)

    last = F.col("slot") == all_slots - 1
    return slots.select("shard", "source_index", "slot",
                        F.floor(F.col("slot") / _by_source(sources, lambda s: max(1, s.blocks)).cast("long")).alias("round"),
                        block_of("slot", "source_index").alias("block"),
                        F.when(last, _by_source(sources, lambda s: s.last).cast("long")).otherwise(F.lit(p.block)).alias("words"))


def digest(m: Mix) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    sums = m.taken.groupBy("source_index", "position").agg(F.sum("length").alias("taken")).withColumn("some", F.lit(True))
    return (m.docs.withColumn("some", F.col("size") > 0).join(sums, ["source_index", "position", "some"], "left")
            .select("doc_id", "size", _by_source(m.sources, lambda s: s.size).cast("long").alias("source_size"),
                    _by_source(m.sources, lambda s: float(s.target)).cast("double").alias("target"),
                    F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
            if m.sources else
            m.docs.select("doc_id", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"),
                          F.lit(0).cast("long").alias("taken")))


@F.pandas_udf(T.StringType())
def cut_text(text: pd.Series, spans: pd.Series) -> pd.Series:
    """The spans (round, doc_start, length) of a text, rounds on new lines;
    a round that takes every word returns the text between its outer words."""
    out = []
    for t, own in zip(text, spans):
        at = [m.span() for m in re.finditer(WORD, t)]
        lines: dict[int, list[list[int]]] = {}
        for r, start, n in sorted((int(s["round"]), int(s["doc_start"]), int(s["length"])) for s in own):
            mine = lines.setdefault(r, [])
            if mine and mine[-1][1] == start:
                mine[-1][1] = start + n
            else:
                mine.append([start, start + n])
        out.append("\n".join(t[at[a][0]:at[b - 1][1]] for r in sorted(lines) for a, b in lines[r]))
    return pd.Series(out, dtype=object)


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    params: MixParams = MixParams()) -> DataFrame:
    """The documents of the mix with the text that it takes of them, all
    other columns as they are.  Every row is a document of its own, as in
    ``mix``, also if its id is null or another row's; documents of which
    nothing is taken go."""
    bounded_batches(df.sparkSession)
    own, key, row = fresh(df, "_spans"), fresh(df, "_key"), fresh(df, "_row")
    docs = materialize(df.withColumn(row, F.monotonically_increasing_id()), "mix-input")
    content = F.xxhash64(*[c for c, t in df.dtypes if "map<" not in t and t != "variant"])
    m = mix(docs, id_col, text_col, source_col, params, F.col(row), content)
    named = m.taken.join(m.docs.where("size > 0").select("source_index", "position", F.col("row").alias(key)), ["source_index", "position"])
    spans = named.groupBy(key).agg(F.collect_list(F.struct("round", "doc_start", "length")).alias(own))  # bounded by the text
    return (docs.join(spans, F.col(row) == F.col(key))
            .withColumn(text_col, cut_text(F.col(text_col), F.col(own))).drop(own, key, row))
