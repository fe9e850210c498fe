"""Sharding by a k-d tree over document metadata.

The table is split recursively: a node that is to give k shards is cut along
its widest metadata dimension at the weighted median (in general at the share
of its bytes that the first k/2 shards have room for), until every leaf is one
shard of about the target bytes.  All cuts of a level are found together: histograms
of bounded size narrow each cut down to where a bin holds next to nothing, so
only bin sums reach the driver, and the tree is applied as one expression.

Documents with equal texts form a group that is never cut: a group is one
point, at the metadata of its smallest id, with the bytes of all its members.
The few groups of more than 1/16 of a shard are dealt first, largest to the
emptiest shard; the tree shares out the room that they leave.
Every dimension is scaled to 0..1 and spread by a hash of the text within
equal values, so that a value held by a third of all rows can be cut as well.

Defined results: a null text has 8 bytes and null checksum, and null texts
are one group, as empty texts are.  Repeated rows are in one group.  Null
metadata sort first.  With fewer groups than shards some shards are empty.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import fresh, materialize, prefix_sums


@dataclass(frozen=True)
class ShardParams:
    shards: int = 24
    #: Bins of a histogram, and the share of a node that a cut may miss.
    bins: int = 1024
    miss: float = 2e-4
    #: Groups of at least this part of a shard are dealt before the tree.
    heavy: float = 1 / 16


@dataclass
class Node:
    """A leaf holds ``shards`` = 1; an inner node cuts ``axis`` at ``at``."""
    number: int
    shards: int
    first: int
    axis: int = -1
    at: float = 0.0
    below: list[Node] = field(default_factory=list)


JITTER = 1e-6


def _unit(c: Column, low: float, high: float, u: Column) -> Column:
    """``c`` scaled to 0..1, equal values spread by ``u`` (0..1); null is 0."""
    scaled = (c - low) / (high - low) if high > low else F.lit(0.0)
    return F.coalesce(scaled, F.lit(0.0)) * (1 - JITTER) + u * JITTER


def _place(node: Node, axes: list[str]) -> Column:
    """The number of the lowest node that holds a point."""
    if not node.below:
        return F.lit(node.number)
    left, right = (_place(n, axes) for n in node.below)
    return F.when(F.col(axes[node.axis]) < node.at, left).otherwise(right)


def room_left(heavy: list[int], rest: int, shards: int) -> tuple[list[int], list[float]]:
    """Deal ``heavy`` (descending) to the emptiest shards; the shard of each,
    and the room for the ``rest`` that makes all shards as even as can be."""
    load = [0] * shards
    dealt = []
    for size in heavy:
        k = min(range(shards), key=lambda i: (load[i], i))
        load[k] += size
        dealt.append(k)
    full = sorted(load)
    for k in range(shards, 0, -1):  # the k emptiest shards share the rest
        level = (rest + sum(full[:k])) / k
        if level >= full[k - 1]:
            break
    return dealt, [max(0.0, level - x) for x in load]


def _cuts(points: DataFrame, root: Node, level: list[Node], axes: list[str], room: list[float], p: ShardParams) -> None:
    """Choose axis and cut of every node of ``level``."""
    placed = points.withColumn("node", _place(root, axes))
    extents = {r["node"]: r for r in placed.groupBy("node").agg(
        F.sum("bytes").alias("bytes"), *[F.min(a).alias(f"lo_{a}") for a in axes], *[F.max(a).alias(f"hi_{a}") for a in axes]).collect()}
    def share(n: Node) -> float:
        own = room[n.first:n.first + n.shards]
        return sum(own[:n.shards // 2]) / (sum(own) or 1.0)

    todo: dict[int, dict] = {}
    for n in level:
        r = extents.get(n.number)
        if r is None:  # no points: any cut will do
            n.axis, n.at = 0, 0.0
            continue
        n.axis = max(range(len(axes)), key=lambda i: r[f"hi_{axes[i]}"] - r[f"lo_{axes[i]}"])
        low, high = r[f"lo_{axes[n.axis]}"], math.nextafter(r[f"hi_{axes[n.axis]}"], 2.0)
        todo[n.number] = {"node": n, "low": low, "high": high, "under": 0, "all": r["bytes"], "goal": r["bytes"] * share(n)}
    while todo:
        number = F.col("node")
        pick = lambda f: F.coalesce(*[F.when(number == k, F.lit(f(t))) for k, t in todo.items()])
        axis = F.coalesce(*[F.when(number == k, F.col(axes[t["node"].axis])) for k, t in todo.items()])
        inside = placed.where(number.isin(list(todo))).select("node", "bytes", axis.alias("x"), pick(lambda t: t["low"]).alias("low"), pick(lambda t: t["high"]).alias("high"))
        # bin b starts at low + (high - low) * b / bins, as the driver computes it below
        sums = (inside.where("x >= low AND x < high")
                .withColumn("bin", F.least(F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * p.bins), F.lit(p.bins - 1)).cast("int"))
                .groupBy("node", "bin").agg(F.sum("bytes").alias("bytes"), F.min("x").alias("least"), F.max("x").alias("most")).collect())
        for k, t in list(todo.items()):
            own = sorted((r["bin"], r["bytes"], r["least"], r["most"]) for r in sums if r["node"] == k)
            under = t["under"]
            for _, weight, least, most in own:
                if under + weight >= t["goal"]:
                    break
                under += weight
            if weight <= p.miss * t["all"] or least == most:  # cut before or after this bin's points
                t["node"].at = least if t["goal"] - under <= under + weight - t["goal"] else math.nextafter(most, 2.0)
                del todo[k]
            else:
                t["low"], t["high"], t["under"] = least, math.nextafter(most, 2.0), under


def grow(points: DataFrame, axes: list[str], room: list[float], p: ShardParams) -> Node:
    root = Node(0, p.shards, 0)
    level, count = [root], 1
    while level := [n for n in level if n.shards > 1]:
        _cuts(points, root, level, axes, room, p)
        for n in level:
            half = n.shards // 2
            n.below = [Node(count, half, n.first), Node(count + 1, n.shards - half, n.first + half)]
            count += 2
        level = [m for n in level for m in n.below]
    return root


def _shard_of(node: Node, axes: list[str]) -> Column:
    if not node.below:
        return F.lit(node.first)
    left, right = (_shard_of(n, axes) for n in node.below)
    return F.when(F.col(axes[node.axis]) < node.at, left).otherwise(right)


def assign(df: DataFrame, metadata: dict[str, Column], id_col: str = "doc_id", text_col: str = "text",
           params: ShardParams = ShardParams()) -> DataFrame:
    """One row per row of ``df``: doc_id, size, text_crc32, shard, slot.
    ``metadata``: numeric columns by name, the dimensions of the tree."""
    text, names = F.col(text_col), [f"m{i}" for i in range(len(metadata))]
    rows = materialize(df.select(
        F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.xxhash64(text, text.isNull()).alias("h"),
        *[c.cast("double").alias(n) for n, c in zip(names, metadata.values())]), "shard-rows")
    key = ["h", "size"]
    first = F.min(F.struct("doc_id", *names)).alias("first")
    groups = rows.groupBy(*key).agg(first, F.sum("size").alias("bytes")).select(*key, "bytes", *[F.col(f"first.{n}").alias(n) for n in names])
    groups = materialize(groups, "shard-groups")
    ends = groups.agg(*[F.min(n).alias(f"lo_{n}") for n in names], *[F.max(n).alias(f"hi_{n}") for n in names]).first()
    u = F.pmod(F.xxhash64("h", "size"), F.lit(1 << 40)) / float(1 << 40)
    points = materialize(groups.select(*key, "bytes", *[
        _unit(F.col(n), ends[f"lo_{n}"], ends[f"hi_{n}"], u).alias(n) if ends[f"lo_{n}"] is not None else (u * JITTER).alias(n)
        for n in names]), "shard-points")
    p, spark = params, df.sparkSession
    total = points.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    large = F.col("bytes") >= total / p.shards * p.heavy
    heavy = sorted((tuple(r) for r in points.where(large).select("bytes", *key).collect()), reverse=True)  # at most shards / p.heavy rows
    dealt, room = room_left([r[0] for r in heavy], total - sum(r[0] for r in heavy), p.shards)
    light = points.where(~large)
    root = grow(light, names, room, p)
    shards = light.select(*key, _shard_of(root, names).cast("int").alias("shard")).union(
        spark.createDataFrame([(h, size, k) for (_, h, size), k in zip(heavy, dealt)], "h long, size long, shard int"))
    placed = rows.join(shards, key).select("doc_id", "size", "text_crc32", "shard", F.lit(1).cast("long").alias("one"))
    placed = materialize(placed, "shard-placed")
    return prefix_sums(placed, ["shard"], ["doc_id", "text_crc32"], "one", "slot").drop("one")


def write_shards(df: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id", files: int = 8) -> None:
    """Write the rows of ``df`` as one folder for each shard, each of about
    ``files`` files, so that no task writes a whole shard."""
    own, key = fresh(df, "shard"), fresh(df, "_key")
    where = assigned.select(F.col("doc_id").alias(key), F.col("shard").alias(own)).distinct()
    (df.join(where, F.col(id_col).eqNullSafe(F.col(key))).drop(key)
     .repartition(F.col(own), F.pmod(F.xxhash64(id_col), F.lit(files))).write.partitionBy(own).parquet(path))
