"""Nearest neighbours by a block matrix join.

Vectors are scaled to length one and rounded to int8 with a scale of their
own.  Query blocks and candidate blocks of bounded size are joined by block
index; a pair of blocks is one integer matrix product.  A product bounds the
true cosine: with e the length of a vector's rounding error,

    |a.b - a'.b'| <= e_a + e_b * (1 + e_a).

A candidate whose upper bound stays below the k-th best lower bound of its
query (of this tile or of tiles before) cannot be among the k nearest.  The
survivors are recomputed from the original vectors in double precision and
merged by heaps, first in the task, then over tasks.  The result is exact.

Every query block meets every candidate block once, so the work is that of the
stated query set against all rows.  Blocks are rows of a table; neither side
is broadcast, and a task holds one query block and one candidate block.

Defined results: vectors that are null, zero, of another length than the
first dimension asked for, or hold null or non-finite components take no
part.  A query is not its own candidate: rows that repeat its id are skipped
too.  Equal scores are ordered by the smaller id.  Rows with a null id take
no part.  Rows repeated, or sharing an id, are rows of their own, as in the
registered SQL: every copy of a candidate takes a rank, and every copy of a
query adds its pairs to the ranking of its id.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import bounded_batches, materialize


@dataclass(frozen=True)
class NeighbourParams:
    k: int = 5
    #: Rows of a query block and of a candidate block.
    query_block: int = 512
    block: int = 2048


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
            .where(F.col("id").isNotNull() & F.col("v").isNotNull())
            .where(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0)))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and bounds of the rounding error's length."""
    scale = np.abs(v).max(axis=1, keepdims=True)
    unit = v / scale
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    step = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / step[:, None]).astype(np.int8)
    error = np.sqrt(((unit - q * step[:, None]) ** 2).sum(axis=1)) + 1e-12
    return q, step, error


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums from the first component to the last, as SQL engines sum."""
    return np.cumsum(a * b, axis=1)[:, -1]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of paired rows, in double precision."""
    return _dot(a, b) / (np.sqrt(_dot(a, a)) * np.sqrt(_dot(b, b)))


def tile(queries: tuple, candidates: tuple, best: list[list[tuple[float, int]]], k: int) -> None:
    """Merge one tile into the queries' heaps of (score, -id)."""
    ids, v, q, step, error = candidates
    q_ids, q_v, q_q, q_step, q_error = queries
    exact = np.float32 if q.shape[1] <= 1000 else np.float64  # integer sums stay exact in its mantissa
    near = (q_q.astype(exact) @ q.astype(exact).T).astype(np.float64) * q_step[:, None] * step
    slack = q_error[:, None] + error * (1 + q_error[:, None])
    low, high = near - slack, near + slack
    own = q_ids[:, None] == ids
    low[own], high[own] = -np.inf, -np.inf
    bar = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(q_ids), -np.inf)
    bar = np.maximum(bar, [h[0][0] - 1e-9 if len(h) >= k else -np.inf for h in best])
    for i in range(len(q_ids)):
        found = np.flatnonzero((high[i] >= bar[i]) & ~own[i])
        for lo in range(0, len(found), 1024):
            part = found[lo:lo + 1024]
            scores = cosines(np.broadcast_to(q_v[i], (len(part), q_v.shape[1])), v[part])
            for s, c in zip(scores.tolist(), ids[part].tolist()):
                if len(best[i]) < k:
                    heapq.heappush(best[i], (s, -c))
                elif (s, -c) > best[i][0]:
                    heapq.heapreplace(best[i], (s, -c))


def nearest(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
            params: NeighbourParams = NeighbourParams()) -> DataFrame:
    """The k candidates of ``df`` nearest to each row of ``queries`` by cosine:
    query_id, rank, vec_id, score."""
    p = params
    bounded_batches(df.sparkSession)
    rows = materialize(_usable(df, id_col, vector_col), "nn-rows")
    asked = materialize(_usable(queries, id_col, vector_col), "nn-queries")
    nq, nc = max(1, -(-asked.count() // p.query_block)), max(1, -(-rows.count() // p.block))
    spread = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    left = asked.withColumns({"qb": spread(nq), "cb": F.explode(F.sequence(F.lit(0), F.lit(nc - 1))), "query": F.lit(True)})
    right = rows.withColumns({"cb": F.pmod(F.xxhash64("v", "id"), F.lit(nc)).cast("int"),
                              "qb": F.explode(F.sequence(F.lit(0), F.lit(nq - 1))), "query": F.lit(False)})
    columns = ["qb", "cb", "query", "id", "v"]

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        sizes = frame["v"].map(len)
        for size in sorted(set(sizes)):  # vectors of one length are compared with each other only
            own = frame[sizes == size]
            q, c = own[own["query"]], own[~own["query"]]
            if not len(q) or not len(c):
                continue
            qv = _matrix(q["v"])
            asked_ = (q["id"].to_numpy(), qv, *quantise(qv))
            best: list[list[tuple[float, int]]] = [[] for _ in range(len(q))]
            for lo in range(0, len(c), p.block):
                cv = _matrix(c["v"].iloc[lo:lo + p.block])
                tile(asked_, (c["id"].to_numpy()[lo:lo + p.block], cv, *quantise(cv)), best, p.k)
            for i, heap in zip(q["id"].tolist(), best):
                for s, c_id in heap:
                    out["query_id"].append(i)
                    out["vec_id"].append(-c_id)
                    out["score"].append(s)
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = (left.select(*columns).union(right.select(*columns)).groupBy("qb", "cb")
             .applyInPandas(search, "query_id long, vec_id long, score double"))

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        """Heaps of several tiles into one for each query."""
        out = []
        for i, own in frame.groupby("query_id"):
            pairs = zip((-own["score"]).tolist(), own["vec_id"].tolist())
            out += [(i, r + 1, c, -s) for r, (s, c) in enumerate(heapq.nsmallest(p.k, pairs))]
        return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])

    found = found.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(max(1, asked.count() // 64))))
    return found.groupBy("part").applyInPandas(merge, "query_id long, rank int, vec_id long, score double")
