"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers (``floor(scale * c)``); the fit list holds each
distinct vector once.  With A the fit list's rows less their mean, the process
builds orthonormal v_1, v_2, ... (as long as a vector) and u_1, u_2, ... (as
long as the fit list) from alternating products:

    a_k u_k     = A v_k  - b_(k-1) u_(k-1)  - what it holds of u_1 .. u_(k-1)
    b_k v_(k+1) = A' u_k - a_k v_k          - what it holds of v_1 .. v_k

Both are reorthogonalised against all earlier ones.  A is never collected: one
pass over the written fit list computes A v and the products of A' with it, in
numpy inside the tasks, and sums them by position.  No u is stored: each lies in
A's range, so the driver keeps ``g_k`` with ``u_k = A g_k``, and a task forms its
rows' part of u from them.  A lost executor loses nothing but a task.

The small bidiagonal matrix's singular values and right vectors give
eigenvalues and components.  Where A breaks the process off (a space closed
under A'A), it goes on from a new direction orthogonal to all v.  It stops when
the wanted components have converged within half as many steps as there are
dimensions, else it takes them all.  After an early stop a second process starts
orthogonally to the components: what one start cannot meet (equal eigenvalues)
joins in.

The driver holds some vectors of the embedding's length a step, whatever the
number of rows.

Defined results: null vectors, vectors without entries or holding a null or
non-finite entry take no part.  Of vectors of several lengths the commonest
length is used (ties: the longer), the others take no part.  Entries beyond the
range of a long are cut to it; a deviation beyond it is null.  Repeated rows
are rows of their own, fitted once.  Directions without variance are no
components, so fewer than asked may come; without variance no row comes.  Extra
columns are ignored, null ids kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import bounded_batches, giving_back, materialize


@dataclass(frozen=True)
class WhitenParams:
    components: int = 4
    scale: int = 256
    #: Residual, as a share of the largest singular value, under which a component has converged.
    tolerance: float = 1e-14
    #: Singular values under this share of the largest one are no variance.
    zero: float = 1e-10
    seed: int = 7


@dataclass
class Whitening:
    n: int
    sums: list[int]               # S, one a dimension
    mean: np.ndarray
    vectors: np.ndarray           # dimension x components, unit columns
    values: np.ndarray            # eigenvalues of the covariance, falling
    trace: float
    identity_error: float
    steps: int


# ---- inside tasks ----------------------------------------------------------------

def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _total(fit: DataFrame, dim: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``part(rows)``, a vector of doubles, added up
    in each task and then by position."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(_matrix(batch.column(0), dim))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "s"])

    rows = fit.mapInArrow(giving_back(run), "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(len(rows))
    for r in rows:  # a few vectors of the embedding's length
        out[r["i"]] = r["s"]
    return out


def _exact_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Rows and sums by dimension, exact."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            n += len(x)
            if len(x):
                wide = float(np.abs(x.astype(np.float64)).max()) * len(x) < 2.0 ** 62
                own = x.sum(axis=0) if wide else x.astype(object).sum(axis=0)
                total = [a + int(b) for a, b in zip(total, own)]
        yield pa.RecordBatch.from_arrays([pa.array([*range(dim), -1], pa.int32()), pa.array([str(v) for v in (*total, n)])], ["i", "s"])

    rows = (fit.mapInArrow(giving_back(run), "i int, s string").groupBy("i")
            .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    own = {r["i"]: int(r["s"]) for r in rows}
    return own.get(-1, 0), [own.get(i, 0) for i in range(dim)]


# ---- the process -------------------------------------------------------------------

@dataclass
class _Bidiagonal:
    """The process so far.  Column k of ``b`` holds A v_k in terms of the u's."""
    vs: list[np.ndarray]
    gs: list[np.ndarray]          # u_k = A g_k (zeros where A v_k adds nothing new)
    us: list[np.ndarray]          # A' u_k
    alpha: list[float]
    beta: list[float]

    def ritz(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Singular values, right vectors and residuals."""
        k = len(self.alpha)
        b = np.diag(self.alpha) + np.diag(self.beta[:k - 1], 1)
        left, s, right = np.linalg.svd(b)
        return s, np.stack(self.vs[:k], axis=1) @ right.T, np.abs(self.beta[k - 1] * left[-1])


def _bidiagonalise(fit: DataFrame, dim: int, mean: np.ndarray, locked: np.ndarray, done: Callable[[_Bidiagonal], bool],
                   largest: float, p: WhitenParams, rng: np.random.Generator) -> _Bidiagonal:
    """Run the process orthogonally to the columns of ``locked`` until
    ``done`` or until no direction is left."""
    def clean(v: np.ndarray, vs: list[np.ndarray]) -> np.ndarray:
        for _ in range(2):
            for q in (*locked.T, *vs):
                v = v - q * (q @ v)
        return v

    def fresh_direction(vs: list[np.ndarray]) -> np.ndarray:
        v = clean(rng.standard_normal(dim), vs)
        return v / np.linalg.norm(v)

    state = _Bidiagonal([], [], [], [], [])
    v, previous = fresh_direction([]), None
    while True:
        state.vs.append(v)
        g = v.copy()
        if previous is not None:
            g -= state.beta[-1] * previous
        earlier = np.stack(state.gs, axis=1) if state.gs else np.zeros((dim, 0))

        def part(x: np.ndarray, g=g, earlier=earlier) -> np.ndarray:
            a = x - mean
            u = a @ g
            return np.concatenate([[u @ u], (a @ earlier).T @ u, a.T @ u])

        sums = _total(fit, dim, part)
        square, held, back = sums[0], sums[1:1 + earlier.shape[1]], sums[1 + earlier.shape[1]:]
        if earlier.shape[1]:  # full reorthogonalisation of u, carried over to g and A'u
            g = g - earlier @ held
            back = back - np.stack(state.us, axis=1) @ held
            square = square - held @ held
        a = float(np.sqrt(max(0.0, square)))
        largest = max(largest, a)
        if a <= p.zero * largest:  # nothing new in the range of A
            a, g, back = 0.0, np.zeros(dim), np.zeros(dim)
        else:
            g, back = g / a, back / a
        state.alpha.append(a)
        state.gs.append(g)
        state.us.append(back)
        w = clean(back - a * v, state.vs)
        b = float(np.linalg.norm(w))
        if len(state.vs) + locked.shape[1] >= dim:
            state.beta.append(0.0)
            return state
        if b <= p.zero * largest:  # closed: what is found so far is exact, go on beside it
            state.beta.append(0.0)
            v, previous = fresh_direction(state.vs), None
        else:
            state.beta.append(b)
            v, previous = w / b, g
        if largest and done(state):
            return state
        if not largest and len(state.vs) >= 2:  # two random directions without any variance
            return state


def _components(fit: DataFrame, dim: int, mean: np.ndarray, p: WhitenParams) -> tuple[np.ndarray, np.ndarray, int]:
    """Leading singular values of the centred rows, their right vectors, steps."""
    rng = np.random.default_rng(p.seed)
    most = min(p.components, dim)

    def settled(s: _Bidiagonal) -> bool:
        if len(s.alpha) < 2 * most or 2 * len(s.alpha) >= dim:  # a check beside it would cost as much as the rest
            return False
        values, _, residuals = s.ritz()
        return bool((residuals[:most] <= p.tolerance * values[0]).all())

    found = _bidiagonalise(fit, dim, mean, np.zeros((dim, 0)), settled, 0.0, p, rng)
    values, vectors, _ = found.ritz()
    steps = len(found.alpha)
    while steps < dim and values[0] > 0:
        # Equal eigenvalues: a start meets one direction of each only.
        top = vectors[:, :most]
        least = values[most - 1]

        def beside(s: _Bidiagonal) -> bool:
            own, _, residuals = s.ritz()
            return len(own) >= 2 and bool(residuals[0] <= (1e-3 if own[0] < least * (1 - 1e-2) else p.tolerance) * values[0])

        other = _bidiagonalise(fit, dim, mean, top, beside, float(values[0]), p, rng)
        steps += len(other.alpha)
        more, directions, _ = other.ritz()
        if len(more) == 0 or more[0] <= least * (1 + 1e-12):
            break
        joined = np.concatenate([values[:most], more[:1]])
        order = np.argsort(-joined, kind="stable")[:most]
        values, vectors = joined[order], np.concatenate([top, directions[:, :1]], axis=1)[:, order]
    keep = min(most, int((values > p.zero * values[0]).sum()) if values[0] > 0 else 0)
    return values[:keep], vectors[:, :keep], steps


# ---- the operator --------------------------------------------------------------------

def whole_entries(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                  params: WhitenParams = WhitenParams()) -> tuple[DataFrame, int]:
    """(id, x) of the vectors that take part, written; their length."""
    c = F.col(vector_col)
    bad = F.exists(c, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    x = F.transform(c, lambda e: F.floor(e.cast("double") * params.scale).cast("long"))
    rows = vectors.where(c.isNotNull() & (F.size(c) > 0) & ~bad).select(F.col(id_col).alias("id"), x.alias("x"))
    rows = materialize(rows, "white-rows")
    lengths = rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"))
    best = lengths.agg(F.max(F.struct("n", "dim")).alias("m")).first()["m"]
    dim = best["dim"] if best else 0
    return rows.where(F.size("x") == dim), dim


def fit(rows: DataFrame, dim: int, params: WhitenParams = WhitenParams()) -> Whitening | None:
    """Components of the distinct vectors of ``rows`` (id, x)."""
    p = params
    own = materialize(rows.select("x").distinct(), "white-fit")
    n, sums = _exact_sums(own, dim)
    if not n:
        return None
    mean = np.array([s / n for s in sums])
    values, vectors, steps = _components(own, dim, mean, p)
    if not len(values):
        return None
    k = len(values)
    lengths = values / np.sqrt(n)  # standard deviations

    def figures(x: np.ndarray) -> np.ndarray:
        a = x - mean
        w = a @ vectors / lengths
        return np.concatenate([[(a * a).sum()], w.sum(axis=0), (w.T @ w).ravel()])

    got = _total(own, dim, figures)
    means = got[1:1 + k] / n
    error = got[1 + k:].reshape(k, k) / n - np.outer(means, means) - np.eye(k)
    return Whitening(n, sums, mean, vectors, lengths ** 2, float(got[0] / n), float(np.abs(error).max()), steps)


OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           params: WhitenParams = WhitenParams()) -> DataFrame:
    """One row per vector that takes part and component; see ``OUT``."""
    bounded_batches(vectors.sparkSession)
    rows, dim = whole_entries(vectors, id_col, vector_col, params)
    model = fit(rows, dim, params) if dim else None
    if model is None:
        return vectors.sparkSession.createDataFrame([], OUT)
    m, k = model, len(model.values)
    sums = np.array(m.sums, object)
    narrow = all(abs(s) < 1 << 62 for s in m.sums)

    def deviations(x: np.ndarray) -> pa.Array:
        top = max(abs(float(s)) for s in m.sums) + float(np.abs(x.astype(np.float64)).max(initial=0)) * m.n
        if narrow and top * top * dim < 2.0 ** 62:
            off = x * np.int64(m.n) - sums.astype(np.int64)
            return pa.array(np.repeat((off * off).sum(axis=1), k))
        own = [sum((int(v) * m.n - s) ** 2 for v, s in zip(row, m.sums)) for row in x.tolist()]
        return pa.array([v if v < 1 << 63 else None for v in own for _ in range(k)], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.arange(1, k + 1, dtype=np.int32)
        for batch in batches:
            x, r = _matrix(batch.column(1), dim), batch.num_rows
            w = ((x - m.mean) @ m.vectors / np.sqrt(m.values)).ravel()
            ids = batch.column(0).cast(pa.int64()).take(pa.array(np.repeat(np.arange(r), k)))
            full = lambda v: pa.array(np.full(r * k, v))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(numbers, r)), full(np.int64(m.n)), deviations(x), pa.array(w),
                 pa.array(np.tile(m.values / m.trace, r)), full(m.identity_error)],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(giving_back(run), OUT)
