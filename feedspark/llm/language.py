"""Language identification: a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in segments, both ways, and gives every
position a distribution over the languages; a document's distribution is the
mean over its positions that belong to letters.  It is trained here, in numpy,
by backpropagation through time, on a bounded sample (``LanguageParams``) of
labelled rows.  The gates and the candidate state use piecewise linear
activations (a clipped line in place of the sigmoid and of the hyperbolic
tangent), which numpy evaluates several times faster.

Prediction reads whole texts: all segments of a chunk of documents form the
columns of one matrix, so a step of the recurrence is one small product for
thousands of segments.  It needs no shuffle, and memory does not depend on a
text's length beyond the text itself.

Defined results: a null text or one without a letter gives ``und`` and score
0, and so does every text when no labelled row exists.  Repeated rows get
equal results.  A null id counts as not held out and is never sampled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import bounded_batches, chunks, fresh, give_back, text_bytes

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageParams:
    hidden: int = 8
    #: Bytes that are read from one start state.
    segment: int = 128
    #: Bound of the training sample: documents per language and characters of each.
    sample_docs: int = 500
    sample_chars: int = 512
    train_segment: int = 64
    batch: int = 192
    steps: int = 260
    rate: float = 0.02
    seed: int = 7


class ByteGru:
    """One direction reads forward, the other one backward.  Arrays are
    feature-major: a column is a segment."""

    def __init__(self, classes: int, p: LanguageParams):
        rng = np.random.default_rng(p.seed)
        h = p.hidden
        self.hidden = h
        self.weights = {"out": np.zeros((classes, 2 * h), np.float32), "bias": np.zeros((classes, 1), np.float32)}
        for d in "fb":
            self.weights[f"in_{d}"] = rng.normal(0, 0.3, (3 * h, 256)).astype(np.float32)
            self.weights[f"rec_{d}"] = rng.normal(0, 0.5 / np.sqrt(h), (3 * h, h)).astype(np.float32)
        self.weights["out"][:] = rng.normal(0, 0.3, (classes, 2 * h))

    def states(self, d: str, x: np.ndarray, keep: bool = False):
        """States after each step over ``x`` (steps, columns); with ``keep``
        also what backpropagation needs."""
        h, rec, table = self.hidden, self.weights[f"rec_{d}"], self.weights[f"in_{d}"]
        steps, columns = x.shape
        out = np.empty((steps, h, columns), rec.dtype)
        state = np.zeros((h, columns), rec.dtype)
        seen, rest = np.empty((3 * h, columns), rec.dtype), np.empty((3 * h, columns), rec.dtype)
        memo = []
        for t in range(steps):
            np.take(table, x[t], axis=1, out=seen, mode="clip")
            np.dot(rec, state, out=rest)
            gates = rest[:2 * h]
            gates += seen[:2 * h]
            gates *= 0.25
            gates += 0.5
            np.clip(gates, 0, 1, out=gates)
            new = rest[2 * h:] * gates[h:]
            new += seen[2 * h:]
            np.clip(new, -1, 1, out=new)
            if keep:
                memo.append((state.copy(), gates.copy(), rest[2 * h:].copy(), new.copy()))
            state -= new
            state *= gates[:h]
            state += new
            out[t] = state
        return (out, memo) if keep else out

    def probabilities(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Of every position, last first: (step, classes x columns)."""
        h, out, bias = self.hidden, self.weights["out"], self.weights["bias"]
        forward = self.states("f", x)
        backward = self.states("b", x[::-1])
        for t in range(len(x)):
            y = out[:, :h] @ forward[t]
            y += out[:, h:] @ backward[len(x) - 1 - t]
            y += bias
            np.exp(y, out=y)
            y /= y.sum(axis=0)
            yield t, y

    def gradients(self, x: np.ndarray, target: np.ndarray, use: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over the used positions, through time."""
        h, w = self.hidden, self.weights
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        runs = {"f": self.states("f", x, True), "b": self.states("b", x[::-1], True)}
        steps, columns = x.shape
        scale = 1.0 / max(1, use.sum())
        above = {"f": [], "b": [None] * steps}
        for t in range(steps):
            hf, hb = runs["f"][0][t], runs["b"][0][steps - 1 - t]
            y = w["out"][:, :h] @ hf + w["out"][:, h:] @ hb + w["bias"]
            y = np.exp(y - y.max(axis=0))
            y /= y.sum(axis=0)
            y[target, np.arange(columns)] -= 1
            y *= use[t] * scale
            grads["out"][:, :h] += y @ hf.T
            grads["out"][:, h:] += y @ hb.T
            grads["bias"] += y.sum(axis=1, keepdims=True)
            above["f"].append(w["out"][:, :h].T @ y)
            above["b"][steps - 1 - t] = w["out"][:, h:].T @ y
        for d, xs in (("f", x), ("b", x[::-1])):
            rec, memo = w[f"rec_{d}"], runs[d][1]
            down = np.zeros((h, columns), rec.dtype)
            for t in range(steps - 1, -1, -1):
                state, gates, rest, new = memo[t]
                down = down + above[d][t]
                z, r = gates[:h], gates[h:]
                d_new = down * (1 - z) * (np.abs(new) < 1)
                d_z = down * (state - new) * ((z > 0) & (z < 1)) * 0.25
                d_r = d_new * rest * ((r > 0) & (r < 1)) * 0.25
                d_in = np.concatenate([d_z, d_r, d_new])
                d_rec = np.concatenate([d_z, d_r, d_new * r])
                grads[f"rec_{d}"] += d_rec @ state.T
                flat = grads[f"in_{d}"]
                order = np.argsort(xs[t], kind="stable")
                values, first = np.unique(xs[t][order], return_index=True)
                flat[:, values] += np.add.reduceat(d_in[:, order], first, axis=1)
                down = down * z + rec.T @ d_rec
        return grads


def train(segments: np.ndarray, target: np.ndarray, classes: int, p: LanguageParams) -> ByteGru:
    """Adam over class-balanced batches of (rows, bytes) segments."""
    net, rng = ByteGru(classes, p), np.random.default_rng(p.seed)
    mean = {k: np.zeros_like(v) for k, v in net.weights.items()}
    square = {k: np.zeros_like(v) for k, v in net.weights.items()}
    rows = [np.flatnonzero(target == c) for c in range(classes)]
    for step in range(1, p.steps + 1):
        pick = np.concatenate([rng.choice(r, max(1, p.batch // classes)) for r in rows])
        x = segments[pick].T.astype(np.int64)
        grads = net.gradients(x, target[pick], _letters(x).astype(np.float32))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = p.rate * (1 - step / (p.steps + 1))
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            net.weights[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return net


def _letters(x: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters and of characters beyond ASCII."""
    return ((x | 32) - 97 < 26) & ((x | 32) >= 97) | (x >= 128)


def segment_rows(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts cut into rows of ``size`` bytes (padded by blanks), and their text."""
    lens = np.diff(offs)
    per = -(-lens // size)
    row = np.repeat(np.arange(len(lens)), per)
    out = np.full(len(row) * size, 32, np.uint8)
    base = (np.cumsum(per) - per) * size - offs[:-1]
    out[np.arange(len(data)) + np.repeat(base, lens)] = data
    return out.reshape(-1, size), row


def pooled(net: ByteGru, data: np.ndarray, offs: np.ndarray, classes: int, p: LanguageParams,
           columns: int = 2048) -> np.ndarray:
    """Mean distribution of each text's letter positions (0 without letters)."""
    rows, doc = segment_rows(data, offs, p.segment)
    total, count = np.zeros((len(offs) - 1, classes)), np.zeros(len(offs) - 1)
    for lo in range(0, len(rows), columns):
        x = np.ascontiguousarray(rows[lo:lo + columns].T)
        use = _letters(x).astype(np.float32)
        sums = np.zeros((classes, x.shape[1]), np.float32)
        for t, y in net.probabilities(x):
            y *= use[t]
            sums += y
        own = doc[lo:lo + columns]
        for c in range(classes):
            total[:, c] += np.bincount(own, sums[c], len(total))
        count += np.bincount(own, use.sum(axis=0), len(total))
    return total / np.maximum(count, 1)[:, None]


# ---- on tables ---------------------------------------------------------------

def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def learn(rows: DataFrame, id_col: str, text_col: str, lang_col: str,
          p: LanguageParams) -> tuple[ByteGru | None, list[str]]:
    """Train on a bounded sample of the labelled ``rows``: per language about
    ``sample_docs`` documents, chosen by a hash of the id, and of each
    ``sample_chars`` characters from a place chosen by a hash."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return None, []
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, p.sample_docs / counts[k]))) for k in langs])
    at = F.pmod(F.xxhash64(F.lit(p.seed), "id"), F.greatest(F.length("text") - p.sample_chars, F.lit(1))).cast("int") + 1
    sample = (rows.where(F.pmod(F.xxhash64("id", F.lit(p.seed)), F.lit(1 << 20)) < share * (1 << 20))
              .where(has_letter(F.col("text")))
              .select("id", "lang", F.substring(F.col("text"), at, F.lit(p.sample_chars)).alias("piece"))
              .limit(4 * p.sample_docs * len(langs)))
    found = sorted(tuple(r) for r in sample.collect())
    langs = sorted({r[1] for r in found})
    if not langs:
        return None, []
    raw = [r[2].encode() for r in found]
    rows_, doc = segment_rows(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), p.train_segment)
    target = np.array([langs.index(r[1]) for r in found])[doc]
    return train(rows_, target, len(langs), p), langs


def identify(df: DataFrame, net: ByteGru | None, langs: list[str], text_col: str = "text",
             pred: str = "lang_pred", score: str = "score", params: LanguageParams = LanguageParams()) -> DataFrame:
    """``df`` with the predicted language and its pooled probability."""
    p = params
    bounded_batches(df.sparkSession)
    letter = has_letter(F.col(text_col))
    if net is None:
        return df.withColumns({pred: F.lit(UNKNOWN), score: F.lit(0.0)})

    @F.pandas_udf("struct<lang string, score double>")
    def classify(texts):
        import pandas as pd

        give_back()
        data, offs = text_bytes(pa.Array.from_pandas(texts, type=pa.string()))
        best = []
        for lo, hi in chunks(offs):
            best.append(pooled(net, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], len(langs), p))
        probs = np.concatenate(best) if best else np.zeros((0, len(langs)))
        top = probs.argmax(axis=1)
        return pd.DataFrame({"lang": np.array(langs, object)[top], "score": np.clip(probs[np.arange(len(top)), top], 0, 1)})

    own = fresh(df, "_lang")
    found = F.col(own)
    return (df.withColumn(own, classify(F.col(text_col)))
            .withColumns({pred: F.when(letter, found["lang"]).otherwise(UNKNOWN),
                          score: F.when(letter, found["score"]).otherwise(0.0)}).drop(own))
