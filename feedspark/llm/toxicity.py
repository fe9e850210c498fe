"""Toxicity scores behind a noisy-channel deobfuscation.

A token is read as the output of a noisy channel.  Its characters span a
lattice: each may stand for itself, for a letter that it looks like, for nothing
(a separator, a repetition), or for the end of a word.  Viterbi decoding under a
character trigram model finds the likeliest words behind it, over the whole
lattice and at any length; tokens whose lattice has one path (letters, none
twice in a row) are that path.  Letters standing alone in a row are decoded as
one token whose blanks are separators.  A token of digits and number signs is a
number, not a word.

The character model counts the trigrams of all words of all whole texts.  Its
alphabet is fixed: the Latin letters up to U+017F, one class for all other
letters, one for the end of a word.  So its table has a bounded number of entries
at any corpus size, nothing is cut, and only the counted entries reach the
driver.

The restored words' forms and prefixes are the features of a logistic
regression with weights that are never negative: it starts from a low score
and only evidence raises it, so a clean text stays clean at any length.  It is
trained here on a bounded sample of labelled rows (``ToxicityParams``).
Scoring reads whole texts, in one pass without a shuffle.

Defined results: a null or empty text has the score of no evidence.  Without
any labelled row every score is 0.  Repeated rows get equal scores; of several
labels of an id the largest counts; null labels are ignored.
"""

from __future__ import annotations

import functools
import math
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedspark.llm.common import bounded_batches, give_back, giving_back, materialize

# ---- fixed values: what a sign may stand for --------------------------------
LOOK_ALIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}


@dataclass(frozen=True)
class ToxicityParams:
    #: Bound of the labelled sample: documents of each label, each of at most so many characters.
    sample_docs: int = 2500
    sample_chars: int = 30_000
    prefixes: tuple[int, ...] = (4, 5, 6)
    #: Documents that a feature must mark, and its least log odds.
    support: int = 3
    odds: float = 3.0
    #: Least confident share of label 1 that lets one word decide.
    sure: float = 0.9
    steps: int = 800
    rate: float = 1.0
    decay: float = 2e-5
    threshold: float = 0.7
    seed: int = 11


# ---- the character model -------------------------------------------------------

#: Class 0 is the end of a word; Latin letters have classes of their own, all other letters share the last one.
LATIN = [c for c in map(chr, range(0x180)) if c.isalpha() and c == c.lower()]
OTHER = len(LATIN) + 1
SIZE = OTHER + 1
CLASS = {c: i for i, c in enumerate(LATIN, 1)}


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point; 0 for what is no letter."""
    out = np.array([OTHER if chr(c).isalpha() else 0 for c in range(sys.maxunicode + 1)], np.uint8)
    for c, i in CLASS.items():
        out[ord(c)] = i
    return out


def count_trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys ``(a * SIZE + b) * SIZE + c`` of the class trigrams of all words
    of ``text`` (two ends before each word, one behind it), and their counts."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    x = np.zeros(len(codes) + 3, np.int32)
    x[2:-1] = _classes()[codes]
    c, b, a = x[2:], x[1:-1], x[:-2]
    key = ((a * SIZE + b) * SIZE + c)[(c > 0) | (b > 0)]
    # Before a word's first letter stands its predecessor's last one, not an end.
    first = key // SIZE % SIZE == 0
    key[first] %= SIZE
    counts = np.bincount(key, minlength=1)
    held = np.flatnonzero(counts)
    return held, counts[held]


class CharModel:
    """Class trigrams, interpolated with shorter ones."""

    def __init__(self, keys: Iterable[int] = (), counts: Iterable[int] = ()):
        self.keys, self.counts = np.array(list(keys), np.int64), np.array(list(counts), np.int64)
        self._table = None

    def fit(self, words: Iterable[str]) -> CharModel:
        return CharModel(*count_trigrams(" ".join(words)))

    def __getstate__(self):
        return {"keys": self.keys, "counts": self.counts, "_table": None}

    @property
    def table(self) -> memoryview:
        """Log probability of class c after a and b, at (a * SIZE + b) * SIZE + c."""
        if self._table is None:
            three = np.bincount(self.keys, self.counts, SIZE ** 3).reshape(SIZE, SIZE, SIZE)
            two = three.sum(axis=0)
            one = two.sum(axis=0)
            p = (one + 0.5) / (one.sum() + 0.5 * SIZE)
            p = 0.3 * p[None, :] + 0.7 * two / np.maximum(1, two.sum(axis=1))[:, None]
            p = 0.3 * p[None, :, :] + 0.7 * three / np.maximum(1, three.sum(axis=2))[:, :, None]
            self._table = memoryview(np.log(p).ravel())
        return self._table


def char_model(texts: DataFrame) -> CharModel:
    """Of all words of ``texts`` (text, no nulls): counted in each task, then by key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(SIZE ** 3, np.int64)
        for k, batch in enumerate(batches, 1):
            held, size = [], 0
            for t in [*batch.column(0), None]:
                held.append("" if t is None else t.as_py())
                size += len(held[-1])
                if t is None or size > 1 << 20:
                    keys, counts = count_trigrams("\n".join(held))
                    sums[keys] += counts
                    held, size = [], 0
            if k % 16 == 0:
                give_back()
        keys = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(sums[keys])], ["key", "times"])

    counted = (texts.select("text").mapInArrow(giving_back(run), "key int, times long")
               .groupBy("key").agg(F.sum("times").alias("times")).orderBy("key").collect())  # at most SIZE ** 3, some 10,000 in use
    return CharModel([r["key"] for r in counted], [r["times"] for r in counted])


# ---- the channel ------------------------------------------------------------------

#: Log probabilities of what the channel does to a character.
LOOKS, SEPARATOR, EDGE, REPEATED, DIGIT_LOST = -1.0, -2.5, -1.0, -0.3, -9.0
#: A letter written twice; a look-alike sign written twice; a sign that ends a word.
DOUBLED, DOUBLED_SIGN, WORD_END = -3.0, -4.0, -0.5
#: A sign or blank that stands between single letters again and again: inside a word, at its end.
SPREAD, SPREAD_END = -0.1, -1.8


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """What each character of ``token`` (lower case) may stand for: a letter,
    nothing ("") or the end of a word (" "), each with its log probability.  In a
    token of several look-alike signs, without letters and digits, each sign
    stands for a letter."""
    out, n, i = [], len(token), 0
    bare = len(set(token) & LOOK_ALIKE.keys()) > 1 and not any(c.isalnum() for c in token)
    while i < n:
        c, run = token[i], 1
        while i + run < n and token[i + run] == c:
            run += 1
        like = LOOK_ALIKE.get(c, "")
        if c.isalpha():
            one = [(c, 0.0)]
            again = [(c, 0.0), ("", DOUBLED if run == 2 else REPEATED)]
        else:
            letters = [(x, LOOKS) for x in like]
            if c.isalnum():  # a digit
                one, again = letters + [("", DIGIT_LOST)], letters + [("", DOUBLED if run == 2 else REPEATED)]
            else:
                edge = i == 0 or i + run == n
                if run == 1 and not edge and c in (token[i - 2:i - 1], token[i + 2:i + 3]):
                    out.append(letters + [("", SPREAD), (" ", SPREAD_END)])
                    i += 1
                    continue
                one = letters + [("", EDGE if edge else SEPARATOR), (" ", WORD_END)] * (not (bare and like))
                again = letters + [("", DOUBLED_SIGN if like and run == 2 and (bare or not edge) else REPEATED)] + [(" ", WORD_END)] * (not (bare and like))
        out += [one] + [again] * (run - 1)
        i += run
    return out


def decode(token: str, model: CharModel) -> str:
    """The likeliest words behind ``token`` (lower case), by Viterbi search over
    its whole lattice; the state is the last two classes written."""
    table, size = model.table, SIZE
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for options in lattice(token):
        if len(options) == 1 and len(states) == 1 and options[0][0].isalpha():  # no choice here
            (key, (score, out)), (x, cost) = *states.items(), options[0]
            c = CLASS.get(x, OTHER)
            states = {key % size * size + c: (score + cost + table[key * size + c], (out, x))}
            continue
        after: dict[int, tuple[float, tuple | None]] = {}
        for key, (score, out) in states.items():
            for x, cost in options:
                if x == "" or (x == " " and key == 0):
                    to, s, o = key, score + cost, out
                elif x == " ":
                    to, s, o = 0, score + cost + table[key * size], (out, x)
                else:
                    c = CLASS.get(x, OTHER)
                    to, s, o = key % size * size + c, score + cost + table[key * size + c], (out, x)
                if to not in after or after[to][0] < s:
                    after[to] = (s, o)
        states = after
    best = max(((score + (table[key * size] if key else 0.0), -key, out) for key, (score, out) in states.items()), key=lambda b: b[:2])[2]
    letters = []
    while best is not None:
        best, x = best
        letters.append(x)
    return "".join(reversed(letters)).strip()


#: Signs at the ends of a token that stand for no letter.
EDGES = re.compile(r"^[^\w@$!|+(€£]+|[^\w@$!|+(€£]+$")
TWICE = re.compile(r"(.)\1")
NUMBER = re.compile(r"[\d\s.,:;/%+\-$€£()#*=<>]*")
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]+\S){3,}(?!\S)")


def restore(token: str, model: CharModel) -> str:
    """The words behind one token in lower case, with blanks between them."""
    core = EDGES.sub("", token)
    if core.isalpha() and not TWICE.search(core):  # one path
        return core
    if NUMBER.fullmatch(core) and any(c.isdigit() for c in core):
        return ""
    return decode(core, model)


def restored_words(text: str, model: CharModel, cache: dict[str, str]) -> set[str]:
    """The distinct restored words of a whole text."""
    text = text.lower()
    tokens = set(text.split())
    for m in SPACED.finditer(text):
        tokens.add(" ".join(m.group().split()))
    out = set()
    for t in tokens:
        w = cache.get(t)
        if w is None:
            if len(cache) > 100_000:
                cache.clear()
            w = cache[t] = restore(t, model)
        if " " in w:
            out.update(w.split(" "))
        else:
            out.add(w)
    out.discard("")
    return out


def feature_ids(word: str, prefixes: tuple[int, ...]) -> list[int]:
    """Hashes of the word (even) and of its prefixes (odd)."""
    raw = lambda s: 2 * zlib.crc32(s.encode("utf-8", "replace"))
    return [raw(word)] + [raw(word[:n]) + 1 for n in prefixes if len(word) >= n]


@dataclass
class ToxicityModel:
    chars: CharModel
    weights: dict[int, float]
    bias: float
    prefixes: tuple[int, ...]


def fit_weights(docs: list[tuple[int, list[int]]], p: ToxicityParams) -> tuple[dict[int, float], float]:
    """Logistic regression with weights >= 0 over the given features; both
    classes weigh the same."""
    sizes = Counter(y for y, _ in docs)
    keep = sorted({f for _, own in docs for f in own})
    index = {f: i for i, f in enumerate(keep)}
    rows, columns = [], []
    for r, (_, own) in enumerate(docs):
        mine = [index[f] for f in own]
        rows += [r] * len(mine)
        columns += mine
    rows, columns = np.array(rows, np.int64), np.array(columns, np.int64)
    y = np.array([d[0] for d in docs], float)
    share = np.where(y == 1, 0.5 / max(1, sizes[1]), 0.5 / max(1, sizes[0]))
    w, bias = np.zeros(len(keep)), 0.0
    grad2, grad2_bias = np.full(len(keep), 1e-8), 1e-8
    for _ in range(p.steps):  # projected AdaGrad
        z = np.bincount(rows, w[columns], len(y)) + bias if len(keep) else np.full(len(y), bias)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        g = np.bincount(columns, error[rows], len(keep)) + p.decay * w
        grad2 += g * g
        grad2_bias += error.sum() ** 2
        w = np.maximum(0, w - p.rate * g / np.sqrt(grad2))
        bias -= p.rate * error.sum() / math.sqrt(grad2_bias)
    return {f: float(w[i]) for f, i in index.items() if w[i] > 0}, float(bias)


def least_share(hits: float, misses: float, z: float = 1.96) -> float:
    """Lower bound of a share (Wilson's interval)."""
    n = hits + misses
    p = hits / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", params: ToxicityParams = ToxicityParams()) -> ToxicityModel | None:
    """Train on bounded samples of the labelled ``docs``, chosen by a hash of
    the id, and a character model of all ``docs``; only the samples' figures
    and the character model's bounded table reach the driver."""
    p = params
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    chance = F.pmod(F.xxhash64("id", F.lit(p.seed)), F.lit(1 << 30)) / float(1 << 30)
    marks = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
             .where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y")))
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    chars = char_model(texts)
    share = F.when(F.col("y") == 1, F.lit(p.sample_docs / counts.get(1, 1))).otherwise(F.lit(p.sample_docs / counts.get(0, 1)))
    picked = marks.where(chance < share).limit(8 * p.sample_docs)  # the bound that the broadcast relies on
    sample = (texts.where(F.length("text") <= p.sample_chars).join(F.broadcast(picked), "id").select("id", "y", "text"))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def features(column: pd.Series) -> pd.Series:
        cache: dict[str, str] = {}
        return pd.Series([sorted({f for w in restored_words(t, chars, cache) for f in feature_ids(w, p.prefixes)}) for t in column])

    found = materialize(sample.select("id", "y", features("text").alias("f")), "tox-features")
    sizes = {r["y"]: r["n"] for r in found.groupBy("y").agg(F.count("*").alias("n")).collect()}
    seen = (found.select("y", F.explode("f").alias("f")).groupBy("f")
            .agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).where(F.col("pos") >= p.support))
    odds = (F.log((F.col("pos") + 0.5) / (sizes.get(1, 0) + 1)) - F.log((F.col("neg") + 0.5) / (sizes.get(0, 0) + 1)))
    even = sizes.get(1, 0) / max(1, sizes.get(0, 0))  # both labels weigh the same
    marks_ = {r["f"]: least_share(r["pos"], r["neg"] * even) for r in seen.where(odds >= p.odds).collect()}  # few, of a bounded sample

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def marking(column: pd.Series) -> pd.Series:
        return pd.Series([[f for f in own if f in marks_] for own in column], dtype=object)

    docs_ = sorted((r["id"], r["y"], list(r["f"])) for r in found.select("id", "y", marking("f").alias("f")).collect())
    weights, bias = fit_weights([(y, f) for _, y, f in docs_], p)
    for f, share in marks_.items():  # a word that is sure decides alone
        if f % 2 == 0 and share >= p.sure:
            weights[f] = max(weights.get(f, 0.0), math.log(share / (1 - share)) - bias)
    return ToxicityModel(chars, weights, bias, p.prefixes)


def score_column(model: ToxicityModel | None, text: str, params: ToxicityParams = ToxicityParams()):
    """Column with the score (0 to 1) of the text column ``text``."""
    if model is None:
        return F.lit(0.0)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words: dict[str, str] = {}
        marked: dict[str, tuple[int, ...]] = {}
        weights = model.weights

        def value(t: str | None) -> float:
            hits: set[int] = set()
            if t:
                for w in restored_words(t, model.chars, words):
                    own = marked.get(w)
                    if own is None:
                        if len(marked) > 100_000:
                            marked.clear()
                        own = marked[w] = tuple(f for f in feature_ids(w, model.prefixes) if f in weights)
                    if own:
                        hits.update(own)
            return 1 / (1 + math.exp(-min(30.0, model.bias + sum(weights[f] for f in sorted(hits)))))

        for column in batches:
            yield pd.Series([value(t) for t in column], dtype="float64")
            del column
            give_back()

    return score(F.col(text))
