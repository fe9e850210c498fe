"""Log probabilities of texts under a weighted backoff automaton.

The model is an n-gram model with Dirichlet smoothing: with c(h) counts of the
training texts and h' the history h without its first word,

    P(w | h) = (c(h w) + strength * P(w | h')) / (c(h) + strength),
    P(w)     = (c(w) + 1) / (N + V + 1).

As an automaton: histories that occur are states.  A state has an arc for each
word seen behind it, with the log probability and the longest state that ends in
the word, and a failure arc of weight log10(strength / (c(h) + strength)) to the
state of h'.  The empty history has an arc for every word.  One traversal from
left to right carries the state, follows failure arcs until a word arc fits, and
adds up the weights; the sum is the log10 probability of the text and its end.

The model grows with the corpus and is in one place nowhere.  Texts form groups
of some megabytes.  Each group sends its distinct n-grams, with their counts in
training texts, to slices of the n-gram space (sorted 64-bit hashes, packed as
differences); a slice adds them up and answers each group with the corpus counts
of what it asked for.  A group then builds the part of the automaton that its
texts can reach and traverses it.  So a task holds a group's texts and n-grams,
or a slice: about ``slice_grams`` entries, and one entry a group for an n-gram that
every group holds, however frequent it is inside.  A text longer than a group is
a group of its own.

Defined results: null text is empty, its only token is the end.  A null id is
learned from and not held out (see the query).  Repeated rows count and are
scored as rows of their own.  Without training texts every word has probability
1 / 1.  Extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import bounded_batches, chunks, giving_back, lower_ascii, materialize, mix64, span_hashes, text_bytes, words_of


@dataclass(frozen=True)
class BackoffParams:
    #: Words of an n-gram: histories have one less.
    order: int = 2
    strength: float = 200.0
    group_bytes: int = 4 << 20
    slice_grams: int = 2_000_000


# Stand for the beginning and the end of a text; no word hashes are reserved (64 bits).
START, END = np.uint64(0x51D7A3C9E2B64F17), np.uint64(0xA7C15E9D3B2F4861)
_ODD = np.uint64(0x9E3779B97F4A7C15)


# ---- n-grams, inside tasks ---------------------------------------------------------

def tokens_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each between START and END; where each text
    begins (n + 1)."""
    data, offs = text_bytes(text)
    words, counts = [], np.zeros(len(offs) - 1, np.int64)
    for lo, hi in chunks(offs):
        part = lower_ascii(data[offs[lo]:offs[hi]])
        starts, stops, rows = words_of(part, offs[lo:hi + 1] - offs[lo])
        words.append(span_hashes(part, starts, stops))
        counts[lo:hi] = np.bincount(rows, minlength=hi - lo)
    bounds = np.concatenate([[0], np.cumsum(counts + 2)])
    out = np.empty(bounds[-1], np.uint64)
    inner = np.ones(len(out), bool)
    inner[bounds[:-1]] = inner[bounds[1:] - 1] = False
    out[bounds[:-1]], out[bounds[1:] - 1] = START, END
    out[inner] = np.concatenate(words) if words else []
    return out, bounds


def grams_of(tokens: np.ndarray, bounds: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order, the hash of the n-gram that ends at each token; 0 where
    the text has too few tokens before it (START stands alone in order 1)."""
    place = np.arange(len(tokens)) - np.repeat(bounds[:-1], np.diff(bounds))
    out = [tokens]
    for k in range(1, order):
        own = np.zeros(len(tokens), np.uint64)
        own[1:] = mix64(out[-1][:-1] * _ODD + tokens[1:])
        own[place < k] = 0
        out.append(own)
    return out


def distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct n-grams (0 left out), the first token that each ends
    at, and the number of the n-gram at each token (-1 for 0)."""
    order = np.argsort(grams, kind="stable")
    g = grams[order]
    new = np.ones(len(g), bool)
    np.not_equal(g[1:], g[:-1], out=new[1:])
    number = np.cumsum(new) - 1
    if len(g) and g[0] == 0:
        new[0] = False
        number -= 1
    at = np.empty(len(g), np.int64)
    at[order] = number
    return g[new], order[new], at


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted uint64 values: the first one and the differences, in as many
    bytes as the largest needs."""
    if not len(values):
        return b""
    gaps = np.diff(values)
    width = max(1, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
    return values[:1].tobytes() + bytes([width]) + gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    gaps = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, raw[8])
    out = np.zeros((len(gaps) + 1, 8), np.uint8)
    out[1:, :raw[8]] = gaps
    out = out.view(np.uint64).ravel()
    out[0] = np.frombuffer(raw, np.uint64, 1)[0]
    return np.cumsum(out, dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    size = next(s for s in (1, 2, 4, 8) if int(values.max(initial=0)) < 1 << (8 * s))
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def unpack_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


# ---- groups of texts ------------------------------------------------------------------

GROUPS = "group long, bytes long, texts binary"


def _grouped(p: BackoffParams):
    """Texts (row, id, train, text) in order as groups, one packed row each."""
    def packed(rows: list[pa.RecordBatch], group: int, size: int) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for r in rows:
                out.write_batch(r)
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([size], pa.int64()),
                                           pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["group", "bytes", "texts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, size = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            offs = text_bytes(batch.column(2))[1]
            for lo, hi in chunks(offs, max(1, p.group_bytes // 4)):
                held.append(batch.slice(lo, hi - lo))
                size += int(offs[hi] - offs[lo])
                if size >= p.group_bytes:
                    yield packed(held, group, size)
                    group, held, size = group + 1, [], 0
        if held:
            yield packed(held, group, size)

    return run


def _texts(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


ASKED = "slice long, group long, grams binary, counts binary"


def _asked(p: BackoffParams, slices: int):
    """A group's distinct n-grams and their training counts, by slice.  Slices
    of order k have the numbers from (k - 1) * slices on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                texts = _texts(raw.as_buffer())
                tokens, bounds = tokens_of(texts.column("text").combine_chunks())
                learn = np.repeat(texts.column("train").to_numpy(), np.diff(bounds))
                rows: tuple[list, list, list] = [], [], []
                for k, grams in enumerate(grams_of(tokens, bounds, p.order)):
                    own, _, at = distinct(grams)
                    counts = np.bincount(at[learn & (at >= 0)], minlength=len(own))
                    cuts = np.searchsorted(slice_of(own, slices), np.arange(slices + 1))
                    for s in np.flatnonzero(np.diff(cuts)).tolist():
                        rows[0].append(k * slices + s)
                        rows[1].append(pack_sorted(own[cuts[s]:cuts[s + 1]]))
                        rows[2].append(pack_counts(counts[cuts[s]:cuts[s + 1]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0], pa.int64()), pa.array([group] * len(rows[0]), pa.int64()), pa.array(rows[1], pa.binary()),
                     pa.array(rows[2], pa.binary())], ["slice", "group", "grams", "counts"])

    return run


def slice_of(grams: np.ndarray, slices: int) -> np.ndarray:
    """Ranges of the hash space, in order."""
    return ((grams >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


ANSWERS = "group long, slice long, counts binary, n long, v long"


def _answers(slices: int):
    """The corpus counts of one slice for each group that asked; one row
    without a group holds the slice's tokens and distinct words (order 1)."""
    def run(asked: pa.Table) -> pa.Table:
        number = asked.column("slice")[0].as_py()
        grams = [unpack_sorted(b.as_py()) for b in asked.column("grams")]
        counts = np.concatenate([unpack_counts(b.as_py()) for b in asked.column("counts")])
        every = np.concatenate(grams)
        order = np.argsort(every, kind="stable")
        g = every[order]
        new = np.ones(len(g), bool)
        np.not_equal(g[1:], g[:-1], out=new[1:])
        sums = np.add.reduceat(counts[order], np.flatnonzero(new))
        total = np.empty(len(g), np.int64)
        total[order] = sums[np.cumsum(new) - 1]
        words = sums[g[new] != START] if number < slices else np.zeros(0, np.int64)
        ends = np.cumsum([len(x) for x in grams])
        out = [pack_counts(x) for x in np.split(total, ends[:-1])]
        n, none = len(out), [None]
        return pa.table({"group": pa.array(asked.column("group").to_pylist() + none, pa.int64()), "slice": pa.array([number] * (n + 1), pa.int64()),
                         "counts": pa.array(out + none, pa.binary()), "n": pa.array([0] * n + [int(words.sum())], pa.int64()),
                         "v": pa.array([0] * n + [int((words > 0).sum())], pa.int64())})

    return run


# ---- the automaton ------------------------------------------------------------------------

class Automaton:
    """States, arcs and failure arcs that the given n-grams reach.

    ``own`` holds for each order the n-grams' (first token, number at each
    token) as ``distinct`` returns them, ``counts`` their corpus counts."""

    def __init__(self, firsts: list[np.ndarray], at: list[np.ndarray], counts: list[np.ndarray], n: int, v: int, strength: float):
        top = len(firsts)
        self.words = len(counts[0])
        prob = (counts[0] + 1) / (n + (v + 1))
        #: The state of each n-gram as a history; 0, the empty one, if it does not occur.
        states, used = [], 1
        for k in range(max(1, top - 1)):
            known = counts[k] > 0 if top > 1 else np.zeros(len(counts[k]), bool)
            own = np.zeros(len(known), np.int64)
            own[known] = used + np.arange(int(known.sum()))
            used += int(known.sum())
            states.append(own)
        fail, fail_weight = np.zeros(used, np.int64), np.zeros(used)
        self.free_weight, self.free_target = np.log10(prob).tolist(), states[0].tolist()
        keys, weights, targets = [], [], []
        for k in range(top):
            own, last = counts[k], firsts[k]
            if k:
                prefix, suffix = at[k - 1][last - 1], at[k - 1][last]
                prob = (own + strength * prob[suffix]) / (counts[k - 1][prefix] + strength)
                arc = own > 0
                keys.append(states[k - 1][prefix[arc]] * self.words + at[0][last[arc]])
                weights.append(np.log10(prob[arc]))
                targets.append(states[k][arc] if k < len(states) else states[k - 1][suffix[arc]])
            if k < len(states):
                here = own > 0 if top > 1 else np.zeros(len(own), bool)
                fail_weight[states[k][here]] = np.log10(strength / (own[here] + strength))
                if k:
                    fail[states[k][here]] = states[k - 1][suffix[here]]
        flat = lambda parts: np.concatenate(parts).tolist() if parts else []
        self.arcs = dict(zip(flat(keys), zip(flat(weights), flat(targets))))
        self.fail, self.fail_weight = fail.tolist(), fail_weight.tolist()

    def score(self, state: int, words: list[int]) -> float:
        """Log10 probability of ``words`` from ``state`` on."""
        total, arcs, n = 0.0, self.arcs, self.words
        fail, fail_weight, free_weight, free_target = self.fail, self.fail_weight, self.free_weight, self.free_target
        for w in words:
            while state:
                arc = arcs.get(state * n + w)
                if arc is not None:
                    total += arc[0]
                    state = arc[1]
                    break
                total += fail_weight[state]
                state = fail[state]
            else:
                total += free_weight[w]
                state = free_target[w]
        return total


SCORES = "row long, id long, n_tokens long, n_known long, base_score double, score double"


def _scored(p: BackoffParams, n: int, v: int):
    """The rows of a group's texts, from its texts and the answers to it."""
    def run(groups: pa.Table, answers: pa.Table) -> pa.Table:
        texts = _texts(groups.column("texts")[0].as_buffer())
        tokens, bounds = tokens_of(texts.column("text").combine_chunks())
        found = [distinct(g) for g in grams_of(tokens, bounds, p.order)]
        own = sorted(zip(answers.column("slice").to_pylist(), answers.column("counts")), key=lambda a: a[0])
        every = np.concatenate([unpack_counts(c.as_py()) for _, c in own])
        counts = np.split(every, np.cumsum([len(g) for g, _, _ in found])[:-1])
        automaton = Automaton([f for _, f, _ in found], [a for _, _, a in found], counts, n, v, p.strength)
        words = found[0][2]
        known = counts[0][words]
        base = np.log10((known + 1) / (n + (v + 1)))
        start = automaton.free_target[int(words[0])] if len(words) else 0  # of START: every text begins with it
        out: tuple[list, list, list, list] = [], [], [], []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            out[0].append(hi - lo - 1)
            out[1].append(int(np.count_nonzero(known[lo + 1:hi])))
            out[2].append(float(base[lo + 1:hi].sum()))
            out[3].append(automaton.score(start, words[lo + 1:hi].tolist()))
        return pa.table({"row": texts.column("row"), "id": texts.column("id"), "n_tokens": pa.array(out[0], pa.int64()),
                         "n_known": pa.array(out[1], pa.int64()), "base_score": pa.array(out[2], pa.float64()),
                         "score": pa.array(out[3], pa.float64())})

    return run


def score_texts(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
                params: BackoffParams = BackoffParams()) -> DataFrame:
    """(row, id, n_tokens, n_known, base_score, score, train_tokens) of every
    row of ``df``; the model learns from the rows where ``train`` holds."""
    p = params
    bounded_batches(df.sparkSession)
    own = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(train, F.lit(False)).alias("train"),
                    F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    groups = materialize(own.mapInArrow(giving_back(_grouped(p)), GROUPS), "lm-groups")
    size = groups.agg(F.sum("bytes")).first()[0] or 0
    slices = int(size // 6 // p.slice_grams) + 1
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = (groups.select("group", "texts").mapInArrow(giving_back(_asked(p, slices)), ASKED)
             .repartition(max(spread, p.order * slices), "slice"))  # so that a task's share does not grow with the input
    answers = materialize(asked.groupBy("slice").applyInArrow(_answers(slices), ANSWERS), "lm-answers")
    sums = answers.where("group IS NULL").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = sums["n"] or 0, sums["v"] or 0
    parts = max(spread, int(size // (8 * p.group_bytes)))
    scored = (groups.select("group", "texts").repartition(parts, "group").groupBy("group")
              .cogroup(answers.where("group IS NOT NULL").select("group", "slice", "counts").repartition(parts, "group").groupBy("group"))
              .applyInArrow(_scored(p, n, v), SCORES))
    return scored.withColumn("train_tokens", F.lit(n).cast("long"))
