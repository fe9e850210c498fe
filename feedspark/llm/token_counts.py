"""Token counts that follow edits.

A document keeps a segment tree over its pre-tokens: a leaf holds a run of
words (up to ``leaf_words``), with its characters and its token count; inner
nodes hold sums.  Every leaf but the last ends in white space, where the
tokenizer never joins what it finds on both sides, so leaves are counted
alone.  An edit finds its leaves by descending the tree over characters; the
region from the first to the last of them, with the following leaves as
context for as long as its end is no white space, is encoded anew, becomes
the first leaf, and the sums above the changed leaves are updated.  Nothing
else of the text is encoded again.

Edits of one row are applied in order, each to the text that the one before
left: at character ``start`` (from 0), ``deleted`` characters go and
``inserted`` comes.  Starts and lengths beyond the text are cut to it;
negative or null ones count as 0, a null insertion as empty.

Defined results: a null or empty text has one empty leaf and 0 tokens.  Rows
are independent: repeated rows get equal results, and a null id is carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import SPACES, bounded_batches, chunks, giving_back, text_bytes, words_of
from feedspark.llm.tokens import UnitEncoder, default_path, encoder


@dataclass(frozen=True)
class CountParams:
    leaf_words: int = 64


class SegmentTree:
    """Sums of characters and tokens over a fixed number of leaves, as heaps:
    node i has the children 2 i and 2 i + 1, leaf j is node ``width`` + j."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.width = 1 << max(0, len(chars) - 1).bit_length()
        self.sums = []
        for leaves in (chars, tokens):
            heap = [0] * self.width + leaves + [0] * (self.width - len(leaves))
            for i in range(self.width - 1, 0, -1):
                heap[i] = heap[2 * i] + heap[2 * i + 1]
            self.sums.append(heap)

    @property
    def chars(self) -> int:
        return self.sums[0][1]

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at``, and where the leaf starts;
        at the end of the text the last leaf that is not empty."""
        heap, node, start = self.sums[0], 1, 0
        if at >= heap[1]:
            at = max(0, heap[1] - 1)
        while node < self.width:
            node *= 2
            if at >= start + heap[node] and heap[node + 1]:
                start += heap[node]
                node += 1
        return node - self.width, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        for heap, value in zip(self.sums, (chars, tokens)):
            node = self.width + leaf
            change = value - heap[node]
            while node and change:
                heap[node] += change
                node //= 2

    def leaf(self, i: int) -> int:
        return self.sums[0][self.width + i]


class Document:
    """A text with its tree; ``region`` and ``settle`` apply one edit around a
    call of the tokenizer, so that many documents can share that call."""

    def __init__(self, text: str, tree: SegmentTree):
        self.text, self.tree, self.encoded = text, tree, 0

    def region(self, start: int, deleted: int, inserted: str) -> str:
        text, tree = self.text, self.tree
        start = min(max(0, start), len(text))
        end = min(start + max(0, deleted), len(text))
        first, begin = tree.find(start)
        last, stop = first, begin + tree.leaf(first)
        while stop < end or stop < len(text) and not self._closed(text, start, end, stop, inserted, begin):
            last += 1
            stop += tree.leaf(last)
        self.text = text[:start] + inserted + text[end:]
        new = text[begin:start] + inserted + text[end:stop]
        self.pending = (first, last, len(new))
        self.encoded += len(new)
        return new

    @staticmethod
    def _closed(text: str, start: int, end: int, stop: int, inserted: str, begin: int) -> bool:
        """Whether the new region would end in white space (or hold nothing)."""
        if stop > end:
            return text[stop - 1] in SPACES
        if inserted:
            return inserted[-1] in SPACES
        return start == begin or text[start - 1] in SPACES

    def settle(self, tokens: int) -> None:
        first, last, chars = self.pending
        self.tree.put(first, chars, tokens)
        for i in range(first + 1, last + 1):
            self.tree.put(i, 0, 0)


def leaf_starts(data: np.ndarray, offs: np.ndarray, leaf_words: int) -> np.ndarray:
    """Byte at which every leaf starts; each row has one at its start."""
    starts, _, rows = words_of(data, offs)
    first = np.searchsorted(rows, np.arange(len(offs)))
    nth = np.arange(len(starts)) - first[rows]
    return np.sort(np.concatenate([starts[(nth % leaf_words == 0) & (nth > 0)], offs[:-1]]), kind="stable")


def count_leaves(enc: UnitEncoder, data: np.ndarray, offs: np.ndarray, p: CountParams) -> tuple[list[list[int]], list[list[int]]]:
    """Characters and tokens of every row's leaves."""
    cuts = leaf_starts(data, offs, p.leaf_words)
    bounds = np.append(cuts, len(data))
    _, upto = enc.encode(data, bounds) if len(data) else (None, np.zeros(len(bounds), np.int64))
    whole = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars, tokens = np.diff(whole[bounds]), np.diff(upto)
    # rows without bytes share their start with the next row: count leaves by rank
    extra = np.searchsorted(cuts, offs[:-1], "left") + _rank(offs[:-1])
    ends = np.append(extra[1:], len(cuts))
    return ([chars[a:b].tolist() for a, b in zip(extra, ends)], [tokens[a:b].tolist() for a, b in zip(extra, ends)])


def _rank(values: np.ndarray) -> np.ndarray:
    """Position of each value among its equals (values are in order)."""
    if not len(values):
        return np.zeros(0, np.int64)
    first = np.searchsorted(values, values, "left")
    return np.arange(len(values)) - first


TREE = "leaf_chars array<long>, leaf_tokens array<long>"


def build_trees(df: DataFrame, text_col: str = "text", tokenizer: str | None = None,
                params: CountParams = CountParams()) -> DataFrame:
    """``df`` with leaf_chars and leaf_tokens, the leaves of each text's tree;
    columns that have these names already are replaced."""
    bounded_batches(df.sparkSession)
    df = df.drop(*[c for c in df.columns if c.lower() in ("leaf_chars", "leaf_tokens")])
    path, p, at = tokenizer or default_path(), params, df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            data, offs = text_bytes(batch.column(at))
            for lo, hi in chunks(offs):
                chars, tokens = count_leaves(enc, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], p)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(chars, pa.list_(pa.int64())), pa.array(tokens, pa.list_(pa.int64()))],
                    [*part.schema.names, "leaf_chars", "leaf_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(giving_back(run), f"{schema}, {TREE}")


EDITED = "text_after string, tokens_before long, tokens_after long, reencoded_chars long, leaf_chars array<long>, leaf_tokens array<long>"


def apply_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits",
                tokenizer: str | None = None) -> DataFrame:
    """Apply each row's edits (array of struct start, deleted, inserted) to its
    text and tree: id, text_after, counts before and after, the characters
    that were encoded again, and the leaves of the new tree."""
    bounded_batches(df.sparkSession)
    path = tokenizer or default_path()
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(edits_col).alias("edits"), "leaf_chars", "leaf_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for lo, hi in chunks(text_bytes(batch.column(1))[1]):
                part = batch.slice(lo, hi - lo)
                texts, edits, chars, tokens = (c.to_pylist() for c in part.columns[1:])
                docs = [Document(t or "", SegmentTree(c, k)) for t, c, k in zip(texts, chars, tokens)]
                before = [d.tree.tokens for d in docs]
                for turn in range(max((len(e or []) for e in edits), default=0)):
                    own = [(d, e[turn]) for d, e in zip(docs, edits) if e and len(e) > turn and e[turn] is not None]
                    new = [d.region(e["start"] or 0, e["deleted"] or 0, e["inserted"] or "").encode() for d, e in own]
                    offs = np.cumsum([0, *map(len, new)])
                    _, upto = enc.encode(np.frombuffer(b"".join(new), np.uint8), offs)
                    for (d, _), n in zip(own, np.diff(upto).tolist()):
                        d.settle(n)
                leaves = [[d.tree.sums[k][d.tree.width:] for d in docs] for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([d.text for d in docs], pa.string()), pa.array(before, pa.int64()),
                     pa.array([d.tree.tokens for d in docs], pa.int64()), pa.array([d.encoded for d in docs], pa.int64()),
                     *[pa.array(x, pa.list_(pa.int64())) for x in leaves]],
                    ["doc_id", *[c.split(" ")[0] for c in EDITED.split(", ")]])

    return rows.mapInArrow(giving_back(run), f"doc_id long, {EDITED}")


def edit(start: Column, deleted: Column, inserted: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), deleted.cast("long").alias("deleted"), inserted.alias("inserted"))
