"""Packing documents into fixed-length token sequences, online and in bounded
space.

Each partition keeps a fixed number of open windows.  A document's full
windows are sealed as they are; its rest goes to the open window that it fills
best.  If none has room, the fullest window is emitted; when that would leave
more than ``max_pad`` ids empty, the window is first filled with the beginning
of the piece, whose remainder is placed in turn.  Windows still open when a
partition ends are leftovers: the leftovers of every ``merge`` partitions are
packed together once more, largest piece first, so at most one poorly filled
window stays for each ``merge`` partitions.

Only numbers are written and shuffled (piece, start, length, checksum), never
texts or ids.  A task that is run again makes the same pieces, and sequence
ids follow from the partition and the window's number in it.

Defined results: a null or empty text is the end id alone.  A null document
id is carried.  Repeated rows are packed once each.  Documents may hold any
number of ids.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import bounded_batches, chunks, giving_back, materialize, text_bytes
from feedspark.llm.tokens import default_path, encoder


@dataclass(frozen=True)
class PackParams:
    length: int = 2048
    #: Open windows of a partition.
    open_windows: int = 16
    #: Ids that an emitted window may leave empty without a cut.
    max_pad: int = 24
    #: Partitions whose leftovers are packed together.
    merge: int = 64
    end_id: int = 1


class Packer:
    """Best fit into a fixed number of open windows."""

    def __init__(self, p: PackParams):
        self.p = p
        self.room: list[tuple[int, int]] = []  # (free ids, window), in order
        self.windows = 0
        self.emitted: set[int] = set()

    def place(self, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the piece, length, window, offset there) of every part."""
        p, start = self.p, 0
        while length - start >= p.length:
            self.emitted.add(self.windows)
            yield start, p.length, self.windows, 0
            self.windows += 1
            start += p.length
        while start < length:
            rest = length - start
            k = bisect_left(self.room, (rest, -1))
            if k < len(self.room):  # the best fit: the least room that is enough
                free, window = self.room.pop(k)
                yield start, rest, window, p.length - free
                self._keep(free - rest, window)
                return
            if len(self.room) < p.open_windows:
                yield start, rest, self.windows, 0
                self._keep(p.length - rest, self.windows)
                self.windows += 1
                return
            free, window = self.room.pop(0)  # none fits: the fullest is emitted
            self.emitted.add(window)
            if free > p.max_pad:
                yield start, free, window, p.length - free
                start += free

    def _keep(self, free: int, window: int) -> None:
        if free:
            insort(self.room, (free, window))
        else:
            self.emitted.add(window)


PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, window long, offset long, "
          "sealed boolean")


def _pack_partition(p: PackParams, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, enc = Packer(p), encoder(path)
        open_pieces: dict[int, list[tuple]] = {}
        for batch in batches:
            ids = batch.column(0)
            data, offs = text_bytes(batch.column(1))
            for lo, hi in chunks(offs):
                flat, upto = enc.encode(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                docs = ids.slice(lo, hi - lo).to_pylist()
                done = []
                for doc, a, b in zip(docs, upto[:-1].tolist(), upto[1:].tolist()):
                    own = np.append(flat[a:b], np.uint32(p.end_id)).astype("<u4").tobytes()
                    total = len(own) // 4
                    for start, n, window, offset in packer.place(total):
                        row = (doc, start, n, zlib.crc32(own[4 * start:4 * (start + n)]), total, part, window, offset)
                        open_pieces.setdefault(window, []).append(row)
                    for window in packer.emitted:
                        done += open_pieces.pop(window)
                    packer.emitted.clear()
                yield _rows(done, True)
        yield _rows([r for rows in open_pieces.values() for r in rows], False)

    return run


_KINDS = [pa.int64()] * 8 + [pa.bool_()]
_NAMES = [x.strip().split(" ")[0] for x in PIECES.split(",")]


def _rows(rows: list[tuple], sealed: bool) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, [sealed] * len(rows)], _KINDS)], _NAMES)


def merge_leftovers(frame: pd.DataFrame, length: int) -> pd.DataFrame:
    """Pack pieces largest first, each into the window that it fills best;
    returns them with their new window and offset."""
    frame = frame.sort_values(["length", "part", "window", "offset"], ascending=[False, True, True, True], kind="stable")
    room: list[tuple[int, int]] = []
    windows, offsets, n = [], [], 0
    for size in frame["length"].tolist():
        k = bisect_left(room, (size, -1))
        free, window = room.pop(k) if k < len(room) else (length, n)
        n = max(n, window + 1)
        windows.append(window)
        offsets.append(length - free)
        if free > size:
            insort(room, (free - size, window))
    return frame.assign(window=windows, offset=offsets)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
         params: PackParams = PackParams()) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, padded_to.  A sequence is padded to ``length``."""
    p, path = params, tokenizer or default_path()
    bounded_batches(df.sparkSession)
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = materialize(texts.mapInArrow(giving_back(_pack_partition(p, path)), PIECES), "pack-pieces")
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, window long, offset long"
    cols = [c.strip().split(" ")[0] for c in out.split(",")]

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        return merge_leftovers(frame, p.length)[cols]

    left = pieces.where("NOT sealed").drop("sealed").withColumn("part", F.floor(F.col("part") / p.merge))
    left = left.groupBy("part").applyInPandas(merged, out)
    # sequence ids: sealed windows of a partition, then merged windows of a group of partitions
    sid = lambda kind: F.shiftleft(F.col("part"), 34) + F.col("window") * 2 + F.lit(kind)
    both = (pieces.where("sealed").select(*cols).withColumn("sequence_id", sid(0))
            .unionByName(left.select(*cols).withColumn("sequence_id", sid(1))))
    return both.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
                       F.lit(p.length).alias("padded_to"))
