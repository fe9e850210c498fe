"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedspark.session import scratch_path

#: Bytes of text that a Python task works on at a time (a longer text is taken alone).
CHUNK_BYTES = 1 << 20
#: Most bytes of an Arrow batch between the JVM and a Python worker.
BATCH_BYTES = 2 << 20
#: ASCII white space, the only word separators of `[^\\x20\\x09-\\x0D]+`.
SPACES = " \t\n\x0b\x0c\r"

_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACES]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Have Arrow batches of at most ``BATCH_BYTES`` in this session, so that
    a worker's memory does not follow the texts' length times 10,000 rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, None) or 1 << 40) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared scratch folder and read it
    back: cuts the lineage, survives lost executors, and is computed once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc32_mod3(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 3: remainder 1 is held out."""
    return F.crc32(doc_id.cast("string")) % 3


def prefix_sums(df: DataFrame, group: list[str], order: list[str], weight: str, out: str,
                rows_per_bucket: int = 1000) -> DataFrame:
    """``out``: the sum of ``weight`` over the rows of the same group that come
    before this one.  Rows are ordered by (bucket of a hash of ``order``,
    ``order``), so that a group of any size is spread over many tasks: only
    one row for each (group, bucket) is summed along the whole group.
    ``order`` must identify a row up to repeated rows.  Null weights count 0."""
    b, base = fresh(df, "_bucket"), fresh(df, "_base")
    n = max(1, df.count() // rows_per_bucket + 1)
    rows = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(n)))
    w = F.coalesce(F.col(weight), F.lit(0))
    sums = rows.groupBy(*group, b).agg(F.sum(w).alias(base))
    before = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*[F.col(g).alias(f"_k{i}") for i, g in enumerate(group)], F.col(b).alias("_kb"),
                        F.coalesce(F.sum(base).over(before), F.lit(0)).alias(base))
    on = [F.col(g).eqNullSafe(F.col(f"_k{i}")) for i, g in enumerate(group)] + [F.col(b) == F.col("_kb")]
    inside = Window.partitionBy(*group, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    keys = [f"_k{i}" for i in range(len(group))] + ["_kb"]
    return (rows.withColumn(out, F.coalesce(F.sum(w).over(inside), F.lit(0)))
            .join(bases, functools.reduce(lambda x, y: x & y, on))
            .withColumn(out, F.col(out) + F.col(base)).drop(b, base, *keys))


# ---- inside tasks ----------------------------------------------------------

@functools.lru_cache(maxsize=1)
def _trimmer():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def give_back() -> None:
    """Return freed memory to the system: workers wait for their next task
    beside the others of their executor."""
    pa.default_memory_pool().release_unused()
    _trimmer()(0)


def giving_back(run):
    """``run`` (an iterator function), with ``give_back`` now and then."""
    @functools.wraps(run)
    def wrapped(batches):
        for k, out in enumerate(run(batches), 1):
            yield out
            del out
            if k % 16 == 0:
                give_back()
        give_back()

    return wrapped


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values and their offsets (n + 1); null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` bytes, or one longer row."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def words_of(data: np.ndarray, offs: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the row that it lies in;
    ``separators`` marks the byte values that no word holds."""
    space = separators[data]
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    before[offs[:-1][offs[:-1] < len(data)]] = True
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    ends = offs[1:]
    after[ends[ends > 0] - 1] = True
    starts, stops = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, stops, np.searchsorted(offs, starts, "right") - 1


_BASE = 0x9E3779B97F4A7C15
_WINDOW = CHUNK_BYTES


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(_WINDOW + 1, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span (spans are in order, not empty):
    a polynomial in the bytes, read off running sums over a window."""
    out, lens = np.empty(len(starts), np.uint64), (stops - starts).astype(np.uint64)
    up, down = _powers()
    lo = 0
    while lo < len(starts):
        at = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(stops, at + _WINDOW, "right")))
        if stops[lo] - at > _WINDOW:  # one very long span, in pieces
            own = 0
            for k in range(int(at), int(stops[lo]), _WINDOW):
                part = data[k:min(k + _WINDOW, stops[lo])].astype(np.uint64) + np.uint64(1)
                own += int((part * up[:len(part)]).sum(dtype=np.uint64)) * pow(_BASE, k - int(at), 1 << 64)
            out[lo] = own % (1 << 64)
        else:
            sums = np.zeros(stops[hi - 1] - at + 1, np.uint64)
            np.add(data[at:stops[hi - 1]], np.uint64(1), out=sums[1:], dtype=np.uint64)
            sums[1:] *= up[:len(sums) - 1]
            np.cumsum(sums, out=sums)
            out[lo:hi] = (sums[stops[lo:hi] - at] - sums[starts[lo:hi] - at]) * down[starts[lo:hi] - at]
        lo = hi
    return mix64(out + lens * np.uint64(0xD6E8FEB86659FD93))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]
