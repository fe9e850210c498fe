"""Packed pieces: exact round trip, bounds, and little padding."""

import zlib

import numpy as np
from cases import edge, edge_rows, empty
from conftest import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from feedspark.llm.packing import Packer, PackParams, pack
from feedspark.llm.tokens import default_path


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60))
def test_packer(sizes):
    packer, rows = Packer(PackParams(length=32, open_windows=3, max_pad=4)), []
    for d, n in enumerate(sizes):
        parts = list(packer.place(n))
        assert [p[0] for p in parts] == [sum(q[1] for q in parts[:k]) for k in range(len(parts))] and sum(p[1] for p in parts) == n
        rows += parts
        assert len(packer.room) <= 3
    ends = {}
    for _, n, window, offset in sorted(rows, key=lambda r: (r[2], r[3])):
        assert offset == ends.get(window, 0)
        ends[window] = offset + n
    assert all(e <= 32 for e in ends.values())
    still_open = {w for _, w in packer.room}
    assert all(e >= 28 for w, e in ends.items() if w not in still_open)


def check(got, rows, length):
    tok = Tokenizer.from_file(default_path())
    ids = {}
    for i, t in rows:
        ids.setdefault(i, tok.encode(t or "", add_special_tokens=False).ids + [1])
    for r in got:
        own = ids[r.doc_id]
        assert (r.doc_tokens, r.ids_crc32) == (len(own), zlib.crc32(np.array(own[r.start:r.start + r.length], "<u4").tobytes()))
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert all(e <= length for e in ends.values())
    assert sum(r.length for r in got) == sum(len(ids[i]) for i, _ in rows)
    return ends


def test_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    ends = check(pack(docs.repartition(3)).collect(), [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert sum(ends.values()) > 0.97 * 2048 * len(ends)


def test_edge_rows(spark):
    got = pack(edge(spark), params=PackParams(length=64)).collect()
    check(got, [(r[0], r[1]) for r in edge_rows()], 64)
    assert {r.doc_tokens for r in got if r.doc_id in (0, 1, 2)} == {1}
    assert pack(empty(spark)).count() == 0
