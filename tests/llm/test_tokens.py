"""Ids of the cached encoder against the tokenizer's own, on hostile texts."""

import random

import numpy as np
from cases import LONG, TEXTS
from tokenizers import Tokenizer

from feedspark.llm import common
from feedspark.llm.common import chunks, span_hashes, words_of
from feedspark.llm.token_counts import CountParams, Document, SegmentTree, count_leaves
from feedspark.llm.tokens import default_path, encoder

SIGNS = "abcXYZ019 '.,!-_<|>$#éÉßñÑ×÷“—é²½ΣσİıǅЖж中  \t\n\r\x0b\x1c\x85😀‍'stre"


def joined(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_ids_equal_the_tokenizers():
    random.seed(1)
    texts = ["".join(random.choice(SIGNS) for _ in range(random.randint(0, 40))) for _ in range(8000)]
    texts += [t for t in TEXTS if t] + ["don't WE'LL x<|endoftext|>y <|startoftext|>", "a\0b", "ÀÉ'S", "Å À́ 1́ .́"]
    own, other = encoder(default_path()), Tokenizer.from_file(default_path())
    data, offs = joined(texts)
    k = 0
    for lo, hi in chunks(offs, 5000):
        ids, upto = own.encode(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
        for a, b in zip(upto[:-1], upto[1:]):
            assert ids[a:b].tolist() == other.encode(texts[k], add_special_tokens=False).ids, texts[k][:80]
            k += 1
    assert k == len(texts)


def test_words_and_hashes(monkeypatch):
    texts = ["", " a b", "cc", "\t", "a b " + "z" * 70, LONG[:500]]
    data, offs = joined(texts)
    starts, stops, rows = words_of(data, offs)
    assert [(texts[r], data[a:b].tobytes().decode()) for a, b, r in zip(starts, stops, rows)] == [(t, w) for t in texts for w in t.split()]
    whole = span_hashes(data, starts, stops)
    monkeypatch.setattr(common, "_WINDOW", 16)  # spans beyond a window, and longer ones
    common._powers.cache_clear()
    assert (span_hashes(data, starts, stops) == whole).all()
    common._powers.cache_clear()
    by = {}
    for h, a, b in zip(whole.tolist(), starts, stops):
        assert by.setdefault(data[a:b].tobytes(), h) == h
    assert len(set(by.values())) == len(by)


def test_counts_follow_edits():
    random.seed(3)
    own, other = encoder(default_path()), Tokenizer.from_file(default_path())
    count = lambda t: len(other.encode(t, add_special_tokens=False).ids)
    for _ in range(60):
        texts = ["".join(random.choice("ab cé \n.'1") for _ in range(random.choice([0, 1, 5, 40, 300]))) for _ in range(random.randint(1, 4))]
        data, offs = joined(texts)
        for t, chars, tokens in zip(texts, *count_leaves(own, data, offs, CountParams(leaf_words=3))):
            doc = Document(t, SegmentTree(chars, tokens))
            assert (doc.tree.chars, doc.tree.tokens) == (len(t), count(t))
            for _ in range(10):
                at, gone, new = random.randint(0, len(doc.text) + 3), random.choice([0, 0, 1, 3, 50]), "".join(random.choice("xy z\n") for _ in range(random.choice([0, 1, 4])))
                want = doc.text[:at] + new + doc.text[min(at, len(doc.text)) + gone:]
                raw = doc.region(at, gone, new).encode()
                _, upto = own.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                doc.settle(int(upto[-1]))
                assert (doc.text, doc.tree.chars, doc.tree.tokens) == (want, len(want), count(want))


def test_an_edit_in_a_long_text_encodes_little():
    own = encoder(default_path())
    data, offs = joined([LONG])
    (chars,), (tokens,) = count_leaves(own, data, offs, CountParams())
    doc = Document(LONG, SegmentTree(chars, tokens))
    doc.region(40000, 5, "new")
    assert doc.encoded < 2000 < len(LONG)


def test_query_on_edge_rows(spark):
    from cases import edge, edge_rows, empty
    from pyspark.sql import functions as F

    from feedspark.llm.token_counts import apply_edits, build_trees, edit
    other = Tokenizer.from_file(default_path())
    count = lambda t: len(other.encode(t, add_special_tokens=False).ids)
    edits = F.array(edit(F.lit(3), F.lit(2), F.lit("new ")), F.lit(None), edit(F.lit(-1), F.lit(None), F.lit(None)), edit(F.lit(10**6), F.lit(1), F.lit("end")))
    rows = edge(spark).select("doc_id", "text", edits.alias("edits"))
    got = apply_edits(build_trees(rows)).collect()
    want = sorted((str(r[0]), count(r[1] or ""), (r[1] or "")[:3] + "new " + (r[1] or "")[5:] + "end") for r in edge_rows())
    assert sorted((str(r.doc_id), r.tokens_before, r.text_after) for r in got) == want
    assert all(r.tokens_after == count(r.text_after) == sum(r.leaf_tokens) and sum(r.leaf_chars) == len(r.text_after) for r in got)
    assert apply_edits(build_trees(empty(spark).select("doc_id", "text", edits.alias("edits")))).count() == 0
