"""Feature counts, scores and ranks against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import edge, edge_rows, empty, lowered
from conftest import SF_SMALL

from feedspark.llm.queries import op11_resample
from feedspark.llm.resampling import ResampleParams, crc_of, join_crc, ranked, resample, resampled_documents

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def grams(text):
    w = WORD.findall(lowered(text))
    return len(w), [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=5, least=20):
    """(doc_id, n_features, weight, score, rank) of [(doc_id, text)]."""
    bucket = lambda g: zlib.crc32(g.encode()) % 10000
    s, t = Counter(), Counter()
    own = []
    for i, text in docs:
        n, g = grams(text)
        own.append((i, n, [bucket(x) for x in g]))
        s.update(own[-1][2])
    for text in target:
        t.update(bucket(x) for x in grams(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in s}
    rows = []
    for i, n, g in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in g)
        rows.append([i, n, len(g), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    for k, r in enumerate(able[:percent * len(able) // 100], 1):
        r[5] = k
    return sorted(((r[0], r[2], r[3], r[4], r[5]) for r in rows), key=repr)


def test_crc_of_spans_and_joined_spans():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 20000, dtype=np.uint8)
    starts = np.sort(rng.integers(0, 9000, 200))
    lens = rng.integers(1, 30, 200)
    lens[::9] = rng.integers(60, 9000, len(lens[::9]))
    cut = [data[a:a + n].tobytes() for a, n in zip(starts, lens)]
    c = crc_of(data, starts, starts + lens)
    assert c.tolist() == [zlib.crc32(x) for x in cut]
    assert join_crc(c[:-1], c[1:], lens[1:]).tolist() == [zlib.crc32(a + b) for a, b in zip(cut, cut[1:])]


def test_query_against_plain_python(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    got = op11_resample(spark, SF_SMALL)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, target)


@pytest.mark.parametrize("n,take,hot", [(5000, 5000, 0), (5000, 321, 3000), (700, 1, 700), (40, 39, 0)])
def test_sort_by_regular_sampling_over_many_segments(spark, n, take, hot):
    """Ranks of whole and partial draws; ``hot`` rows are equal in all columns."""
    random.seed(n + take)
    rows = [(7, 5) if k < hot else (random.choice([None, *range(50)]), random.randrange(-40, 40)) for k in range(n)]
    random.shuffle(rows)
    scored = spark.createDataFrame([(i, s, k) for k, (i, s) in enumerate(rows)], "id long, score long, row long").repartition(7)
    got = ranked(scored, take, n, ResampleParams(segment_rows=100, segments=9)).collect()
    want = sorted(rows, key=lambda r: (-r[1], math.inf if r[0] is None else r[0]))
    assert len(got) == n and {r.row for r in got} == set(range(n))
    drawn = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in drawn] == list(range(1, take + 1))
    assert [(r.id, r.score) for r in drawn] == want[:take]


def test_edge_rows(spark):
    p = ResampleParams(percent=50, least_words=2)
    target = edge(spark).where("id = 'x'").select("text")
    got = [(r.id, r.n_features, r.weight, r.score, r["rank"]) for r in resample(edge(spark), target, params=p).collect()]
    rows = edge_rows()
    assert sorted(got, key=repr) == brute([(r[0], r[1]) for r in rows], [r[1] for r in rows if r[5] == "x"], 50, 2)
    kept = resampled_documents(edge(spark), target, params=p)
    assert kept.columns == edge(spark).columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((g[0] for g in got if g[4] is not None), key=repr)
    assert resample(empty(spark), target).count() == 0
    alone = resample(edge(spark), empty(spark), params=p).collect()
    assert len(alone) == len(rows) and {r.n_features for r in alone if r.id in (0, 1, 2)} == {0}
