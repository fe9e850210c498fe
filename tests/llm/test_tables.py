"""Operators with SQL, sharding, and the pipeline's stages."""

import math
import zlib

import duckdb
import pytest
from cases import classes, edge, edge_rows, empty, shingles, words
from conftest import SF_SMALL

from feedspark.llm.queries import ORACLES, QUERIES
from tools.check_oracle import digest


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = QUERIES[name](spark, SF_SMALL)
    cur = con.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(columns, cur.fetchall())[0]


# ---- quality ---------------------------------------------------------------------

def figures(text):
    w = words(text)
    seen, covered = {}, set()
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i:i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_figures_and_order(spark):
    from pyspark.sql import functions as F

    from feedspark.llm.quality import Rule, apply_rules, base_rule, cascade, default_rules, estimate, with_figures
    extra = [(100, "a b c d e a b c d e a"), (101, "l\nl\n\n l \nl"), (102, "x x x x x x x")]
    df = edge(spark).select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = with_figures(df)
    want = sorted(map(str, [(r[0], *figures(r[1])) for r in edge_rows() + extra]))
    assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got.collect()) == want
    out = apply_rules(got, default_rules()).withColumn("base", base_rule()).collect()
    assert all(not r.kept for r in out if r.base)
    rules = [Rule("never", F.col("n_words") < 0), Rule("often", F.col("n_words") < 10)]
    assert [e.rule.name for e in estimate(got, rules, "doc_id")] == ["often", "never"]
    # a later rule is not evaluated once an earlier one has rejected
    boom = Rule("boom", F.raise_error("evaluated").cast("boolean"))
    all_gone = got.select(cascade([Rule("all", F.col("n_words") >= 0), boom]).alias("r")).collect()
    assert {r.r for r in all_gone} == {"all"}
    assert apply_rules(with_figures(empty(spark).select("doc_id", "text")), default_rules()).count() == 0


def test_quality_costs_order_rules(spark):
    """Of two rules that reject the same rows the cheap one goes first, and of
    two that cost the same the one that rejects more; a rule that needs a dear
    figure pays for it; the sample of rows without ids is bounded too."""
    from pyspark.sql import functions as F

    from feedspark.llm.quality import apply_rules, default_rules, estimate, filter_texts, rule
    text = " ".join(f"w{k % 997} v{k}" for k in range(1500))
    docs = spark.createDataFrame([(None if i % 2 else i, text + str(i) if i % 3 else "short") for i in range(600)], "doc_id long, text string")
    dear = rule("dear", ("n_repeat_words",), lambda r: (r > 5000) | (F.length("text") < 100))
    cheap = rule("cheap", ("word_chars",), lambda c: c < 100)
    never = rule("never", ("word_chars",), lambda c: c < 0)
    found = estimate(docs, [dear, never, cheap], "doc_id")
    assert [e.rule.name for e in found] == ["cheap", "dear", "never"] and found[1].seconds > found[0].seconds
    few = estimate(docs, [cheap], "doc_id", sample_rows=60)[0]
    assert 0.1 < few.rejected < 0.6  # a share of a bounded sample
    kept = apply_rules(docs, default_rules()).where("kept")
    assert sorted(r.text for r in filter_texts(docs).collect()) == sorted(r.text for r in kept.collect())
    assert filter_texts(docs).columns == docs.columns


def test_quality_main_path_is_native(spark):
    p = QUERIES["op10_quality"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in p for x in ("Python", "Pandas", "Arrow", "Exchange"))


# ---- neighbours --------------------------------------------------------------------

def test_neighbours_with_ties_and_odd_vectors(spark):
    from feedspark.llm.neighbours import NeighbourParams, nearest
    vectors = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.1]), (5, None), (6, [0.0, 0.0]), (7, [1.0, None]),
               (8, [math.nan, 1.0]), (9, [math.inf, 1.0]), (10, [3.0, 0.0]), (10, [3.0, 0.0]), (None, [1.0, 0.0]), (11, [1e30, 1e30]), (12, [1.0, 2.0, 3.0]), (13, [])]
    df = spark.createDataFrame(
        [(i, v, 0, "x") for i, v in vectors], "vec_id long, embedding array<float>, label int, id string")
    got = nearest(df, df.where("vec_id IN (0, 3, 12)"), params=NeighbourParams(k=3, block=2, query_block=1)).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
    assert by[0] == [(1, 1.0), (2, 1.0), (10, 1.0)]
    assert by[3][0] == (11, 0.707107) and 12 not in by
    few = nearest(df.where("vec_id IN (0, 3)"), df.where("vec_id = 0")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(0, 1, 3)]
    assert nearest(df.where("vec_id < 0"), df).count() == 0


def test_neighbours_rank_every_copy_as_the_sql_does(spark):
    """The nearest vector is held more than k times, and a query twice."""
    from pyspark.sql import functions as F

    from feedspark.llm.neighbours import NeighbourParams, nearest
    near, rows = [1.0, 0.1], [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0])]
    rows += [(1, near)] * 7 + [(2, [0.1, 1.0])] * 3 + [(i, [1.0, i / 10]) for i in range(3, 20)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    want = con.execute(ORACLES["op7_neighbours"]).fetchall()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for size in (4, 2048):
        got = nearest(df, df.where("vec_id % 50 = 0"), params=NeighbourParams(k=5, block=size, query_block=1))
        got = got.select("query_id", "rank", "vec_id", F.col("score"))
        assert digest(got.columns, [tuple(r) for r in got.collect()])[1] == digest(got.columns, want)[1]


# ---- sharding -----------------------------------------------------------------------

def test_shards(spark):
    rows = QUERIES["op6_shards"](spark, SF_SMALL).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    shards, slots, size = {}, {}, [0] * 24
    for r in rows:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        assert shards.setdefault(raw, r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
        size[r.shard] += r.size
    assert len(rows) == len(text) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size) - min(size) <= 2 * max(len(t.encode()) + 8 for t in text.values())


def test_shards_of_edge_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    from feedspark.llm.sharding import ShardParams, assign, write_shards
    metadata = {"id": F.col("doc_id"), "length": F.length("text"), "source": F.crc32("source")}
    got = assign(edge(spark), metadata, params=ShardParams(shards=5))
    rows = got.collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r.shard < 5 for r in rows)
    null = [r for r in rows if r.doc_id == 0]
    assert [(r.size, r.text_crc32) for r in null] == [(8, None)]
    assert assign(empty(spark), metadata).count() == 0
    write_shards(edge(spark).where("doc_id IS NOT NULL"), got, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == len(edge_rows()) - 1 and {r.shard for r in back.collect()} <= {r.shard for r in rows}


# ---- licences ------------------------------------------------------------------------

MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""


def test_licences(spark):
    import re

    from feedspark.llm.licences import RULES, SENTENCES, SPEAKS, scan
    for ids, _ in RULES:  # the filter of whole texts loses no rule
        assert any(re.search(SPEAKS, s) for s, i in SENTENCES.items() if i in ids)
    lines = MIT.replace("\nIMPLIED", " IMPLIED").replace("\nFITNESS", " FITNESS").replace("\nAUTHORS", " AUTHORS").replace("\nLIABILITY", " LIABILITY")
    lines = lines.replace("\nOUT", " OUT").replace("\nSOFTWARE", " SOFTWARE")
    rows = [(1, lines), (2, "Intro.\nLicensed under the Apache License, Version 2.0.\nThis license is something else.\nReleased under the MIT License."),
            (3, None), (4, ""), (5, "no such thing"), (6, "Licensed under CC BY-NC 4.0."), (7, "spdx-license-identifier: Apache-2.0")]
    got = {r.doc_id: (r.licences, r.n_rules, r.n_unmatched) for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", 1, 1), 2: ("Apache-2.0,MIT", 2, 1), 3: ("", 0, 0), 4: ("", 0, 0), 5: ("", 0, 0), 6: ("CC-BY-NC-4.0", 1, 0),
                   7: got[7]}
    assert scan(edge(spark)).count() == len(edge_rows()) and scan(empty(spark)).count() == 0


APACHE = """   Copyright [yyyy] [name of copyright owner]

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License."""
GPL3 = """    <one line to give the program's name and a brief idea of what it does.>
    Copyright (C) <year>  <name of author>

    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>."""
GPL2 = """    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License along
    with this program; if not, write to the Free Software Foundation, Inc.,
    51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""
BSD2 = """Copyright (c) <year>, <owner>

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""


def _sql_and_operator(spark, rows):
    """Both results for (doc_id, text) rows."""
    import duckdb
    import pandas as pd

    from feedspark.llm.licences import oracle, scan
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = con.execute(oracle()).fetchall()
    got = scan(spark.createDataFrame(rows, "doc_id long, text string")).drop("text").collect()
    return sorted(map(tuple, got)), sorted(want)


def test_licence_sql_on_published_texts(spark):
    commented = lambda text, sign: "\n".join(sign + line for line in text.split("\n"))
    texts = ["MIT License\n\n" + MIT, APACHE, GPL3, GPL2, BSD2 + DISCLAIMER, BSD3 + DISCLAIMER, MIT + "\n\n" + APACHE, MIT + MIT, "", None,
             "Released under the. MIT License.", "Released under the\nMIT License.\nReleased under the MIT License!\nThis license, however"]
    rows = [t for text in texts for t in ((text,) if not text else (text, commented(text, " * "), text.replace("\n", "\r\n"), text.upper()))]
    got, want = _sql_and_operator(spark, list(enumerate(rows)))
    assert got == want and sum(bool(r[2]) for r in got) >= 18


def test_clashing_columns(spark):
    from feedspark.llm.licences import scan
    from feedspark.llm.token_counts import build_trees
    df = spark.createDataFrame([(1, "Released under the MIT License.", "a", "b", 7, [1])],
                               "doc_id long, text string, licences string, _ids string, n_rules int, leaf_chars array<long>")
    r = scan(df).first()
    assert (r.licences, r._ids, r.n_rules, r.leaf_chars) == ("MIT", "b", 1, [1])
    t = build_trees(df).first()
    assert t.licences == "a" and sum(t.leaf_chars) == len(t.text)


def test_licence_texts_as_published(spark):
    from feedspark.llm.licences import scan
    commented = lambda text, sign: "\n".join(sign + line for line in text.split("\n"))
    texts = {"MIT": "MIT License\n\n" + MIT, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL3, "GPL-2.0-or-later": GPL2,
             "BSD-2-Clause": BSD2 + DISCLAIMER, "BSD-3-Clause": BSD3 + DISCLAIMER}
    rows = [(name, t) for name, text in texts.items() for t in (text, commented(text, " * "), commented(text, "# "), text.replace("\n", "\r\n"))]
    rows = [(i, t, name) for i, (name, t) in enumerate(rows)]
    got = {r.doc_id: r for r in scan(spark.createDataFrame(rows, "doc_id long, text string, name string")).collect()}
    assert [(i, got[i].licences, got[i].n_rules) for i, _, _ in rows] == [(i, name, 1) for i, _, name in rows]
    full = "<apache_ref><apache_compliance><apache_copy><apache_as_is><apache_see>"
    assert all(r.sentence_ids.endswith(full) for r in got.values() if r.name == "Apache-2.0")  # not its reference only
    other = [(1, "Some heading\nReleased under the MIT License."), (2, "Released under the. MIT License."), (3, "Not released under the MIT License.")]
    found = {r.doc_id: r.licences for r in scan(spark.createDataFrame(other, "doc_id long, text string")).collect()}
    assert found == {1: "MIT", 2: "", 3: ""}  # lines are joined only into a known sentence, never over a full stop


# ---- the pipeline ---------------------------------------------------------------------

def test_pipeline_stages(spark):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in P.STAGES] == ["toxicity", "language", "near_dup", "mixing", "packing"]
    tables = {}
    for name, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, SF_SMALL), name)
        tables[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = {n: {r.doc_id for r in t.select("doc_id").collect()} for n, t in tables.items()}
    assert ids["toxicity"] >= ids["language"] >= ids["near_dup"] >= ids["mixing"] == ids["packing"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    assert sum(i not in ids["toxicity"] for i, y in labels.items() if y == 0) <= 2
    assert len(ids["language"]) >= len(ids["toxicity"]) - 2
    want = classes({i: shingles(kept[i]) for i in ids["language"]}, 80)
    assert ids["near_dup"] == {i for i, c in want.items() if i == c}
    total = sum(len(words(r.text)) for r in tables["mixing"].collect())
    assert abs(total - 1.5 * sum(len(words(kept[i])) for i in ids["near_dup"])) <= 20
    assert all(r.n_chars == len(r.text) for r in tables["mixing"].collect())


def test_pipeline_stages_on_edge_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as P
    spark.createDataFrame([(3, 1), (5, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (edge(spark), empty(spark)):
        for name, stage in P.STAGES:
            docs = P.materialize(stage(spark, docs, str(tmp_path)), name)
            docs.count()
