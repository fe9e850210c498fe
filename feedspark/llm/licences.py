"""Licence recognition by sentence rules.

A text is cut into pieces at line ends, full stops, colons and semicolons
(lines that go on in lower case are joined first) and every piece is
normalised.  Pieces in a row that make up a known sentence have its
identifier, wherever its lines are wrapped; one that merely speaks of licences
is ``?``; all others are left out.  Pieces are not joined over a full stop,
and the longest sentence goes first.  The document's sequence of identifiers is then matched against ordered
rules: the first rule takes every place where its identifiers stand in a row,
and what it took is no longer there for later rules, so a licence's full text
comes before the single sentences that it contains.

Everything is SQL expressions on one row at a time: no shuffle, and memory
for one text.  Texts without a word that occurs in all rules' sentences are
passed over at once.

Defined results: a null or empty text has no sentences and no licence.
Repeated rows get equal results; columns of the input that have a result's name
are replaced, all others are left alone.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import fresh

# ---- fixed values: known sentences, as normalised, and their identifiers ------
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the "
    "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the software": "mit_notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement": "as_is",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an "
    "action of contract tort or otherwise arising from out of or in connection with the software or the use or other "
    "dealings in the software": "no_liability",
    "released under the mit license": "mit_ref",
    "licensed under the mit license": "mit_ref",
    "this project is licensed under the mit license": "mit_ref",
    "spdx license identifier mit": "mit_ref",
    "licensed under the apache license version 2.0": "apache_ref",
    "licensed under the apache license version 2.0 the license": "apache_ref",
    "spdx license identifier apache 2.0": "apache_ref",
    "you may not use this file except in compliance with the license": "apache_compliance",
    "you may obtain a copy of the license at http www.apache.org licenses license 2.0": "apache_copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on "
    "an as is basis without warranties or conditions of any kind either express or implied": "apache_as_is",
    "see the license for the specific language governing permissions and limitations under the license": "apache_see",
    "this work is licensed under the gnu general public license version 3": "gpl3_ref",
    "licensed under the gnu general public license version 3": "gpl3_ref",
    "spdx license identifier gpl 3.0 only": "gpl3_ref",
    "spdx license identifier gpl 3.0 or later": "gpl3_plus_ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version 3 of the license or at your option any later "
    "version": "gpl3_plus_grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version 2 of the license or at your option any later "
    "version": "gpl2_plus_grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied "
    "warranty of merchantability or fitness for a particular purpose": "gpl_no_warranty",
    "see the gnu general public license for more details": "gpl_see",
    "you should have received a copy of the gnu general public license along with this program": "gpl_copy",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following "
    "disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
    "disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission": "bsd_endorse",
    "licensed under cc by nc 4.0": "cc_by_nc_ref",
    "licensed under cc by 4.0": "cc_by_ref",
    "licensed under cc by sa 4.0": "cc_by_sa_ref",
    "this work is licensed under a creative commons attribution 4.0 international license": "cc_by_ref",
    "all rights reserved": "reserved",
}
# Identifiers in a row, and the licence that they state; the first rules go first.
RULES = (
    (("mit_grant", "mit_notice", "as_is", "no_liability"), "MIT"),
    (("apache_ref", "apache_compliance", "apache_copy", "apache_as_is", "apache_see"), "Apache-2.0"),
    (("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"), "BSD-3-Clause"),
    (("bsd_grant", "bsd_source", "bsd_binary"), "BSD-2-Clause"),
    (("gpl3_plus_grant", "gpl_no_warranty", "gpl_see", "gpl_copy"), "GPL-3.0-or-later"),
    (("gpl2_plus_grant", "gpl_no_warranty", "gpl_see", "gpl_copy"), "GPL-2.0-or-later"),
    (("gpl3_plus_grant",), "GPL-3.0-or-later"),
    (("gpl2_plus_grant",), "GPL-2.0-or-later"),
    (("gpl3_plus_ref",), "GPL-3.0-or-later"),
    (("gpl3_ref",), "GPL-3.0-only"),
    (("apache_ref",), "Apache-2.0"),
    (("mit_ref",), "MIT"),
    (("cc_by_nc_ref",), "CC-BY-NC-4.0"),
    (("cc_by_sa_ref",), "CC-BY-SA-4.0"),
    (("cc_by_ref",), "CC-BY-4.0"),
)
# A sentence with one of these words speaks of licences; so does some sentence of every rule.
SPEAKS = "licen[sc]e|copyright|permission|redistribut|warrant|spdx"

WRAPPED = r"([^.!?:;\n])[ \t]*\r?\n[ \t*#/]*([a-z(])"
SENTENCE_END = r"([.!?:;])[ \t\n\r\x0b\f]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sentences(text: Column) -> Column:
    joined = F.regexp_replace(text, WRAPPED, "$1 $2")
    return F.split(F.regexp_replace(joined, SENTENCE_END, "$1\n"), "\n", -1)


def normalised(sentence: Column) -> Column:
    """ASCII letters lowered, all but letters, digits and inner dots blank."""
    plain = F.regexp_replace(F.translate(sentence, UPPER, LOWER), "[^a-z0-9.]+", " ")
    return F.trim(F.regexp_replace(plain, r"\.+( |$)", "$1"))


def identifiers(text: Column, known: dict[str, str] = SENTENCES, speaks: str = SPEAKS) -> Column:
    """The sequence of a text's licence sentences, as ``<id>`` in a row."""
    # a line for each piece; a tab closes one that ends a sentence, so that no known sentence runs on
    pieces = F.transform(sentences(text), lambda s: F.concat(normalised(s), F.when(s.rlike(r"[.!?]\s*$"), "\t").otherwise("")))
    lines = F.concat(F.lit("\n"), F.array_join(F.filter(pieces, lambda s: ~s.isin("", "\t")), "\n"), F.lit("\n"))
    longest = sorted(known, key=len, reverse=True)
    mark = lambda s, k: F.regexp_replace(s, "\n" + "[ \n]".join(map(re.escape, k.split(" "))) + "(?=\t?\n)", f"\n<{known[k]}>")
    about = F.filter(F.split(functools.reduce(mark, longest, lines), "\t?\n", -1), lambda s: s.startswith("<") | s.rlike(speaks))
    marked = F.transform(about, lambda s: F.when(s.startswith("<"), s).otherwise("<?>"))
    return F.when(F.translate(text, UPPER, LOWER).rlike(speaks), F.array_join(marked, "")).otherwise("")


def match_rules(sequence: Column, rules=RULES) -> Column:
    """``sequence`` with what the rules take replaced by ``[licence]``."""
    take = lambda s, rule: F.replace(s, F.lit("".join(f"<{i}>" for i in rule[0])), F.lit(f"[{rule[1]}]"))
    return functools.reduce(take, rules, sequence)


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with sentence_ids, licences (in order of appearance, each once),
    n_rules (matches), n_unmatched (licence sentences that no rule takes).
    Columns that have these names already are replaced, all others stay."""
    own = fresh(df, "_ids")  # generated, so that it is worked out once
    out = df.select("*", F.explode(F.array(F.coalesce(identifiers(F.col(text_col)), F.lit("")))).alias(own))
    matched = match_rules(F.col(own))
    found = F.regexp_extract_all(matched, F.lit(r"\[([^\]]+)\]"), F.lit(1))
    return (out.withColumns({"sentence_ids": F.col(own), "licences": F.array_join(F.array_distinct(found), ","),
                             "n_rules": F.size(found).cast("long"), "n_unmatched": F.regexp_count(matched, F.lit("<")).cast("long")}).drop(own))


# ---- the same in DuckDB ------------------------------------------------------------

def oracle(known: dict[str, str] = SENTENCES, rules=RULES) -> str:
    """The operator's definitions in SQL: pieces as lines of their own, known
    sentences marked over any number of them, rules replaced in order."""
    gap, longest = r"(?: |\n\n)", sorted(known, key=len, reverse=True)
    marked = functools.reduce(lambda s, k: rf"regexp_replace({s}, '\n{gap.join(map(re.escape, k.split(' ')))}\t?\n', chr(10) || '<{known[k]}>' || chr(10), 'g')",
                              longest, "lines")
    matched = functools.reduce(lambda s, r: f"replace({s}, '{''.join(f'<{i}>' for i in r[0])}', '[{r[1]}]')", rules, "sentence_ids")
    lower = f"translate(%s, '{UPPER}', '{LOWER}')"
    return rf"""
WITH s AS (
  SELECT doc_id, CASE WHEN NOT regexp_matches({lower % "coalesce(text, '')"}, '{SPEAKS}') THEN [] ELSE
    string_split(regexp_replace(regexp_replace(text, '([^.!?:;\n])[ \t]*\r?\n[ \t*#/]*([a-z(])', '\1 \2', 'g'), '([.!?:;])[ \t\n\r\x0b\f]+', '\1' || chr(10), 'g'), chr(10)) END AS own
  FROM documents
), n AS (
  SELECT doc_id, list_transform(own, lambda x: trim(regexp_replace(regexp_replace({lower % "x"}, '[^a-z0-9.]+', ' ', 'g'), '\.+( |$)', '\1', 'g'))
    || CASE WHEN regexp_matches(x, '[.!?]\s*$') THEN chr(9) ELSE '' END) AS own FROM s
), l AS (
  SELECT doc_id, array_to_string(list_transform(list_filter(own, lambda x: x <> '' AND x <> chr(9)), lambda x: chr(10) || x || chr(10)), '') AS lines FROM n
), k AS (
  SELECT doc_id, string_split(replace({marked}, chr(9), ''), chr(10)) AS own FROM l
), i AS (
  SELECT doc_id, coalesce(array_to_string(list_transform(list_filter(own, lambda x: starts_with(x, '<') OR regexp_matches(x, '{SPEAKS}')),
    lambda x: CASE WHEN starts_with(x, '<') THEN x ELSE '<?>' END), ''), '') AS sentence_ids FROM k
), m AS (SELECT doc_id, sentence_ids, {matched} AS matched FROM i),
f AS (SELECT doc_id, sentence_ids, matched, regexp_extract_all(matched, '\[([^\]]+)\]', 1) AS found FROM m)
SELECT doc_id, sentence_ids,
  array_to_string(list_transform(list_filter(range(1, len(found) + 1), lambda j: list_position(found, found[j]) = j), lambda j: found[j]), ',') AS licences,
  len(found)::BIGINT AS n_rules, (length(matched) - length(replace(matched, '<', '')))::BIGINT AS n_unmatched
FROM f"""
