"""Text functions: golden cases and properties against Python's own str/re."""

import html
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import one_col
from feedspark.functions import text as T
from feedspark.functions.dates import date_token

WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1f \x85\xa0 　"
alphabet = st.sampled_from(list("ab.!?<>&;x") + list(WS_CHARS))
texts = st.text(alphabet=alphabet, max_size=40)


def test_clean_description_golden(spark):
    raw = "a&nbsp;b &amp;nbsp;c &lt;i&gt;x&lt;/i&gt; <b>k</b>\xa0"
    assert one_col(spark, [raw], T.clean_description) == ["a\xa0b c <i>x</i> k"]


def test_clean_description_missing_and_multiline_tag(spark):
    assert one_col(spark, [None, "x <a\nhref='y'>z</a> 1 < 2"], T.clean_description) == ["", "x z 1 < 2"]


@settings(max_examples=20, deadline=None)
@given(st.lists(texts, min_size=1, max_size=8))
def test_properties_match_python(spark, values):
    got_tags = one_col(spark, values, T.strip_tags)
    got_space = one_col(spark, values, T.collapse_spaces)
    got_strip = one_col(spark, values, T.py_strip)
    got_sent = one_col(spark, values, T.split_sentences)
    for v, a, b, c, d in zip(values, got_tags, got_space, got_strip, got_sent):
        assert a == re.sub("<[^<]+?>", "", v)
        assert b == re.sub(" +", " ", v)
        assert c == v.strip()
        assert d == re.split(r"(?<=[.!?])\s+", v)


def test_date_token(spark):
    vals = ["2024-01-05T10:00", "Tue, 2 Jan", "Mon, 1 Jan GMT", "plain", "", "TT"]
    assert one_col(spark, vals, date_token) == ["2024-01-05", "", "Mon, 1 Jan GM", "plain", "", ""]


def test_unescape_matches_stdlib(spark):
    from feedspark.functions.udfs import unescape_html
    cases = ["a &amp; b", "&amp;lt;", "&ampx", "&#39;&#390;", "&copy;", "R&D", "&quot", "&#x41;", "", None]
    got = one_col(spark, cases, unescape_html)
    assert got == [None if c is None else html.unescape(c) for c in cases]


def test_sentences_and_caps(spark):
    seven = "S1. S2. S3. S4. S5. S6. S7."
    eight = seven + " S8!"
    assert one_col(spark, [seven, eight], T.cap_sentences) == [seven, "S1. S2. S3. S4. S5. S6. S7."]
    assert one_col(spark, ["a. ", "x"], T.split_sentences) == [["a.", ""], ["x"]]


def test_drop_prompt_lines(spark):
    vals = ["summarize: a. b. c", "a. summarize: b. c", "a.b"]
    assert one_col(spark, vals, T.drop_prompt_lines) == ["b. c", "a. c", "a.b"]


def test_chunks(spark):
    text = "\n".join(f"p{i}" for i in range(12))
    assert one_col(spark, [text, ""], T.text_chunks) == [
        ["p0\np1\np2\np3\np4", "p5\np6\np7\np8\np9", "p10\np11"], [""]]


def test_bill_markers(spark):
    vals = ["x Vote: Passed 1/2 Vote: again", "ends with Vote:", "no marker"]
    assert one_col(spark, vals, T.vote_result) == ["Passed 1/2", "", None]
    acts = ["Last Action: did Explanation: next", "Last Action: only", "Explanation: b Last Action: a"]
    got = one_col(spark, acts, lambda c: T.bill_activity(c))
    assert [(r["last_action"], r["next_step"]) for r in got] == [("did", "next"), (None, None), (None, None)]


def test_clean_url(spark):
    vals = ["https://h/a/b?q=1#f", "https://h/a;x/b;p?q", "https://h;x", "http://h/p#frag?x", " https://h/x\t", "HTTP://H/P?x"]
    assert one_col(spark, vals, T.clean_url) == ["https://h/a/b", "https://h/a;x/b", "https://h;x",
                                                 "http://h/p", "https://h/x", "http://H/P"]


def test_paragraph_filter(spark):
    df = spark.createDataFrame([(["one two three four five", "one two three four five six",
                                  "Title words here and more and more", "a b c d e f g"], "Title"),
                                (["one two three four five six"], "")],
                               "p array<string>, t string")
    got = [r[0] for r in df.select(T.keep_paragraphs(F.col("p"), F.col("t"))).collect()]
    assert got == [["one two three four five six", "a b c d e f g"], []]
