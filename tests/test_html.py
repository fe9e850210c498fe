"""Page extraction and element-by-id facts on hand-written pages."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK
from feedspark.functions import html as H
from feedspark.functions.udfs import container_facts
from feedspark.operators.pages import page_content

PAGE = """<html><head><title>My T&amp;itle</title>
<meta content="meta words" name="description"></head><body>
<header><p>one two three four five six header</p></header>
<p>one two three four five</p>
<p class="x">one two three four five six</p>
<p>contains My T&itle and more words here</p>
<p>entity &amp; six seven eight nine ten</p>
<footer><p>one two three four five six footer</p></footer></body></html>"""


def test_page_content(spark):
    df = spark.createDataFrame([("u", PAGE), ("v", "<p>no title one two three four five six</p>")], "url string, html string")
    rows = {r.url: r for r in page_content(df).collect()}
    r = rows["u"]
    assert r.title == "My T&itle"
    assert r.meta_description == "meta words"
    assert r.content == "one two three four five six\nentity & six seven eight nine ten"
    assert r.paragraph_count == 2
    assert r.snippet == r.content[:100]
    # an empty title is contained in every paragraph: nothing is kept
    assert rows["v"].content == "" and rows["v"].paragraph_count == 0


def test_og_description_fallback(spark):
    df = spark.createDataFrame([("<meta property='og:description' content='og text'>",)], "h string")
    assert df.select(H.meta_description("h")).first()[0] == "og text"


FACTS = """<div id="content"><div><p>nested first</p></div><p>direct <b>child</b></p>
<div id="libraryofcongress"><p>one</p><div><p>two</p></div></div>
<div id="vote_explainer"><span><a href="/x?a=1&amp;b=2">l</a></span><a href="/second">s</a></div></div>"""


def test_container_facts(spark):
    df = spark.createDataFrame([(FACTS,), ("<p>no ids</p>",), (None,)], "h string")
    rows = df.select(container_facts(F.col("h")).alias("f")).collect()
    f = rows[0].f
    assert f.has_content and f.content_child_p == "direct child"
    assert f.content_first_p == "nested first"
    assert f.has_summary and f.summary_text == "one two"
    assert f.explainer_href == "/x?a=1&b=2"
    assert rows[1].f is None or not rows[1].f.has_content


class Tree(HTMLParser):
    """Paragraph texts by the standard library's parser and a stack."""

    VOID = "area base br col embed hr img input link meta param source track wbr".split()

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.open, self.found = [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag not in self.VOID:
            here = {"tag": tag, "text": [], "gone": any(e["tag"] in ("header", "footer") for e in self.open)}
            self.open.append(here)
            if tag == "p":
                self.found.append(here)

    def handle_startendtag(self, tag, attrs):
        if tag == "p":
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if any(e["tag"] == tag for e in self.open):
            while self.open.pop()["tag"] != tag:
                pass

    def handle_data(self, data):
        if not self.open or self.open[-1]["tag"] not in ("script", "style"):
            for k, e in enumerate(self.open):
                if not any(x["tag"] in ("header", "footer") for x in self.open[k:]):
                    e["text"].append(data)

    def paragraphs(self):
        return ["".join(e["text"]) for e in self.found if not e["gone"]]


CASES = [
    ("<p>a</p><p>b</p>", ["a", "b"]),
    ("<p>a<p>b<p>c", ["abc", "bc", "c"]),                                  # unclosed: each holds the rest
    ("<div><p>a<div>b</div>c</div><p>d</p>e", ["abc", "d"]),                # closed by its parent
    ("<p>out <span>x<p>in</p> y</span> z</p>w", ["out xin y z", "in"]),     # nested: counted twice
    ("</p>lost<p>a</div>b</p>", ["ab"]),                                    # end tags of nothing
    ("<P CLASS='x>y'>A<br>B<img src=a>C<hr/></P>", ["ABC"]),
    ("<p>a<!-- <p>no</p> -->b<script>if (1 < 2) '<p>'</script>c<style>p{}</style></p>", ["abc"]),
    ("<header><p>h</p></header><p>a<footer>f<p>g</p></footer>b</p><header><p>to the end", ["ab"]),
    ("<p>1 < 2 &amp; &lt;p&gt;</p>", ["1 < 2 & <p>"]),
    ("<section><article><p>a</section>b</p><p>c", ["a", "c"]),
    ("no paragraph", []), ("", []), ("<p></p><p/>", ["", ""])]


def paragraphs_of(spark, pages):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string")
    return [r.ps for r in H.with_paragraphs(df, "h", "ps").orderBy("i").collect()]


def test_nested_and_unclosed_paragraphs(spark):
    got = paragraphs_of(spark, [p for p, _ in CASES] + [None])
    assert got[-1] is None
    for (page, want), own in zip(CASES, got):
        assert own == want, page


def test_paragraphs_against_a_tree(spark):
    """Random tag soup, and all pages of a table."""
    random.seed(2)
    tags = ["p", "p", "/p", "/p", "div", "/div", "span", "/span", "br", "b", "/b", "header", "/header", "/footer", "img alt='a > b'"]
    soup = ["".join(random.choice([f"<{random.choice(tags)}>", f"t{k} "]) for k in range(random.randrange(60))) for _ in range(300)]
    pages = soup + [r.html for r in spark.read.parquet(f"{SF_CHECK}/pages.parquet").select("html").collect()]
    for page, own in zip(pages, paragraphs_of(spark, pages)):
        assert own == Tree(page).paragraphs(), page


@pytest.mark.parametrize("depth", [2000])
def test_deep_and_long_pages(spark, depth):
    page = "<div>" * depth + "<p>in</p>" + "</div>" * depth + "<p>" * 50 + "x" * 100_000
    own = paragraphs_of(spark, [page])[0]
    assert own[0] == "in" and len(own) == 51 and set(own[1:]) == {"x" * 100_000}
