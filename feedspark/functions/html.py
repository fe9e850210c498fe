"""Page extraction as native expressions.

A page is one row; every function here maps a row to a row, so a page job is
one projection over the pages table with no shuffle.  Paragraphs nest as in the
tree that the reference's parser builds: a page is cut into tags and texts once,
and a fold over the tags keeps the open elements as a stack.  An end tag closes
the innermost open element of its name and all that is open inside it; an
element that nothing closes ends with the page.  A paragraph's text is all text
inside, also that of paragraphs in it, without scripts, styles and comments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.functions.text import keep_paragraphs, let, strip_tags
from feedspark.functions.udfs import unescape_html, unescape_html_array

HEADER_RE = r"(?is)<header(?:\s[^>]*)?>.*?</header>"
FOOTER_RE = r"(?is)<footer(?:\s[^>]*)?>.*?</footer>"
TITLE_RE = r"(?is)<title(?:\s[^>]*)?>(.*?)</title>"
# The pieces of a page: comment, script, style, declaration, tag, text.
PIECE_RE = (r"""(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[!?][^>]*>"""
            r"""|</?[a-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^<]+|<""")
# Elements without an end tag, and those that PIECE_RE takes whole.
NEVER_OPEN = tuple("area base br col embed hr img input link meta param source track wbr script style".split())
FOLLOWED = ("p", "header", "footer")
SPANS = "array<struct<first:int,last:int,name:string>>"
OPEN = "array<struct<name:string,at:int>>"
META_NAME_RE = r"""(?is)<meta\s[^>]*\bname\s*=\s*["']description["'][^>]*>"""
META_PROP_RE = r"""(?is)<meta\s[^>]*\bproperty\s*=\s*["']og:description["'][^>]*>"""
CONTENT_ATTR_RE = r"""(?is)\bcontent\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# H1
def drop_boilerplate(col) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(col), HEADER_RE, ""), FOOTER_RE, "")


# H2
def page_title(col) -> Column:
    return unescape_html(raw_title(col))


def raw_title(col) -> Column:
    """Text of the first title, entities as written."""
    return strip_tags(F.regexp_extract(_c(col), TITLE_RE, 1))


def _content_attr(tag: Column) -> Column:
    dq = F.regexp_extract(tag, CONTENT_ATTR_RE, 1)
    sq = F.regexp_extract(tag, CONTENT_ATTR_RE, 2)
    return F.when(dq != "", dq).otherwise(sq)


# H3
def meta_description(col) -> Column:
    return described(meta_tag(col))


def meta_tag(col) -> Column:
    """The description's meta tag, by name or else by property; empty if there
    is none."""
    h = _c(col)
    return let(F.regexp_extract(h, META_NAME_RE, 0), lambda tag: F.when(tag != "", tag).otherwise(F.regexp_extract(h, META_PROP_RE, 0)))


def described(tag) -> Column:
    """The decoded content of a meta tag."""
    return unescape_html(F.when(_c(tag) != "", _content_attr(_c(tag))).otherwise(F.lit("")))


def _is_tag(piece: Column) -> Column:
    return piece.startswith("<") & (F.length(piece) > 1)


def _step(piece: Column) -> Column:
    """What a piece does to the open elements: '/name' closes, 'name' opens,
    'p/' is a paragraph without content, '' does nothing."""
    name = F.lower(F.regexp_extract(piece, r"^</?([A-Za-z][A-Za-z0-9:-]*)", 1))
    opens = F.when(piece.endswith("/>"), F.when(name == "p", "p/").otherwise("")).when(name.isin(*NEVER_OPEN), "").otherwise(name)
    return F.when(~_is_tag(piece) | (name == ""), "").when(piece.startswith("</"), F.concat(F.lit("/"), name)).otherwise(opens)


def _closed(open_: Column, at: Column) -> Column:
    """Spans of the elements ``open_`` that end at piece ``at``."""
    return F.transform(F.filter(open_, lambda x: x["name"].isin(*FOLLOWED)),
                       lambda x: F.struct(x["at"].alias("first"), at.alias("last"), x["name"].alias("name")))


def element_spans(pieces: Column) -> Column:
    """First and last piece of each paragraph, header and footer."""
    def merge(state: Column, step: Column) -> Column:
        at = state["at"] + 1
        # Elements that stay open: all before the innermost one of the name.
        inner = F.array_position(F.reverse(F.transform(state["open"], lambda x: x["name"])), F.substring(step, 2, 1 << 30))
        keep = (F.size(state["open"]) - inner).cast("int")
        after = (F.when(step.startswith("/") & (inner > 0), F.struct(
                    at.alias("at"), F.slice(state["open"], 1, keep).alias("open"),
                    F.concat(state["spans"], _closed(F.slice(state["open"], keep + 1, F.size(state["open"])), at)).alias("spans")))
                 .when((step == "") | step.startswith("/"), F.struct(at.alias("at"), state["open"].alias("open"), state["spans"].alias("spans")))
                 .when(step == "p/", F.struct(at.alias("at"), state["open"].alias("open"), F.concat(state["spans"], F.array(
                    F.struct(at.alias("first"), (at + 1).alias("last"), F.lit("p").alias("name")))).alias("spans")))
                 .otherwise(F.struct(at.alias("at"), F.concat(state["open"], F.array(F.struct(step.alias("name"), at.alias("at")))).alias("open"),
                                     state["spans"].alias("spans"))))
        return after.cast(f"struct<at:int,open:{OPEN},spans:{SPANS}>")

    empty = lambda t: F.array().cast(t)
    start = F.struct(F.lit(-1).alias("at"), empty(OPEN).alias("open"), empty(SPANS).alias("spans"))
    return F.aggregate(F.transform(pieces, _step), start, merge,
                       lambda state: F.array_sort(F.concat(state["spans"], _closed(state["open"], state["at"] + 1))))


def _texts(pieces: Column, spans: Column) -> Column:
    gone = F.filter(spans, lambda s: s["name"] != "p")
    inside = lambda i: F.exists(gone, lambda g: (g["first"] < i) & (i < g["last"]))
    texts = F.transform(pieces, lambda x, i: F.when(_is_tag(x) | inside(i), "").otherwise(x))
    kept = F.filter(spans, lambda s: (s["name"] == "p") & ~inside(s["first"]))
    return let(texts, lambda t: F.transform(kept, lambda s: F.array_join(F.slice(t, s["first"] + 2, s["last"] - s["first"] - 1), "")))


def paragraph_texts(col) -> Column:
    """Texts of all paragraphs outside header and footer, in order of their
    start tags, entities as written; null for a null page."""
    pieces = F.regexp_extract_all(_c(col), F.lit(PIECE_RE), F.lit(0))
    return let(pieces, lambda x: let(element_spans(x), lambda s: _texts(x, s)))


# H4
def with_paragraphs(df: DataFrame, html_col: str = "html", name: str = "paragraphs") -> DataFrame:
    """Add the array ``name`` of decoded ``paragraph_texts``.  The texts are
    generated, not projected: decoding looks at them several times."""
    raw = f"_{name}_raw"
    return (df.select("*", F.explode(F.array(paragraph_texts(html_col))).alias(raw))
            .withColumn(name, unescape_html_array(F.col(raw))).drop(raw))


# H5
def with_page_content(df: DataFrame, html_col: str = "html", name: str = "pc") -> DataFrame:
    """Add struct ``name`` = (content, title, meta_description, n_paragraphs):
    header and footer removed, paragraphs filtered by F4 and joined by
    newlines.  What is read off the page is generated, not projected, so that
    each pass over the page happens once; the title (decoded in Python when it
    has an entity) must be a column before the paragraph filter can use it."""
    body, raw, title, paras = (f"_{name}_{x}" for x in ("body", "raw", "title", "paras"))
    once = lambda d, value, as_: d.select("*", F.explode(F.array(value)).alias(as_))
    read = F.struct(raw_title(body).alias("title"), meta_tag(body).alias("meta"), paragraph_texts(body).alias("paras"))
    staged = once(once(df, drop_boilerplate(html_col), body), read, raw)
    staged = (staged.withColumn(title, unescape_html(F.col(raw)["title"])).withColumn(paras, unescape_html_array(F.col(raw)["paras"])))
    kept = keep_paragraphs(F.col(paras), F.col(title))
    return (staged
            .withColumn(paras, kept)
            .withColumn(name, F.struct(
                F.array_join(paras, "\n").alias("content"),
                F.col(title).alias("title"),
                described(F.col(raw)["meta"]).alias("meta_description"),
                F.size(paras).cast("bigint").alias("n_paragraphs"),
                F.col(paras).alias("paragraphs")))
            .drop(body, raw, title, paras))
