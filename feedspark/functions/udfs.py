"""The Arrow (pandas) UDFs.  Spark has no built-in for these three jobs:

- ``unescape_html``: HTML entity decoding with the full HTML5 entity table
  (stdlib ``html.unescape``).
- ``container_facts``: element-by-id lookups in raw HTML (first direct-child
  paragraph, all descendant paragraphs, first link) with stdlib
  ``html.parser``.
- ``summarize_chunks``: the pluggable summarizer hook.

Each is vectorised over Arrow batches, and each is called only on rows that
need it: the caller passes null for rows that cannot change (no '&', no
``id=`` attribute), so those rows cross the JVM/Python boundary as nulls.
"""

from __future__ import annotations

import html
from html.parser import HTMLParser
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedspark.config import SummaryParams


@F.pandas_udf(T.StringType())
def _unescape_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda v: html.unescape(v) if isinstance(v, str) else v)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unescape_array_udf(s: pd.Series) -> pd.Series:
    def one(arr):
        if arr is None:
            return None
        return [html.unescape(v) if isinstance(v, str) else v for v in arr]

    return s.map(one)


# The common entities decoded natively, as html.unescape
# decodes them (name with its semicolon -> character).
COMMON_ENTITIES = (("amp;", "&"), ("lt;", "<"), ("gt;", ">"), ("quot;", '"'), ("#39;", "'"),
                   ("apos;", "'"), ("nbsp;", "\xa0"))
# An '&' that html.unescape would read as some *other* reference: a numeric
# one, or a name not in the list above (also a listed name without ';').
OTHER_REF = (r"&(?!(?:" + "|".join(e[:-1] for e, _ in COMMON_ENTITIES) + r");)"
             r"(?:#[0-9xX]|[^\t\n\f <&#;])")


def _native_unescape(col: Column) -> Column:
    """Single pass: split at '&', decode a leading common entity in each
    piece, re-join.  A piece without one keeps its '&'."""
    def piece(p, i):
        e = F.when(i == 0, p)
        for name, ch in COMMON_ENTITIES:
            e = e.when(p.startswith(name), F.concat(F.lit(ch), F.substring(p, len(name) + 1, 1 << 30)))
        return e.otherwise(F.concat(F.lit("&"), p))
    return F.array_join(F.transform(F.split(col, "&", -1), piece), "")


def unescape_html(col: Column) -> Column:
    """html.unescape.  Strings without '&' pass through; strings whose only
    references are the common entities are decoded natively; only the rest
    (numeric references, other named entities) cross to Python."""
    other = col.rlike(OTHER_REF)
    return (F.when(F.instr(col, "&") == 0, col)
            .when(other, _unescape_udf(F.when(other, col)))
            .otherwise(_native_unescape(col)))


def unescape_html_array(col: Column) -> Column:
    needs = F.exists(col, lambda x: x.rlike(OTHER_REF))
    native = F.transform(col, lambda x: F.when(F.instr(x, "&") == 0, x).otherwise(_native_unescape(x)))
    return F.when(needs, _unescape_array_udf(F.when(needs, col))).otherwise(native)


# --- element-by-id facts -------------------------------------------------

# Element ids read by the bill enrichment.
CONTENT_ID = "content"
SUMMARY_ID = "libraryofcongress"
EXPLAINER_ID = "vote_explainer"

# An id attribute naming one of the three elements (cheap native pre-filter).
ID_ATTR_RE = (r"(?i)\bid\s*=\s*[\"']?(?:" + "|".join([CONTENT_ID, SUMMARY_ID, EXPLAINER_ID])
              + r")(?:[\"'\s/>]|$)")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

CONTAINER_FACTS = T.StructType([
    T.StructField("has_content", T.BooleanType()),
    T.StructField("content_child_p", T.StringType()),
    T.StructField("content_first_p", T.StringType()),
    T.StructField("has_summary", T.BooleanType()),
    T.StructField("summary_text", T.StringType()),
    T.StructField("explainer_href", T.StringType()),
])


class _Facts(HTMLParser):
    """One pass over a page: a stack of open elements, closed like a lenient
    tree builder (an end tag pops to its nearest open match, unmatched end
    tags are ignored).  Paragraph text includes all descendant text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = []            # [tag, is_target_id or None, p_buffer or None]
        self.seen = set()          # ids already found (first match wins)
        self.in_id = {}            # id -> depth of its element while open
        self.content_child = None
        self.content_first = None
        self.summary_parts = None
        self.href = None
        self.open_p = []           # [buffer, flags] for open <p>

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        el_id = a.get("id")
        if tag == "p":
            flags = set()
            if CONTENT_ID in self.in_id:
                if self.content_first is None:
                    flags.add("first")
                if self.content_child is None and len(self.stack) == self.in_id[CONTENT_ID] + 1:
                    flags.add("child")
            if SUMMARY_ID in self.in_id:
                flags.add("summary")
            buf = []
            self.open_p.append((buf, flags))
            # reserve document-order slots
            if "first" in flags:
                self.content_first = buf
            if "child" in flags:
                self.content_child = buf
            if "summary" in flags:
                self.summary_parts.append(buf)
        if tag == "a" and EXPLAINER_ID in self.in_id and self.href is None:
            self.href = a.get("href") or ""
        if tag in _VOID:
            return
        self.stack.append(tag)
        if el_id in (CONTENT_ID, SUMMARY_ID, EXPLAINER_ID) and el_id not in self.seen:
            self.seen.add(el_id)
            self.in_id[el_id] = len(self.stack) - 1
            if el_id == SUMMARY_ID:
                self.summary_parts = []

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in self.stack:
            return
        while self.stack:
            depth = len(self.stack) - 1
            top = self.stack.pop()
            for k in [k for k, d in self.in_id.items() if d == depth]:
                del self.in_id[k]
            if top == "p" and self.open_p:
                self.open_p.pop()
            if top == tag:
                break

    def handle_data(self, data):
        for buf, _ in self.open_p:
            buf.append(data)


def _facts(page):
    if not isinstance(page, str):
        return None
    p = _Facts()
    try:
        p.feed(page)
        p.close()
    except Exception:  # malformed markup: report what was seen so far
        pass
    join = "".join
    return {
        "has_content": CONTENT_ID in p.seen,
        "content_child_p": join(p.content_child) if p.content_child is not None else None,
        "content_first_p": join(p.content_first) if p.content_first is not None else None,
        "has_summary": SUMMARY_ID in p.seen,
        "summary_text": " ".join(join(b) for b in p.summary_parts) if p.summary_parts is not None else None,
        "explainer_href": p.href,
    }


@F.pandas_udf(CONTAINER_FACTS)
def _facts_udf(s: pd.Series) -> pd.DataFrame:
    rows = [_facts(v) for v in s]
    cols = {}
    for f in CONTAINER_FACTS.fields:
        vals = [None if r is None else r[f.name] for r in rows]
        dtype = "boolean" if isinstance(f.dataType, T.BooleanType) else object
        cols[f.name] = pd.Series(vals, dtype=dtype)
    return pd.DataFrame(cols)


def container_facts(html_col: Column) -> Column:
    """H6-H8 in one pass.  Pages without any of the three ids never reach
    Python: they are passed as null and come back as an all-null struct."""
    needs = html_col.rlike(ID_ATTR_RE)
    return _facts_udf(F.when(needs, html_col))


# --- summarizer hook -------------------------------------------------------

SummarizerHook = Callable[..., Iterator[pd.Series]]


def summarize_chunks(chunks: Column, hook: SummarizerHook, params: SummaryParams = SummaryParams()) -> Column:
    """Apply a user summarizer to every chunk of an ARRAY<STRING> column.

    ``hook(batches, max_input, max_length, min_length)`` maps an iterator of
    Series (prompted text) to one of Series (summary), so a model can be
    loaded once per Python worker.  Every Series must come back with as many
    rows as it went in; anything else is an error.  Chunks of all rows in an
    Arrow batch are flattened into one Series, summarised, and folded back,
    so the article rows never need a shuffle to be re-assembled.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def _run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lengths = []

        def flat():
            for s in batches:
                lens = [0 if a is None else len(a) for a in s]
                lengths.append((lens, [a is None for a in s]))
                yield pd.Series([c for a in s if a is not None for c in a], dtype=object)

        sizes = {"max_input": params.max_input, "max_length": params.max_length, "min_length": params.min_length}
        for out in hook(flat(), **sizes):
            lens, nulls = lengths.pop(0)
            vals = list(out)
            if len(vals) != sum(lens):
                raise ValueError(f"the summarizer returned {len(vals)} summaries for {sum(lens)} chunks")
            res, i = [], 0
            for n, is_null in zip(lens, nulls):
                res.append(None if is_null else vals[i:i + n])
                i += n
            yield pd.Series(res, dtype=object)
        if lengths:
            raise ValueError(f"the summarizer left {len(lengths)} batches unanswered")

    return _run(chunks)
