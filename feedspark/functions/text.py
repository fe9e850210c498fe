"""String expressions of the feed and article jobs.

Everything here is a native Catalyst expression, so it stays inside
whole-stage codegen.  Regexes are Java regexes.  Where Python's ``str``
semantics matter (``strip``, ``split``, ``re``'s Unicode ``\\s``), the
character class is spelled out instead of relying on Java's ``\\s``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters for which Python's str.isspace() is true.  Python's str.strip(),
# str.split() and re's \s (str patterns) all use this set.  Java's \s, even
# with (?U), misses \x1c-\x1f; Spark's trim() only strips the ASCII space.
PY_WS = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
PY_NON_WS = PY_WS.replace("[", "[^", 1)
# The same set as plain characters, for btrim (one linear pass per string).
PY_WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
               + "".join(chr(c) for c in range(0x2000, 0x200B))
               + "\u2028\u2029\u202f\u205f\u3000")

# Fixed values that must equal the reference's behaviour:
# tag pattern of the description cleaner, sentence boundary, split markers.
TAG_PATTERN = r"<[^<]+?>"
SENTENCE_BOUNDARY = r"(?<=[.!?])" + PY_WS + "+"
PROMPT_PREFIX = "summarize:"
LINE_SEPARATOR = ". "
VOTE_MARKER = "Vote:"
LAST_ACTION_MARKER = "Last Action:"
EXPLANATION_MARKER = "Explanation:"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.  (Inside lambdas and CASE
    branches Spark works out a repeated expression again each time.)"""
    return F.element_at(F.transform(F.array(value), body), 1)


# T1
def strip_tags(col) -> Column:
    return F.regexp_replace(_c(col), TAG_PATTERN, "")


# T3
def nbsp_to_space(col) -> Column:
    return F.replace(_c(col), F.lit("&nbsp;"), F.lit(" "))


# T4
def collapse_spaces(col) -> Column:
    """Runs of ASCII spaces -> one space (only runs of two or more are
    rewritten; a single space already is the result)."""
    return F.regexp_replace(_c(col), "  +", " ")


# T5
def py_strip(col) -> Column:
    """str.strip(): btrim with the explicit set of Python whitespace."""
    return F.btrim(_c(col), F.lit(PY_WS_CHARS))


def py_word_count(col) -> Column:
    """len(s.split()) as BIGINT."""
    return F.regexp_count(_c(col), F.lit(PY_NON_WS + "+")).cast("bigint")


# T6
def clean_description(col) -> Column:
    """Tags, then entities, then literal '&nbsp;', then space runs, then strip.

    Entities are decoded after the tags are gone, so '&lt;i&gt;' survives as
    '<i>', as in the reference.  A missing description is the empty string.
    """
    return cleaned(stripped_description(col))


def stripped_description(col) -> Column:
    """The first step of ``clean_description``."""
    return strip_tags(F.coalesce(_c(col), F.lit("")))


def cleaned(col) -> Column:
    """The other steps, which look at their input several times: make it a
    column of its own first where that matters."""
    from feedspark.functions.udfs import unescape_html

    return py_strip(collapse_spaces(nbsp_to_space(unescape_html(_c(col)))))


# T7
def single_line_description(col) -> Column:
    c = F.coalesce(_c(col), F.lit(""))
    c = F.replace(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))
    return py_strip(c)


# T10
def split_sentences(col) -> Column:
    """re.split(r'(?<=[.!?])\\s+', text): trailing empty strings kept."""
    return F.split(_c(col), SENTENCE_BOUNDARY, -1)


def first_sentence(col) -> Column:
    """The first of ``split_sentences``: all up to the first boundary."""
    return F.regexp_extract(_c(col), r"(?s)^(?:.*?[.!?](?=" + PY_WS + r")|.*)", 0)


# W2
def text_chunks(col, size: int = 5) -> Column:
    """Groups of ``size`` newline-separated paragraphs, each re-joined by a
    newline; the last group may be shorter.  Per row, no shuffle."""
    return let(F.split(_c(col), "\n", -1), lambda paras: chunks_of(paras, size))


def chunks_of(paras: Column, size: int = 5) -> Column:
    """``text_chunks`` of paragraphs."""
    return F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(paras) / F.lit(size)).cast("int") - 1),
        lambda i: F.array_join(F.slice(paras, i * size + 1, size), "\n"),
    )


# O4
def cap_sentences(col, limit: int = 7) -> Column:
    s = split_sentences(col)
    return F.when(F.size(s) > limit, F.array_join(F.slice(s, 1, limit), " ")).otherwise(_c(col))


# F6
def drop_prompt_lines(col) -> Column:
    parts = F.split(_c(col), r"\. ", -1)
    kept = F.filter(parts, lambda x: ~x.startswith(PROMPT_PREFIX))
    return F.array_join(kept, LINE_SEPARATOR)


# F7
def novel_points(points, summary) -> Column:
    return F.filter(_c(points), lambda p: ~F.contains(_c(summary), p))


# P6
def content_snippet(col, n: int = 100) -> Column:
    return F.substring(_c(col), 1, n)


# T11
def clean_url(col) -> Column:
    """scheme://netloc/path: drops params (';' in the last path segment),
    query and fragment, as urlunparse(urlparse(u)[:3] + ('', '', '')).
    Tabs and line breaks are removed and leading blanks stripped first, as
    urlsplit does.  The scheme is lower-cased, as there."""
    u = F.regexp_replace(_c(col), r"[\t\r\n]", "")
    u = F.regexp_replace(u, r"^[\x00-\x20]+", "")
    u = F.regexp_replace(u, r"[?#].*$", "")
    scheme = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*:", 0)
    u = F.concat(F.lower(scheme), F.substr(u, F.length(scheme) + 1))
    no_path = u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*$")
    return F.when(no_path, u).otherwise(F.regexp_replace(u, r"^(.*/[^/;]*);[^/]*$", "$1"))


# T12
def derived_url(clean, suffix: str) -> Column:
    return F.concat(_c(clean), F.lit(suffix))


def absolute_url(site: str, href) -> Column:
    """site + relative link; empty when there is no link."""
    h = _c(href)
    return F.when(h.isNull() | (h == ""), F.lit("")).otherwise(F.concat(F.lit(site), h))


# T13
def vote_result(col) -> Column:
    """Text between the first and second 'Vote:', stripped; null if absent."""
    d = _c(col)
    return F.when(F.instr(d, VOTE_MARKER) > 0,
                  py_strip(F.get(F.split(d, VOTE_MARKER, -1), 1)))


# T14
def bill_activity(col) -> Column:
    """struct(last_action, next_step).  Both need both markers; when
    'Explanation:' does not follow the first 'Last Action:' the reference
    raises, here both are null."""
    after = F.get(F.split(_c(col), LAST_ACTION_MARKER, -1), 1)
    both = lambda parts: F.when(F.size(parts) > 1, parts)
    return let(both(F.split(after, EXPLANATION_MARKER, -1)), lambda parts: F.struct(
        py_strip(F.get(parts, 0)).alias("last_action"), py_strip(F.get(parts, 1)).alias("next_step")))


# F4
def keep_paragraphs(paras, title) -> Column:
    """Paragraphs with more than 5 words that do not contain the title.  An
    empty title is contained in every string, so it drops every paragraph."""
    return F.filter(_c(paras), lambda p: (py_word_count(p) > 5) & ~F.contains(p, _c(title)))


# F5
def is_blank(col) -> Column:
    c = _c(col)
    return c.isNull() | (F.length(py_strip(c)) == 0)
