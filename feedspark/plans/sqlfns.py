"""DuckDB SQL spellings of the column functions, for the oracle queries.

They restate the definitions independently in SQL (RE2 regexes, 1-based
lists).  Where RE2 lacks a feature (look-behind, back-references), the SQL
uses an equivalent formulation: mark-and-split for sentences, two passes for
header and footer.  Entity decoding is the finite chain of the entities the
test data holds (``&amp;`` last, so nothing is decoded twice).
"""

from __future__ import annotations

from feedspark.config import STOP_WORDS
from feedspark.functions.text import PY_NON_WS, PY_WS


# What the elements look like, stated for DuckDB's RE2.
HEADER, FOOTER, TITLE = (rf"(?is)<{name}(?:\s[^>]*)?>{body}</{name}>" for name, body in
                         (("header", ".*?"), ("footer", ".*?"), ("title", "(.*?)")))
META_BY_NAME = r"""(?is)<meta\s[^>]*\bname\s*=\s*["']description["'][^>]*>"""
META_BY_PROPERTY = r"""(?is)<meta\s[^>]*\bproperty\s*=\s*["']og:description["'][^>]*>"""
CONTENT = r"""(?is)\bcontent\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x):
    return f"regexp_replace({x}, {q(chr(92) + 'A' + PY_WS + '+|' + PY_WS + '+' + chr(92) + 'z')}, '', 'g')"


def strip_tags(x):
    return f"regexp_replace({x}, '<[^<]+?>', '', 'g')"


def unescape(x):
    # '&amp' without its ';' is decoded too (an HTML5 legacy name): '&amp;?'.
    return (f"regexp_replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), "
            f"'&quot;', '\"'), '&#39;', ''''), '&amp;?', '&', 'g')")


def clean_desc(x):
    c = unescape(strip_tags(f"coalesce({x}, '')"))
    return strip(f"regexp_replace(replace({c}, '&nbsp;', ' '), ' +', ' ', 'g')")


def sentences(x):
    return f"string_split(regexp_replace({x}, {q('([.!?])' + PY_WS + '+')}, '\\1' || chr(1), 'g'), chr(1))"


def word_count(x):
    return f"len(regexp_extract_all({x}, {q(PY_NON_WS + '+')}))"


def single_line(x):
    return strip(f"replace(replace(coalesce({x}, ''), chr(10), ' '), chr(13), '')")


def clean_url(x):
    u = f"regexp_replace(regexp_replace(regexp_replace({x}, '[\\t\\r\\n]', '', 'g'), '^[\\x00-\\x20]+', ''), '[?#].*$', '')"
    u = f"(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*:')) || regexp_replace({u}, '^[A-Za-z][A-Za-z0-9+.-]*:', ''))"
    return (f"(CASE WHEN regexp_matches({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*$') THEN {u} "
            f"ELSE regexp_replace({u}, '^(.*/[^/;]*);[^/]*$', '\\1') END)")


def iso_utc(ts):
    return (f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({ts}) % 1000000 <> 0 "
            f"THEN '.' || lpad(CAST(epoch_us({ts}) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00')")


def drop_boilerplate(x):
    return f"regexp_replace(regexp_replace({x}, {q(HEADER)}, '', 'g'), {q(FOOTER)}, '', 'g')"


def page_title(body):
    return unescape(strip_tags(f"regexp_extract({body}, {q(TITLE)}, 1)"))


def meta_description(body):
    name = f"regexp_extract({body}, {q(META_BY_NAME)}, 0)"
    prop = f"regexp_extract({body}, {q(META_BY_PROPERTY)}, 0)"
    tag = f"(CASE WHEN {name} <> '' THEN {name} ELSE {prop} END)"
    dq = f"regexp_extract({tag}, {q(CONTENT)}, 1)"
    sq = f"regexp_extract({tag}, {q(CONTENT)}, 2)"
    return unescape(f"(CASE WHEN {tag} = '' THEN '' WHEN {dq} <> '' THEN {dq} ELSE {sq} END)")


# The pieces of a page for RE2, and a reduction over them: each item carries its own step, the accumulated one the open elements and closed spans.
PIECE = (r"""(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[!?][^>]*>|"""
         r"""</?[a-z](?:[^>"']|"[^"]*"|'[^']*')*>|[^<]+|<""")
NO_END = "'area','base','br','col','embed','hr','img','input','link','meta','param','source','track','wbr','script','style'"


def _item(step, i, opened="[]", spans="[]"):
    return (f"{{'step': {step}, 'i': {i}, 'opened': {opened}::STRUCT(name VARCHAR, i BIGINT)[], "
            f"'spans': {spans}::STRUCT(f BIGINT, t BIGINT, name VARCHAR)[]}}")


def _spans(pieces):
    name = "lower(regexp_extract(t, '^</?([A-Za-z][A-Za-z0-9:-]*)', 1))"
    step = (f"(CASE WHEN NOT regexp_matches(t, '^</?[A-Za-z]') THEN '' WHEN starts_with(t, '</') THEN '/' || {name} "
            f"WHEN ends_with(t, '/>') THEN (CASE WHEN {name} = 'p' THEN 'p/' ELSE '' END) WHEN {name} IN ({NO_END}) THEN '' ELSE {name} END)")
    names = "list_transform(a.opened, lambda s: s.name)"
    keep = f"(CASE WHEN y.step = '/' THEN 0 ELSE len(a.opened) - list_position(list_reverse({names}), substr(y.step, 2)) END)"
    closed = (f"list_concat(a.spans, list_transform(list_filter(a.opened[{keep} + 1:], lambda s: s.name IN ('p', 'header', 'footer')), "
              "lambda s: {'f': s.i, 't': y.i, 'name': s.name}))")
    opened = "list_append(a.opened, {'name': y.step, 'i': y.i})"
    alone = "list_append(a.spans, {'f': y.i, 't': y.i + 1, 'name': 'p'})"
    items = f"list_concat(list_transform({pieces}, lambda t, i: {_item(step, 'i')}), [{_item(q('/'), f'(len({pieces}) + 1)::BIGINT')}])"
    return (f"list_reduce({items}, lambda a, y: CASE "
            f"WHEN y.step = '/' OR (starts_with(y.step, '/') AND list_contains({names}, substr(y.step, 2))) "
            f"THEN {_item(q(''), 'y.i', f'a.opened[1:{keep}]', closed)} WHEN y.step = '' OR starts_with(y.step, '/') THEN a "
            f"WHEN y.step = 'p/' THEN {_item(q(''), 'y.i', 'a.opened', alone)} "
            f"ELSE {_item(q(''), 'y.i', opened, 'a.spans')} END, {_item(q(''), '0::BIGINT')}).spans")


def paragraphs(body):
    pieces = f"regexp_extract_all({body}, {q(PIECE)}, 0)"
    spans = _spans(pieces)
    gone = f"list_filter({spans}, lambda g: g.name <> 'p')"
    inside = lambda i: f"len(list_filter({gone}, lambda g: g.f < {i} AND {i} < g.t)) > 0"
    texts = f"list_transform({pieces}, lambda t, i: CASE WHEN regexp_matches(t, '^<.') OR {inside('i')} THEN '' ELSE t END)"
    kept = f"list_sort(list_filter({spans}, lambda s: s.name = 'p' AND NOT ({inside('s.f')})))"
    text = unescape(f"array_to_string({texts}[s.f + 1 : s.t - 1], '')")
    return f"list_transform({kept}, lambda s: {text})"


def kept_paragraphs(paras, title):
    return f"list_filter({paras}, lambda p: {word_count('p')} > 5 AND NOT contains(p, {title}))"


def stop_list():
    return "[" + ", ".join(q(w) for w in STOP_WORDS) + "]"


def chunks(text, size=5):
    paras = f"string_split({text}, chr(10))"
    return (f"list_transform(range(0, CAST(ceil(len({paras}) / {size}) AS BIGINT)), "
            f"lambda i: array_to_string({paras}[i * {size} + 1 : i * {size} + {size}], chr(10)))")


def lead_sentences(chunk_list):
    return f"list_transform({chunk_list}, lambda c: {sentences('c')}[1])"


def cap_sentences(x, limit=7):
    s = sentences(x)
    return f"(CASE WHEN len({s}) > {limit} THEN array_to_string({s}[1:{limit}], ' ') ELSE {x} END)"


def drop_prompt_lines(x):
    return (f"array_to_string(list_filter(string_split({x}, '. '), "
            f"lambda l: NOT starts_with(l, 'summarize:')), '. ')")


def article_summary(text):
    combined = f"array_to_string({lead_sentences(chunks(text))}, ' ')"
    return drop_prompt_lines(cap_sentences(combined))


def vote_result(d):
    part = f"split_part({d}, 'Vote:', 2)"
    return f"(CASE WHEN contains({d}, 'Vote:') THEN {strip(part)} END)"


def _after_last_action(d):
    return f"split_part({d}, 'Last Action:', 2)"


def activity_ok(d):
    return (f"(contains({d}, 'Last Action:') AND contains({d}, 'Explanation:') "
            f"AND contains({_after_last_action(d)}, 'Explanation:'))")


def last_action(d):
    part = f"split_part({_after_last_action(d)}, 'Explanation:', 1)"
    return f"(CASE WHEN {activity_ok(d)} THEN {strip(part)} END)"


def next_step(d):
    part = f"split_part({_after_last_action(d)}, 'Explanation:', 2)"
    return f"(CASE WHEN {activity_ok(d)} THEN {strip(part)} END)"
