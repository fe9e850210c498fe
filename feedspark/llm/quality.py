"""Quality rules as a short-circuit cascade of SQL expressions.

Every rule is a Boolean column over the figures of a text, and names the figures
that it needs.  On a sample of raw texts each rule is timed with the figures that
it needs, less the time that reading the sample takes, and its rejections are
counted; the cascade then asks the rules in the order of rejection per cost, and
a later rule is evaluated only for rows that all earlier ones let pass (nested
CASE).  ``filter_texts`` works the figures out inside the cascade, so that a row
that an early rule rejects costs no later figure; ``apply_rules`` returns all
figures of every row and spares the rules on the text only.  The order changes
the time, never the verdict.

Figures are SQL expressions on whole texts, in one pass without a shuffle: a
text's five-word windows are hashed, sorted with their positions, and the
words that repeated windows cover are summed over the sorted positions, so
the work is n log n in the text's words.

Defined results: a null or empty text has all figures 0 and fails the base
rule.  Repeated rows get equal results; extra columns are left alone.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import SPACES, fresh, materialize

SYMBOLS = "#*$%&|<>"
WINDOW = 5


# ---- figures -------------------------------------------------------------------

def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    blank = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(blank, " ", -1), "")


def word_chars(text: Column) -> Column:
    return F.coalesce(F.length(F.translate(text, SPACES, "")), F.lit(0)).cast("long")


def symbols(text: Column) -> Column:
    return F.coalesce(F.length(text) - F.length(F.translate(text, SYMBOLS, "")), F.lit(0)).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeated_words(word_list: Column) -> Column:
    """Words in five-word windows found twice or more in the text."""
    def covered(w: Column) -> Column:
        zipped = F.arrays_zip(w, *[F.slice(w, k + 1, F.size(w)) for k in range(1, WINDOW)])
        keyed = F.transform(F.slice(zipped, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))),
                            lambda x, i: F.struct(F.xxhash64(x).alias("h"), i.alias("i")))
        return let(F.sort_array(keyed), in_sorted)

    def in_sorted(s: Column) -> Column:
        h = lambda i: F.get(s, i)["h"]
        again = F.filter(s, lambda x, i: (x["h"] == F.coalesce(h(i - 1), F.bitwise_not(x["h"]))) | (x["h"] == F.coalesce(h(i + 1), F.bitwise_not(x["h"]))))
        return let(F.sort_array(F.transform(again, lambda x: x["i"])), spread)

    def spread(at: Column) -> Column:
        own = F.transform(at, lambda x, i: F.least(F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(own, F.lit(0).cast("long"), lambda acc, x: acc + x)

    return F.when(F.size(word_list) <= WINDOW, F.lit(0).cast("long")).otherwise(let(word_list, covered))


#: The figures, each as an expression of the text.
FIGURES = {
    "n_words": lambda text: F.size(words(text)).cast("long"),
    "word_chars": word_chars,
    "n_symbols": symbols,
    "n_dup_lines": duplicate_lines,
    "n_repeat_words": lambda text: let(words(text), repeated_words),
}


def with_figures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text, own = F.col(text_col), fresh(df, "_words")
    return (df.withColumn(own, words(text))
            .withColumns({"n_words": F.size(own).cast("long"), "word_chars": word_chars(text), "n_symbols": symbols(text),
                          "n_dup_lines": duplicate_lines(text), "n_repeat_words": repeated_words(F.col(own))}).drop(own))


# ---- the cascade -----------------------------------------------------------------

@dataclass(frozen=True)
class Rule:
    """Rejects the rows for which ``rejects`` is true; ``needs`` names the
    figures in it, ``on_text`` is the same with the figures worked out in place."""
    name: str
    rejects: Column
    needs: tuple[str, ...] = ()
    on_text: Column | None = None


def rule(name: str, needs: tuple[str, ...], rejects, text_col: str = "text") -> Rule:
    """A rule from ``rejects``, a function of its figures."""
    text = F.col(text_col)
    return Rule(name, rejects(*[F.col(n) for n in needs]), needs, rejects(*[FIGURES[n](text) for n in needs]))


def base_rule() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def default_rules(text_col: str = "text") -> list[Rule]:
    """Rules on figures, and some that need the text itself."""
    text = F.col(text_col)
    lines = F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return [
        rule("base", ("n_words", "n_repeat_words"), lambda n, r: (n < 10) | (r * 100 > n * 20), text_col),
        rule("symbols", ("n_symbols", "word_chars"), lambda s, c: s * 10 > c, text_col),
        rule("word_length", ("word_chars", "n_words"), lambda c, n: (c < n * 2) | (c > n * 25), text_col),
        rule("repeated_lines", ("n_dup_lines",), lambda d: d * 2 > lines, text_col),
        rule("letters", ("word_chars",), lambda c: letters * 2 < c, text_col),
    ]


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / self.seconds


def estimate(df: DataFrame, rules: list[Rule], id_col: str, sample_rows: int = 2000, text_col: str = "text") -> list[Estimate]:
    """Cost and rejections of each rule on about ``sample_rows`` rows, chosen by
    a hash of id and text; best rejection per cost first.  A rule's cost is its
    time with the figures that it needs and ``df`` lacks, less the time of a pass
    over the texts alone; the faster of two runs counts."""
    total = max(1, df.count())
    chance = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 30))
    sample = materialize(df.where(chance < sample_rows / total * (1 << 30)), "quality-sample")
    rows = max(1, sample.count())

    def timed(column: Column, needs: tuple[str, ...] = ()) -> tuple[float, float]:
        own = sample.withColumns({n: FIGURES[n](F.col(text_col)) for n in needs if n not in sample.columns}) if needs else sample
        best, value = float("inf"), 0.0
        for _ in range(2):
            began = time.perf_counter()
            value = own.agg(F.sum(column.cast("long"))).first()[0]
            best = min(best, time.perf_counter() - began)
        return best, value or 0

    idle = timed(F.octet_length(text_col))[0]
    out = []
    for r in rules:
        seconds, rejected = timed(F.coalesce(r.rejects, F.lit(True)), r.needs)
        out.append(Estimate(r, max(1e-3, seconds - idle), rejected / rows))
    return sorted(out, key=lambda e: (-e.gain, e.rule.name))


def cascade(rules: list[Rule], on_text: bool = False) -> Column:
    """The name of the first rule, in the given order, that rejects; null if
    none does.  A CASE evaluates a condition only after all before it failed."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        rejects = r.on_text if on_text and r.on_text is not None else r.rejects
        out = F.when(F.coalesce(rejects, F.lit(True)), F.lit(r.name)).otherwise(out)
    return out


def apply_rules(df: DataFrame, rules: list[Rule], id_col: str = "doc_id", sample_rows: int = 2000, text_col: str = "text") -> DataFrame:
    """``df`` with the figures that it lacks, rejected_by and kept, by the
    rules in their measured order."""
    ordered = [e.rule for e in estimate(df, rules, id_col, sample_rows, text_col)]
    lacking = {n for r in rules for n in r.needs} - set(df.columns)
    out = with_figures(df, text_col) if lacking else df
    return out.withColumn("rejected_by", cascade(ordered)).withColumn("kept", F.col("rejected_by").isNull())


def filter_texts(df: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", sample_rows: int = 2000, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that no rule rejects, figures worked out as far as
    the cascade needs them."""
    ordered = [e.rule for e in estimate(df, default_rules(text_col) if rules is None else rules, id_col, sample_rows, text_col)]
    return df.where(cascade(ordered, on_text=True).isNull())
