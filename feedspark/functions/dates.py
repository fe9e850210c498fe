"""Date expressions.

Free-form feed dates are parsed natively, by classes of tokens instead of
layouts: time of day, offset, zone, weekday and comment are cut out, each by
what it looks like, wherever it stands; the year, month and day are told from the
parts that are left by their size and order, as the reference's parser does.  Zone names resolve to UTC, as an
unknown name does there.  Results are TIMESTAMP instants; the original offset is
kept in minutes so that ISO strings can be written with it.  The session time
zone must be UTC (``feedspark.session.ensure_utc``).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedspark.functions.text import PY_WS, let, py_strip

_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_ANY_MONTH = "|".join(_MONTHS)
# The classes, in lower case.  A time of day in full, or an hour with AM/PM.
_TIME = (r"(?<!\d)\d{1,2}(?::\d\d(?::\d\d(?:[.,]\d+)?)?)? ?[ap]\.?m\.?(?![a-z])|(?<!\d)\d{1,2}:\d\d(?::\d\d(?:[.,]\d+)?)?")
# An offset: a plus, or a minus behind a blank, a zone or a clock.
_SHIFT = r"(?:\+|(?<=[\s@]|gmt|utc|z|t\d{4}|t\d{6})-)\d{1,2}(?::?\d\d)?(?![\d/.-])"
# What says nothing about a date: weekdays, fillers, ordinals' endings, and the word behind the time (at '@'), a zone's name.
_SILENT = (r"@[\s,]*(?:(?!" + _ANY_MONTH + r")[a-z]{1,5}(?![a-z]))?|(?<![a-z])(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*"
           r"|(?<![a-z])(?:at|on|of|and|ad)(?![a-z])|(?<=\d)(?:st|nd|rd|th)(?![a-z])|(?<=\d)t(?=\d|\s)|(?<=\d)z(?![a-z])")
_BETWEEN = r"[\s,;./-]+|(?<=\d)(?=[a-z])|(?<=[a-z])(?=\d)"
_EIGHT_DIGITS = r"^(\d{4})(\d\d)(\d\d)(?=(?:\d{4}|\d{6})?(?:-|$))-?"
# One month's name at most, and one to four numbers.
_WHOLE = r"^(?:\d{1,6}(?:-\d{1,6}){0,3}|(?:\d{1,6}-){0,3}(?:" + _ANY_MONTH + r")[a-z]{0,6}(?:-\d{1,6}){0,3})$"
_OFFSET = r":\d\d(?:[.,]\d+)?" + PY_WS + r"*([+-])(\d\d):?(\d\d)$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# D1
def date_token(col) -> Column:
    """Text before the first 'T', else the whole string (compat mode)."""
    s = _c(col)
    return F.when(F.instr(s, "T") > 0, F.split_part(s, F.lit("T"), F.lit(1))).otherwise(s)


def offset_minutes(col) -> Column:
    """Numeric UTC offset at the end of a date string, in minutes; 0 if none."""
    s = py_strip(_c(col))
    sign = F.regexp_extract(s, _OFFSET, 1)
    hh = F.regexp_extract(s, _OFFSET, 2)
    mm = F.regexp_extract(s, _OFFSET, 3)
    mins = hh.cast("int") * 60 + mm.cast("int")
    return F.when(sign == "-", -mins).when(sign == "+", mins).otherwise(F.lit(0))


def _shift(ts: Column, minutes: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) - minutes.cast("long") * F.lit(60_000_000))


def _int(s: Column) -> Column:
    return F.nullif(s, F.lit("")).try_cast("int")


def _cut_time(s: Column) -> Column:
    time = F.regexp_extract(s, _TIME, 0)
    return F.struct(s.alias("s"), time.alias("time"))


def _cut_offset(p: Column) -> Column:
    rest = F.when(p["time"] == "", p["s"]).otherwise(F.replace(p["s"], p["time"], F.lit(" @ ")))
    return F.struct(p["time"].alias("time"), rest.alias("rest"), F.regexp_extract(rest, _SHIFT, 0).alias("shift"))


def _date_parts(p: Column) -> Column:
    """What is left, its parts joined by '-'."""
    rest = F.when(p["shift"] == "", p["rest"]).otherwise(F.replace(p["rest"], p["shift"], F.lit(" ")))
    joined = F.regexp_replace(F.regexp_replace(rest, _SILENT, " "), _BETWEEN, "-")
    joined = F.btrim(F.regexp_replace(F.btrim(joined, F.lit("-")), _EIGHT_DIGITS, "$1-$2-$3-"), F.lit("-"))
    return F.struct(p["time"].alias("time"), p["shift"].alias("shift"), joined.alias("date"))


def _members(p: Column) -> Column:
    """The month's name, the other parts in order, as text and as numbers."""
    name = F.regexp_extract(p["date"], r"[a-z]+", 0)
    n = F.split(F.btrim(F.when(name == "", p["date"]).otherwise(F.regexp_replace(p["date"], r"-?[a-z]+", "")), F.lit("-")), "-")
    return F.struct(p["time"].alias("time"), p["shift"].alias("shift"), (name != "").alias("named"),
                    F.floor(F.instr(F.lit(" ".join(_MONTHS)), F.substring(name, 1, 3)) / 4).cast("int").alias("month"),
                    *[F.coalesce(F.get(n, i), F.lit("")).alias(f"n{i}") for i in range(4)],
                    *[_int(F.coalesce(F.get(n, i), F.lit(""))).alias(f"v{i}") for i in range(3)],
                    (p["date"].rlike(_WHOLE) & (F.size(n) <= F.when(name == "", 4).otherwise(3))).alias("whole"))


def _order(p: Column) -> Column:
    """Year (text), month, day and clock (text).  With a name two numbers are
    left, without one three; a date without a day is its month's first day."""
    named, first_year = p["named"], (F.length(p["n0"]) > 2) | (p["v0"] > 31)
    short = F.when(named, p["n1"] == "").otherwise(p["n2"] == "")
    day_first = p["v0"] > 12
    year = (F.when(named, F.when(short | first_year, p["n0"]).otherwise(p["n1"]))
            .otherwise(F.when(first_year, p["n0"]).when(short, p["n1"]).otherwise(p["n2"])))
    month = F.when(named, p["month"] + 1).when(first_year, p["v1"]).when(short, p["v0"]).when(day_first, p["v1"]).otherwise(p["v0"])
    day = (F.when(short, 1).when(named, F.when(first_year, p["v1"]).otherwise(p["v0"])).when(first_year, p["v2"])
           .when(day_first, p["v0"]).otherwise(p["v1"]))
    clock = F.when(named, p["n2"]).otherwise(p["n3"])
    return F.struct(p["time"].alias("time"), p["shift"].alias("shift"), year.alias("year"), month.alias("month"), day.alias("day"),
                    clock.alias("clock"), short.alias("short"),
                    (p["whole"] & ((clock == "") | ((p["time"] == "") & F.length(clock).isin(2, 4, 6)))).alias("whole"))


def _times(p: Column) -> Column:
    """Numbers of the year, the time of day and the offset."""
    year, long_ = _int(p["year"]), F.length(p["year"])
    full = (F.when(long_ == 4, year).when((long_ > 2) | (p["short"] & (year <= 31)), None)
            .when(year < 69, year + 2000).otherwise(year + 1900))
    hms, timed = F.split(p["time"], ":"), p["time"] != ""
    hour = _int(F.regexp_extract(p["time"], r"^\d+", 0))
    hour = F.when(F.contains(p["time"], F.lit("m")), F.when(hour.between(1, 12), hour % 12 + F.when(F.contains(p["time"], F.lit("p")), 12).otherwise(0))).otherwise(hour)
    zero = lambda c: F.coalesce(c, F.lit(0))
    clock = lambda at: zero(_int(F.substring(p["clock"], at, 2)))
    fraction = F.regexp_extract(p["time"], r":\d\d[.,](\d+)", 1)
    digits = F.replace(F.substring(p["shift"], 2, 5), F.lit(":"), F.lit(""))
    minutes = F.when(F.length(digits) <= 2, _int(digits) * 60).otherwise(
        _int(F.substring(digits, 1, 2)) * 60 + _int(F.substring(digits, 3, 2)))
    return F.struct(
        F.when(p["whole"], full).alias("year"), p["month"].alias("month"), p["day"].alias("day"),
        F.when(timed, hour).otherwise(clock(1)).alias("hh"),
        F.when(timed, zero(_int(F.substring(F.get(hms, 1), 1, 2)))).otherwise(clock(3)).alias("mi"),
        F.when(timed, zero(_int(F.substring(F.get(hms, 2), 1, 2)))).otherwise(clock(5)).alias("sec"),
        F.when(fraction != "", zero(_int(F.rpad(F.substring(fraction, 1, 6), 6, "0")))).otherwise(0).alias("micros"),
        zero(F.when(p["shift"].startswith("-"), -minutes).otherwise(minutes)).alias("off"))


def _resolve(p: Column) -> Column:
    """struct(published_at, offset_min)."""
    wall = F.when((p["hh"] <= 23) & (p["mi"] <= 59) & (p["sec"] <= 59),
                  F.try_make_timestamp(p["year"], p["month"], p["day"], p["hh"], p["mi"], p["sec"].cast("decimal(16,6)"), F.lit("UTC")))
    at_utc = F.timestamp_micros(F.unix_micros(wall) + p["micros"] - p["off"].cast("long") * F.lit(60_000_000))
    return F.struct(at_utc.alias("published_at"), p["off"].alias("offset_min"))


# D2
def parse_published(col) -> Column:
    """Free-form date -> struct(published_at TIMESTAMP, offset_min INT).

    Takes weekdays, comments, times (12 or 24 hours, an hour alone, up to nine
    decimals, cut to microseconds), offsets, zone names, names of months, parts in
    any usual order, eight to fourteen digits, and years with a month only (its
    first day).  No zone, or a zone name, means UTC.  Two-digit years: 69-99 are
    1969-1999, 00-68 are 2000-2068.  Of numbers without a year in front the first
    is the month, unless it exceeds 12.  Unparseable or empty input gives a null
    ``published_at`` (the reference raises; jobs write such rows to the rejects).
    """
    out = F.lower(F.coalesce(py_strip(_c(col)), F.lit("")))
    out = F.when(F.contains(out, F.lit("(")), F.regexp_replace(out, r"\([^()]*\)", " ")).otherwise(out)
    steps = [_cut_time, _cut_offset, _date_parts, _members, _order, _times, _resolve]
    return functools.reduce(let, steps, out)


def local_wall(ts, offset_min) -> Column:
    """Instant + offset: the wall-clock time the string was written in."""
    return _shift(_c(ts), -_c(offset_min))


def format_offset(offset_min, colon: bool = True) -> Column:
    o = _c(offset_min)
    sign = F.when(o < 0, F.lit("-")).otherwise(F.lit("+"))
    a = F.abs(o)
    fmt = "%s%02d:%02d" if colon else "%s%02d%02d"
    return F.format_string(fmt, sign, (a / 60).cast("int"), (a % 60).cast("int"))


# D3
def iso_date(ts, offset_min=None) -> Column:
    """datetime.isoformat() of an aware datetime: microseconds only when
    non-zero, offset as +HH:MM.  Session zone must be UTC."""
    off = F.lit(0) if offset_min is None else _c(offset_min)
    wall = local_wall(ts, off)
    micros = F.unix_micros(wall) % F.lit(1_000_000)
    frac = F.when(micros != 0, F.format_string(".%06d", micros)).otherwise(F.lit(""))
    return F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"), frac, format_offset(off))


# D4
def parse_pub_date(col) -> Column:
    """Strict RFC-822 with a numeric offset ('%a, %d %b %Y %H:%M:%S %z')."""
    s = _c(col)
    local = F.regexp_replace(s, r"^[A-Za-z]{3}, ", "")
    local = F.regexp_replace(local, r" [+-]\d{4}$", "")
    ok = s.rlike(r"^[A-Za-z]{3}, \d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$")
    wall = F.try_to_timestamp(F.concat(local, F.lit(" +0000")), F.lit("d MMM yyyy HH:mm:ss Z"))
    off = offset_minutes(s)
    return F.struct(F.when(ok, _shift(wall, off)).alias("published_at"), off.alias("offset_min"))


# D5
def format_pub_date(ts, offset_min) -> Column:
    """'yyyy-MM-dd HH:mm:ss' in the item's own offset; the offset is lost."""
    return F.date_format(local_wall(ts, offset_min), "yyyy-MM-dd HH:mm:ss")


# D6
def format_rfc822(ts, offset_min) -> Column:
    return F.concat(F.date_format(local_wall(ts, offset_min), "EEE, dd MMM yyyy HH:mm:ss"),
                    F.lit(" "), format_offset(offset_min, colon=False))


# D7
def watermark_ts(col) -> Column:
    """'yyyy-MM-dd' -> midnight UTC of that day."""
    return F.try_to_timestamp(F.concat(_c(col), F.lit(" +0000")), F.lit("yyyy-MM-dd Z"))
