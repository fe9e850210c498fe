"""Date parsing: literal expected values for every layout."""

import pytest
from pyspark.sql import functions as F

from feedspark.functions import dates as D
from feedspark.operators.collect import dated_entries

# raw date, ISO date, instant in UTC
CASES = [
    ("Mon, 01 Jan 2024 10:00:00 +0000", "2024-01-01T10:00:00+00:00", "2024-01-01 10:00:00"),
    ("Tue, 02 Jan 2024 10:00:00 GMT", "2024-01-02T10:00:00+00:00", "2024-01-02 10:00:00"),
    ("Wed, 03 Jan 2024 10:00:00 EDT", "2024-01-03T10:00:00+00:00", "2024-01-03 10:00:00"),
    ("Fri, 5 Jan 2024 10:00:00 +0200", "2024-01-05T10:00:00+02:00", "2024-01-05 08:00:00"),
    ("Sat, 06 Jan 2024 23:59:59 -0400", "2024-01-06T23:59:59-04:00", "2024-01-07 03:59:59"),
    ("2024-01-05T10:00:00+05:30", "2024-01-05T10:00:00+05:30", "2024-01-05 04:30:00"),
    ("2024-01-05T10:00:00+02", "2024-01-05T10:00:00+02:00", "2024-01-05 08:00:00"),
    ("2024-01-05T10:00:00Z", "2024-01-05T10:00:00+00:00", "2024-01-05 10:00:00"),
    ("2024-01-05T10:00:00.250000Z", "2024-01-05T10:00:00.250000+00:00", "2024-01-05 10:00:00.25"),
    ("2024-01-05T10:00:00.123456789Z", "2024-01-05T10:00:00.123456+00:00", "2024-01-05 10:00:00.123456"),
    ("2024-01-06", "2024-01-06T00:00:00+00:00", "2024-01-06 00:00:00"),
    ("2024-1-5", "2024-01-05T00:00:00+00:00", "2024-01-05 00:00:00"),
    ("2024/01/05 10:00", "2024-01-05T10:00:00+00:00", "2024-01-05 10:00:00"),
    ("20240115", "2024-01-15T00:00:00+00:00", "2024-01-15 00:00:00"),
    ("20240115T101112", "2024-01-15T10:11:12+00:00", "2024-01-15 10:11:12"),
    ("15 Jan 2024 03:04 PM", "2024-01-15T15:04:00+00:00", "2024-01-15 15:04:00"),
    ("2024-01-15 03:04:05 PM", "2024-01-15T15:04:05+00:00", "2024-01-15 15:04:05"),
    ("12 Jan 2024 12:30 am", "2024-01-12T00:30:00+00:00", "2024-01-12 00:30:00"),
    ("Mon, 15 Jan 24 10:00:00 GMT", "2024-01-15T10:00:00+00:00", "2024-01-15 10:00:00"),
    ("15 Jan 2024 3:04:05", "2024-01-15T03:04:05+00:00", "2024-01-15 03:04:05"),
    ("15 Sept 2024", "2024-09-15T00:00:00+00:00", "2024-09-15 00:00:00"),
    ("Mon Jan 15 10:11:12 2024", "2024-01-15T10:11:12+00:00", "2024-01-15 10:11:12"),
    ("Sat Jan 06 10:00:00 +0000 2024", "2024-01-06T10:00:00+00:00", "2024-01-06 10:00:00"),
    ("Monday, 15-Jan-24 10:11:12 GMT", "2024-01-15T10:11:12+00:00", "2024-01-15 10:11:12"),
    ("Mon, 15 Jan 2024 10:00:00 GMT+0200", "2024-01-15T10:00:00+02:00", "2024-01-15 08:00:00"),
    ("01/15/2024", "2024-01-15T00:00:00+00:00", "2024-01-15 00:00:00"),
    ("15-01-2024", "2024-01-15T00:00:00+00:00", "2024-01-15 00:00:00"),
    ("January 5, 2024", "2024-01-05T00:00:00+00:00", "2024-01-05 00:00:00"),
    ("Mon, 15 Jan 2024 10:00:00 -0500 (EST)", "2024-01-15T10:00:00-05:00", "2024-01-15 15:00:00"),
    ("Mon, 15 Jan 2024 10:00:00 (UTC)", "2024-01-15T10:00:00+00:00", "2024-01-15 10:00:00"),
    ("3pm Jan 15 2024", "2024-01-15T15:00:00+00:00", "2024-01-15 15:00:00"),
    ("15 Jan 2024 3 p.m.", "2024-01-15T15:00:00+00:00", "2024-01-15 15:00:00"),
    ("2024-01-15 10", "2024-01-15T10:00:00+00:00", "2024-01-15 10:00:00"),
    ("2024-01-15T1000Z", "2024-01-15T10:00:00+00:00", "2024-01-15 10:00:00"),
    ("2024-01-15T100005+0530", "2024-01-15T10:00:05+05:30", "2024-01-15 04:30:05"),
    ("20240115T1011", "2024-01-15T10:11:00+00:00", "2024-01-15 10:11:00"),
    ("20240115101112", "2024-01-15T10:11:12+00:00", "2024-01-15 10:11:12"),
    ("Jan 2024", "2024-01-01T00:00:00+00:00", "2024-01-01 00:00:00"),
    ("2024-01", "2024-01-01T00:00:00+00:00", "2024-01-01 00:00:00"),
    ("01/2024", "2024-01-01T00:00:00+00:00", "2024-01-01 00:00:00"),
    ("2024 March 7", "2024-03-07T00:00:00+00:00", "2024-03-07 00:00:00"),
    ("7th of March 2024 at 6:05 am", "2024-03-07T06:05:00+00:00", "2024-03-07 06:05:00"),
    ("Mar-07-2024", "2024-03-07T00:00:00+00:00", "2024-03-07 00:00:00"),
    ("07.03.2024 18:30", "2024-07-03T18:30:00+00:00", "2024-07-03 18:30:00"),
    ("27.03.2024 18:30", "2024-03-27T18:30:00+00:00", "2024-03-27 18:30:00"),
    ("01/15/24", "2024-01-15T00:00:00+00:00", "2024-01-15 00:00:00"),
    ("5 Jan 99", "1999-01-05T00:00:00+00:00", "1999-01-05 00:00:00"),
    ("2024-02-29T00:00:00.5+14:00", "2024-02-29T00:00:00.500000+14:00", "2024-02-28 10:00:00.5"),
    ("2024-01-15 10:00:00 UTC+2", "2024-01-15T10:00:00+02:00", "2024-01-15 08:00:00"),
]
NO_DATES = ["not a date", "Mon (Monday), 15 Jan 2024 10:00 (noon (almost)", "31 Feb 2024", "2024-01-05 25:00:00", "10:00", "2024-01-05 10:00 11:00", "Jan 15", "15", "13 pm Jan 15 2024",
            "2023-02-29", "2024-13-01", "soon 2024-01-15", "2024-01-15 10:00 1011", "1 2 3 4 5", "100 Jan 2024", "2024-01-15 # 3", "Jan Feb 2024 1", "12:00 12"]


def _entries(spark, values):
    rows = [(i, "f", f"l{i}", "t", "d", v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "entry_id long, feed_url string, link string, title string, "
                                       "description string, published string")


def test_every_layout(spark):
    got = {r.entry_id: r for r in dated_entries(_entries(spark, [c[0] for c in CASES])).select(
        "entry_id", "date_published", F.col("published_at").cast("string").alias("at")).collect()}
    wrong = [(raw, got[i].date_published, got[i].at) for i, (raw, iso, instant) in enumerate(CASES) if (got[i].date_published, got[i].at) != (iso, instant)]
    assert not wrong


def test_no_dates(spark):
    assert [r.date_token for r in dated_entries(_entries(spark, NO_DATES)).collect() if r.published_at is not None] == []


def test_compat_mode_cuts_at_T(spark):
    """The cut leaves nothing of dates that begin with T, and no time of ISO dates."""
    raw = ["Mon, 01 Jan 2024 10:00:00 +0000", "Tue, 02 Jan 2024 10:00:00 GMT", "Thu, 04 Jan 2024 10:00:00 UTC",
           "Wed, 03 Jan 2024 10:00:00 GMT", "2024-01-05T10:00:00+05:30"]
    got = {r.entry_id: r.date_published for r in dated_entries(_entries(spark, raw), compat=True).collect()}
    assert got == {0: "2024-01-01T10:00:00+00:00", 3: "2024-01-03T10:00:00+00:00", 4: "2024-01-05T00:00:00+00:00"}


def test_garbage_and_empty(spark):
    got = {r.entry_id: r for r in dated_entries(_entries(spark, ["not a date", "", None])).collect()}
    assert got[0].published_at is None          # routed to rejects
    assert 1 not in got and 2 not in got        # F1 drops empty tokens


def test_watermark_is_strict(spark):
    from feedspark.operators.collect import since_watermark
    vals = ["2024-01-15T00:00:00Z", "2024-01-15T00:00:01Z", "2024-01-15"]
    e = dated_entries(_entries(spark, vals))
    kept = {r.entry_id for r in since_watermark(e, F.lit("2024-01-15")).collect()}
    assert kept == {1}


@pytest.mark.parametrize("s,wall,off", [("Mon, 01 Jan 2024 10:00:00 -0500", "2024-01-01 10:00:00", -300),
                                        ("Mon, 01 Jan 2024 10:00:00 +0000", "2024-01-01 10:00:00", 0)])
def test_pub_date(spark, s, wall, off):
    df = spark.createDataFrame([(s,)], "p string")
    p = D.parse_pub_date(F.col("p"))
    r = df.select(D.format_pub_date(p["published_at"], p["offset_min"]).alias("w"),
                  D.format_rfc822(p["published_at"], p["offset_min"]).alias("r"), p["offset_min"].alias("o")).first()
    assert (r.w, r.o) == (wall, off)
    assert r.r == s
