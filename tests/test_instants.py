import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from darkroom.operators.instants import estimate_offsets, known_around, recovery, resolve_instants

UTC = dt.timezone.utc
SCHEMA = "id string, text string, off int, zone string, extra string"


def ms(*a, sub=0):
    return int(dt.datetime(*a, tzinfo=UTC).timestamp()) * 1000 + sub


CASES = [
    # text, offset, zone, expected
    ("2016:02:06 01:21:29", 60, None, ms(2016, 2, 6, 0, 21, 29)),
    ("2016-02-06T01:21:29.987654", None, "Europe/Berlin", ms(2016, 2, 6, 0, 21, 29, sub=987)),
    ("2016-02-06T01:21:29,9", None, "europe/berlin", ms(2016, 2, 6, 0, 21, 29, sub=900)),
    ("2018-12-21T09:45", 0, None, ms(2018, 12, 21, 9, 45)),
    ("02.04.2015 22:48:23", 120, None, ms(2015, 4, 2, 20, 48, 23)),
    ("9/30/2018 2:59:57 AM", 0, None, ms(2018, 9, 30, 2, 59, 57)),
    ("9/30/2018 12:59:57 PM", 0, None, ms(2018, 9, 30, 12, 59, 57)),
    ("9/30/2018 12:00:00 AM", 0, None, ms(2018, 9, 30)),
    ("Nov 10, 2017 3:12:59 pm +02:00", -300, None, ms(2017, 11, 10, 13, 12, 59)),
    ("Mon, 27 Mar 2017 22:10:14 GMT-5", None, None, ms(2017, 3, 28, 3, 10, 14)),
    ("23 août 2018 à 13:09:12", 120, None, ms(2018, 8, 23, 11, 9, 12)),
    ("18. März 2018, 20:14:01 CET", None, None, ms(2018, 3, 18, 19, 14, 1)),
    ("20171004180913", 0, None, ms(2017, 10, 4, 18, 9, 13)),
    ("20131122_062253", 0, None, ms(2013, 11, 22, 6, 22, 53)),
    ("20130907T084801Z", 500, "Asia/Tokyo", ms(2013, 9, 7, 8, 48, 1)),
    ("1300545578.901", None, None, 1300545578901),
    ("1537551252346", None, None, 1537551252346),
    ("１ septembre ２０１２ à ０６:１６:５６", 0, None, ms(2012, 9, 1, 6, 16, 56)),
    ("2014:10:23 13:05:23−07", None, None, ms(2014, 10, 23, 20, 5, 23)),
    ('"2012:09:27 17:41:38"', 0, None, ms(2012, 9, 27, 17, 41, 38)),
    ("2015-09-11 20:55:16 America/New_York", None, None, ms(2015, 9, 12, 0, 55, 16)),
    ("2011-01-24T01:51:03+00:00[Europe/London]", None, None, ms(2011, 1, 24, 1, 51, 3)),
    ("1957-06-14 06:27:00.25", 0, None, ms(1957, 6, 14, 6, 27, 0, sub=250)),
    # an impossible offset is no evidence, the zone is
    ("2016-07-01 12:00", 9999, "Asia/Tokyo", ms(2016, 7, 1, 3, 0)),
    # twice, skipped, settled by an offset
    ("2017-10-29 02:30:00", None, "Europe/Berlin", None),
    ("2017-03-26 02:30:00", None, "Europe/Berlin", None),
    ("2017-10-29 02:30:00", 60, "Europe/Berlin", ms(2017, 10, 29, 1, 30)),
    ("2017-10-29 02:30:00 Europe/Berlin", 120, None, ms(2017, 10, 29, 0, 30)),
    ("2017-10-29 03:00:00", None, "Europe/Berlin", ms(2017, 10, 29, 2, 0)),
    # nothing to go by
    ("2016-02-06 01:21:29", None, None, None),
    ("2016-02-06 01:21:29", None, "Mars/Base", None),
    ("1999", 0, None, None),
    ("2013-07-04", 0, None, None),
    ("0000:00:00 00:00:00", 0, None, None),
    ("2014-06-31 25:61:00", 0, None, None),
    ("31.02.2014 10:00", 0, None, None),
    ("2100-02-29 10:00", 0, None, None),
    ("unknown", 0, None, None),
    ("", 0, None, None),
    (None, 0, "UTC", None),
    ("x" * 100_000, 0, None, None),
]


def test_texts(spark):
    rows = [(str(i), c[0], c[1], c[2], "x") for i, c in enumerate(CASES)]
    out = {r["id"]: r["utc_ms"] for r in resolve_instants(spark.createDataFrame(rows, SCHEMA), "id", "text", "off", "zone").collect()}
    for i, c in enumerate(CASES):
        assert out[str(i)] == c[3], c


def test_empty_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert resolve_instants(empty, "id", "text", "off", "zone").count() == 0
    odd = spark.createDataFrame([("a", "2016:02:06 01:21:29", 0, None, "p", 1)], "key string, text string, off int, zone string, parsed string, local_s int")
    assert resolve_instants(odd, "key", "text", "off", "zone").collect()[0]["utc_ms"] == ms(2016, 2, 6, 1, 21, 29)


def test_session_zone_does_not_matter(spark):
    rows = spark.createDataFrame([("a", "2016-07-01 12:00", None, "Asia/Tokyo", "")], SCHEMA)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert resolve_instants(rows, "id", "text", "off", "zone").collect()[0]["utc_ms"] == ms(2016, 7, 1, 3, 0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_offset_history_of_a_camera(spark):
    """A camera at +60 that moves to -300: known instants bracket the unknown ones."""
    rows, start = [], int(dt.datetime(2020, 1, 1, tzinfo=UTC).timestamp())
    for day in range(10):
        off = 60 if day < 5 else -300
        for hour in range(0, 24, 2):
            true = start + day * 86400 + hour * 3600
            rows.append(("cam", true + 60, true + off * 60, true if hour % 4 == 0 else None))
    df = spark.createDataFrame(rows, "cam string, seen long, local_s long, known_s long").withColumn("seen", F.timestamp_seconds("seen"))
    out = {r["segment"] - start // 86400: r["offset_min"] for r in estimate_offsets(df, "cam", "seen", 86400).collect()}
    assert [out[d] for d in range(10)] == [60] * 5 + [-300] * 5


@pytest.mark.parametrize("schema", ["cam string, seen timestamp, local_s long, known_s long"])
def test_no_rows_no_history(spark, schema):
    assert estimate_offsets(spark.createDataFrame([], schema), "cam", "seen", 86400).count() == 0


def test_offsets_of_a_quarter_hour_come_back(spark):
    rows, start = [], int(dt.datetime(2021, 3, 1, tzinfo=UTC).timestamp())
    for cam, off in (("a", 345), ("b", -570), ("c", 765)):
        rows += [(cam, f"{cam}{i}", start + i * 600 + 5, start + i * 600 + off * 60, start + i * 600) for i in range(400)]
    df = spark.createDataFrame(rows, "cam string, row string, seen long, local_s long, known_s long").withColumn("seen", F.timestamp_seconds("seen"))
    r = recovery(df, "cam", "seen", 86400, "row").collect()[0]
    assert r["hidden"] > 60 and r["right"] == r["hidden"] == r["estimated"] == r["within_hour"]


def test_order_alone_tells_the_offset(spark):
    """Rows without an offset lie between known ones, so only offsets near the true one keep the order."""
    rows, start = [], int(dt.datetime(2021, 3, 1, tzinfo=UTC).timestamp())
    for i in range(2000):
        true = start + i * 120
        rows.append(("cam", true + 1, true + 7200, true if i % 20 == 0 else None))
    df = spark.createDataFrame(rows, "cam string, seen long, local_s long, known_s long").withColumn("seen", F.timestamp_seconds("seen"))
    assert {r["offset_min"] for r in estimate_offsets(df, "cam", "seen", 86400).collect()} == {120}


def camera(spark, rows):
    df = spark.createDataFrame(rows, "cam string, seen long, local_s long, known_s long")
    return df.withColumn("seen", F.timestamp_seconds("seen"))


def test_order_tells_the_offset_however_close_rows_come_in(spark):
    """A clock at -300 among instants of a UTC clock, all come in within seven minutes of a segment of 64 days."""
    rows, start = [], int(dt.datetime(2021, 3, 1, tzinfo=UTC).timestamp())
    for i in range(400):
        true = start + i * 600
        rows.append(("cam", start + 3 * 10**6 + i, true - 300 * 60 if i % 10 else true, None if i % 10 else true))
    assert [r["offset_min"] for r in estimate_offsets(camera(spark, rows), "cam", "seen", 64 * 86400).collect()] == [-300]


def test_order_holds_across_segments(spark):
    """Hours with instants around an hour without any."""
    rows, start = [], int(dt.datetime(2021, 3, 1, tzinfo=UTC).timestamp())
    for i in range(180):
        true = start + i * 60
        inside = 60 <= i < 120
        rows.append(("cam", true, true - 300 * 60 if inside else true, None if inside else true))
    out = {(r["segment"] - start // 3600): r["offset_min"] for r in estimate_offsets(camera(spark, rows), "cam", "seen", 3600).collect()}
    assert out == {0: 0, 1: -300, 2: 0}


def test_known_instants_around_rows(spark, staging):
    """Against a plain search, with ranges that cut through a source of most rows and through rows of one time."""
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "a", "b", "c", "d"]), rng.choice([7, rng.randrange(300)]), rng.randrange(50), rng.choice([None, None, rng.randrange(900)])) for _ in range(1500)]
    rows += [("all unknown", t, 1, None) for t in range(20)] + [("all known", t, 1, t) for t in range(20)]
    out = known_around(spark.createDataFrame(rows, "source string, at long, local_s long, known_s long"), staging).collect()
    expected = {}
    for source, at, local, known in rows:
        if known is None:
            earlier = [(t, k) for s, t, _, k in rows if s == source and k is not None and t < at]
            later = [(t, k) for s, t, _, k in rows if s == source and k is not None and t > at]
            n = expected.get((source, at, local), (0,))[0]
            expected[source, at, local] = (n + 1, max(earlier)[1] if earlier else None, min(later)[1] if later else None)
    assert {(r["source"], r["at"], r["local_s"]): (r["n"], r["before"], r["after"]) for r in out} == expected and len(out) == len(expected)
