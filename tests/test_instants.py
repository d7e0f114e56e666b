from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.operators.instants import civil_days, month_length, to_instants, usual_epoch, usual_iso

ZONES = [("m1", "Europe/Berlin"), ("m2", "America/Sao_Paulo"), ("bad", "Mars/Base"), (None, "Asia/Tokyo")]


def read(spark, rows):
    df = spark.createDataFrame(rows, "row_id long, text string, machine string, zone_name string, _other int" if len(rows[0]) == 5 else "row_id long, text string, machine string")
    got = to_instants(df, "text", spark.createDataFrame(ZONES, "machine string, zone_name string"))
    return {r["row_id"]: r["utc_ms"] for r in got.collect()}


def ms(*a, zone="UTC"):
    return int(datetime(*a, tzinfo=ZoneInfo(zone)).timestamp() * 1000)


CASES = [
    ("2026-01-31T09:05:07.250Z", None, ms(2026, 1, 31, 9, 5, 7) + 250),
    ("2026-01-31T09:05:07.123456789Z", None, ms(2026, 1, 31, 9, 5, 7) + 123),
    ("2026-01-31 09:05:07 +05:30", None, ms(2026, 1, 31, 3, 35, 7)),
    ("2026-01-31T09:05:07-0300", None, ms(2026, 1, 31, 12, 5, 7)),
    ("20260131T090507Z", None, ms(2026, 1, 31, 9, 5, 7)),
    ("2026-07-01 09:05:07 CEST", None, ms(2026, 7, 1, 7, 5, 7)),
    ("2026-01-31 09:05:07 PST", "m1", ms(2026, 1, 31, 17, 5, 7)),
    ("Fri, 14 Aug 2026 00:48:16 +0200", None, ms(2026, 8, 13, 22, 48, 16)),
    ("31.01.2026 09:05:07", "m1", ms(2026, 1, 31, 8, 5, 7)),
    ("1/31/2026 12:05:07 AM", "m1", ms(2026, 1, 30, 23, 5, 7)),
    ("1/31/2026 12:05:07 PM", "m2", ms(2026, 1, 31, 15, 5, 7)),
    ("2026-03-29T02:30:00", "m1", ms(2026, 3, 29, 1, 30)),  # in the gap: the later clock
    ("2026-10-25T02:30:00", "m1", ms(2026, 10, 25, 0, 30)),  # twice: the first
    ("1733104034", None, 1733104034000),
    ("1733104034015", None, 1733104034015),
    ("1733104034015999", None, 1733104034015),
    ("1733104034015999123", None, 1733104034015),
    ("2026-01-31T09:05:07", None, None),
    ("2026-01-31T09:05:07", "bad", None),
    ("2026-02-29T09:05:07Z", None, None),
    ("2024-02-29T09:05:07Z", None, ms(2024, 2, 29, 9, 5, 7)),
    ("1900-02-29T00:00:00Z", None, None),
    ("2026-04-31T09:05:07Z", None, None),
    ("2026-01-31T24:00:00Z", None, None),
    ("2026-01-31T09:60:07Z", None, None),
    ("13/31/2026 9:05:07 AM", "m1", None),
    ("1/31/2026 13:05:07 AM", "m1", None),
    ("0000-00-00 00:00:00", "m1", None),
    ("2026-01-31 09:05:07 XYZ", "m1", None),
    ("Invalid Date", "m1", None),
    ("undefined", "m1", None),
    ("", "m1", None),
    (None, "m1", None),
    ("\x1f" * 11, "m1", None),
    ("9" * 100_000, "m1", None),
]


def test_formats(spark):
    rows = [(i, t, m) for i, (t, m, _) in enumerate(CASES)]
    got = read(spark, rows)
    assert got == {i: w for i, (_, _, w) in enumerate(CASES)}


def test_extra_columns_ties_and_empty_tables(spark):
    got = read(spark, [(1, "2026-01-31T09:05:07", "m1", "x", 5), (1, "2026-01-31T09:05:07", "m1", "x", 5)])
    assert got == {1: ms(2026, 1, 31, 8, 5, 7)}
    df = spark.createDataFrame([], "text string, machine string")
    assert to_instants(df, "text", spark.createDataFrame([], "machine string, zone_name string")).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.datetimes(datetime(1, 1, 1), datetime(9999, 12, 31)), min_size=50, max_size=200))
def test_day_arithmetic(spark, days):
    df = spark.createDataFrame([(d.year, d.month, d.day, (d.date() - datetime(1970, 1, 1).date()).days) for d in days], "y int, m int, d int, n long")
    assert df.where(civil_days(F.col("y"), F.col("m"), F.col("d")) != F.col("n")).count() == 0


def test_month_lengths(spark):
    import calendar

    rows = [(y, m, calendar.monthrange(y, m)[1]) for y in (1900, 2000, 2023, 2024) for m in range(1, 13)]
    assert spark.createDataFrame(rows, "y int, m int, n int").where(month_length(F.col("y"), F.col("m")) != F.col("n")).count() == 0


def test_usual_forms(spark):
    df = spark.createDataFrame([("2026-01-31T09:05:07.250Z",), ("1733104034015",), (None,)], "t string").select(usual_iso(F.col("t")).alias("a"), usual_epoch(F.col("t")).alias("b"))
    assert [(r.a, r.b) for r in df.collect()] == [(True, False), (False, True), (False, False)]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_against_python(spark, data, sf):
    """All instants of the test table are no later than the delivery of their records."""
    from weftline.plans.instants import p6_instants
    from weftline.sources.tables import table

    c = p6_instants(spark, data).where("src_table = 'claude'").join(table(spark, data, "claude").select("row_id", F.unix_millis(F.col("ingested_at").cast("timestamp")).alias("got")), "row_id")
    assert c.where("utc_ms > got").count() == 0
    assert datetime.now(timezone.utc)
