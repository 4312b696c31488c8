from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from turnloom.operators.timestamps import normalise_times

TURNS = "id long, session_id string, timestamp_ms long, timestamp_iso string, ts string, utc_ long"


def ms(*args, zone="UTC"):
    return int(datetime(*args, tzinfo=ZoneInfo(zone)).timestamp() * 1000)


CASES = [
    # (timestamp_ms, timestamp_iso, ts, session, wanted)
    (1709251200000, "2025-01-01T00:00:00Z", None, None, 1709251200000),
    (1709251200, None, None, None, 1709251200000),
    (1709251200123456, None, None, None, 1709251200123),
    (1709251200123999999, None, None, None, 1709251200123),
    (0, "2024-03-01T00:00:00.999999+00:00", None, None, ms(2024, 3, 1) + 999),
    (-1, None, "1709251200.9999", None, 1709251200999),
    (12345, None, None, None, None),
    (None, "unknown", "2024-03-01 05:45:00 +0545", None, ms(2024, 3, 1)),
    (None, "Fri, 01 Mar 2024 00:00:00 GMT", None, None, ms(2024, 3, 1)),
    (None, "01 Mar 2024 02:00:00 +0200", None, None, ms(2024, 3, 1)),
    (None, "Mar 1, 2024 12:05:06 AM", None, None, ms(2024, 3, 1, 0, 5, 6)),
    (None, "Apr 11, 2024 2:06:25 PM EDT", None, None, ms(2024, 4, 11, 18, 6, 25)),
    (None, "20240301T000000Z", None, None, ms(2024, 3, 1)),
    (None, "2024/03/01 00:00:00", None, None, ms(2024, 3, 1)),
    (None, "18/11/2024 03:39:44", None, None, ms(2024, 11, 18, 3, 39, 44)),
    (None, "11/18/2024 03:39:44", None, None, ms(2024, 11, 18, 3, 39, 44)),
    (None, "31/31/2024 03:39:44", None, None, None),
    (None, "2024-02-30T00:00:00Z", "2024-03-01T00:00:00Z", None, ms(2024, 3, 1)),
    (None, "0000-00-00T00:00:00Z", None, None, None),
    (None, "2024-03-01T25:00:00Z", None, None, None),
    (None, "2024-03-01T00:00:61Z", None, None, None),
    (None, "  2024-03-01t00:00:00z ", None, None, ms(2024, 3, 1)),
    (None, "2024-03-01T02:00:00.5+01:00[Asia/Tokyo]", None, None, ms(2024, 3, 1, 1) + 500),
    (None, "2024-03-01T09:00:00[Asia/Tokyo]", None, None, ms(2024, 3, 1)),
    (None, "2024-03-01 09:00:00 Asia/Tokyo", None, "berlin", ms(2024, 3, 1)),
    (None, "2024-03-01 09:00:00 Mars/Base", None, None, None),
    (None, "2024-03-01T00:00:00", None, None, ms(2024, 3, 1)),
    (None, "2024-03-01T01:00:00", None, "berlin", ms(2024, 3, 1)),
    # twice: the earlier instant; never: forward by the gap
    (None, "2024-10-27T02:30:00", None, "berlin", ms(2024, 10, 27, 0, 30)),
    (None, "2024-03-31T02:30:00", None, "berlin", ms(2024, 3, 31, 1, 30)),
    (None, "2024-03-01T00:00:00", None, "odd", ms(2024, 3, 1)),
    (None, "", "yesterday", "berlin", None),
    (None, None, None, None, None),
    (None, "x" * 100_000, "2024-03-01T00:00:00Z", None, ms(2024, 3, 1)),
]


@pytest.fixture
def sessions(spark):
    rows = [("berlin", '{"timezone": "Europe/Berlin"}', 1), ("odd", '{"timezone": "Mars/Base"}', 1), ("cut", '{"timezone": "Eur', 1), ("plain", None, 1), (None, '{"timezone": "Asia/Tokyo"}', 1)]
    return spark.createDataFrame(rows, "session_id string, metadata_json string, utc_ms int")


def test_cases(spark, sessions):
    turns = spark.createDataFrame([(i, s, a, b, c, 7) for i, (a, b, c, s, _) in enumerate(CASES)], TURNS)
    got = dict(normalise_times(turns, sessions).collect())
    assert got == {i: case[-1] for i, case in enumerate(CASES)}


def test_every_hour_of_two_changes(spark, sessions):
    """Wall times over both changes of a year, against zoneinfo."""
    zone = ZoneInfo("Europe/Berlin")
    walls = [datetime(2024, m, d) + timedelta(minutes=30 * k) for m, d in ((3, 30), (10, 26)) for k in range(120)]
    turns = spark.createDataFrame([(i, "berlin", None, w.isoformat(), None, None) for i, w in enumerate(walls)], TURNS)
    wanted = {i: int(w.replace(tzinfo=zone, fold=0).astimezone(timezone.utc).timestamp() * 1000) for i, w in enumerate(walls)}
    assert dict(normalise_times(turns, sessions).collect()) == wanted


def test_empty_and_repeated(spark, sessions):
    empty = spark.createDataFrame([], TURNS)
    assert normalise_times(empty, sessions).count() == 0
    twice = spark.createDataFrame([(1, "s", 1709251200000, None, None, None)] * 2, TURNS)
    assert [tuple(r) for r in normalise_times(twice, sessions.limit(0)).collect()] == [(1, 1709251200000)] * 2
