from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from cytora.operators import timestamps as ts


def ms(*a, zone="UTC", fold=0, micro=0):
    return int(datetime(*a, tzinfo=ZoneInfo(zone), fold=fold).timestamp() * 1000) + micro


CASES = [
    # text_map, cytometer, keyword, expected
    ({"date": "06/28/2021", "btim": "09:01:58"}, "us", "btim", ms(2021, 6, 28, 9, 1, 58, zone="America/New_York")),
    ({"date": "06/07/2021", "btim": "09:01"}, "de", "btim", ms(2021, 7, 6, 9, 1, zone="Europe/Berlin")),
    ({"date": "26.08.2021", "btim": "13.37.41"}, "de", "btim", ms(2021, 8, 26, 13, 37, 41, zone="Europe/Berlin")),
    ({"date": "12-AOÛT-20", "btim": "2:18:40 AM"}, "de", "btim", ms(2020, 8, 12, 2, 18, 40, zone="Europe/Berlin")),
    ({"date": "22-FÉVR-2022", "btim": "12:17:00:31"}, "de", "btim", ms(2022, 2, 22, 12, 17, 0, zone="Europe/Berlin", micro=516)),
    ({"date": "Oct 27, 2019", "btim": "02:53:44 CEST"}, "us", "btim", ms(2019, 10, 27, 0, 53, 44)),
    ({"date": "20220205", "btim": "171813"}, "us", "btim", ms(2022, 2, 5, 17, 18, 13, zone="America/New_York")),
    ({"date": " 2021-11-25  ", "btim": "00:34:19Z"}, "us", "btim", ms(2021, 11, 25, 0, 34, 19)),
    ({"date": "1 Mai 2021", "btim": "10:53:47-05:30"}, "de", "btim", ms(2021, 5, 1, 16, 23, 47)),
    ({"date": "2019-05-29T05:11:03"}, "us", "btim", ms(2019, 5, 29, 5, 11, 3, zone="America/New_York")),
    # an hour that occurs twice, one that is skipped
    ({"last_modified": "2021-10-31 02:30:00"}, "de", "last_modified", ms(2021, 10, 31, 0, 30)),
    ({"last_modified": "2021-03-28 02:30:00"}, "de", "last_modified", ms(2021, 3, 28, 1, 30)),
    ({"last_modified": "1717814109263"}, "de", "last_modified", 1717814109263),
    ({"last_modified": "1608313873"}, None, "last_modified", 1608313873000),
    ({"last_modified": "2020-01-11T16:54:46.6749912+01:00"}, None, "last_modified", ms(2020, 1, 11, 15, 54, 46, micro=674)),
    ({"last_modified": "Sun, 07 Jul 2024 11:48:49 +0200"}, "us", "last_modified", ms(2024, 7, 7, 9, 48, 49)),
    ({"last_modified": "2021-01-26 16:53:20 Asia/Kolkata"}, "us", "last_modified", ms(2021, 1, 26, 11, 23, 20)),
    ({"last_modified": "20240703T114105"}, "us", "last_modified", ms(2024, 7, 3, 11, 41, 5, zone="America/New_York")),
    ({"last_modified": "01/18/2020 12:26:47 AM"}, "us", "last_modified", ms(2020, 1, 18, 0, 26, 47, zone="America/New_York")),
    # no cases
    ({"date": "2021-02-29", "btim": "10:00:00"}, "us", "btim", None),
    ({"date": "2021-02-28", "btim": "25:61:00"}, "us", "btim", None),
    ({"date": "2021-02-28", "btim": "12:00:00:60"}, "us", "btim", None),
    ({"date": "2021-02-28", "btim": "13:00:00 PM"}, "us", "btim", None),
    ({"date": "00-XXX-0000", "btim": "10:00:00"}, "us", "btim", None),
    ({"date": "2021-02-28"}, "us", "btim", None),
    ({"btim": "10:00:00"}, "us", "btim", None),
    ({"last_modified": "never"}, "us", "last_modified", None),
    ({"last_modified": ""}, "us", "last_modified", None),
    ({"last_modified": "x" * 100_000}, "us", "last_modified", None),
    ({"last_modified": "2021-02-28 10:00:00 Mars/Base"}, "us", "last_modified", None),
    ({"last_modified": "2021-02-28 10:00:00"}, None, "last_modified", None),
    ({"date": None, "btim": None}, "us", "btim", None),
    (None, "us", "btim", None),
]


@pytest.fixture(scope="module")
def tables(spark):
    schema = "text_id long, cytometer string, text_map map<string,string>, utc_ms string, keyword string"
    rows = [(i, c, t, "clash", "clash") for i, (t, c, _, _) in enumerate(CASES)]
    inst = spark.createDataFrame([("us", "America/New_York", "en-US"), ("de", "Europe/Berlin", "de-DE"), (None, "UTC", "en-GB")], "cytometer string, iana_zone string, site_locale string")
    return spark.createDataFrame(rows + rows[:3], schema), inst


def test_cases(tables):
    got = {(r["text_id"], r["keyword"]): r["utc_ms"] for r in ts.file_instants(*tables).collect()}
    for i, (text, _, key, want) in enumerate(CASES):
        assert got.get((i, key)) == want, text


def test_repeats_count_once(tables):
    rows = ts.file_instants(*tables).collect()
    assert len(rows) == len(set(rows))


def test_empty(tables):
    texts, inst = tables
    assert ts.file_instants(texts.limit(0), inst).count() == 0
    assert ts.file_instants(texts.limit(1), inst.limit(0)).count() == 0


def test_day_arithmetic_matches_calendar(spark):
    days = spark.range(0, 60000, 37).select((F.col("id") - 25567).cast("int").alias("n"))
    parts = days.select("n", F.date_add(F.lit("1970-01-01").cast("date"), F.col("n")).alias("d"))
    bad = parts.filter(ts.epoch_day(F.year("d"), F.month("d"), F.dayofmonth("d")) != F.col("n"))
    assert bad.count() == 0


def test_zones_agree_with_zoneinfo(spark):
    start = datetime(2021, 1, 1)
    walls = [(start + timedelta(hours=h * 7 + 1, minutes=30)) for h in range(1300)]
    df = spark.createDataFrame([(i, (w - datetime(1970, 1, 1)).total_seconds() * 1000) for i, w in enumerate(walls)], "i long, local double")
    day, clock = F.floor(F.col("local") / 86400000), (F.col("local") % 86400000).cast("long")
    for zone in ("America/New_York", "Australia/Sydney", "Europe/Madrid"):
        got = df.select("i", ts.to_utc_ms(day, clock, F.lit(False), F.lit(0), F.lit(zone)).alias("u")).collect()
        for r in got:
            want = walls[r["i"]].replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(timezone.utc)
            assert r["u"] == int(want.timestamp() * 1000), (zone, walls[r["i"]])
