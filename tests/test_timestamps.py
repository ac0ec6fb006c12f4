import itertools
import random

from pyspark.sql import functions as F

from quillstrata.functions.instants import AGAINST, ANY_ORDER, is_exact_instant, read_date, read_instant
from quillstrata.operators import timestamps as t


def first(text, zone="UTC", order="dmy", read=read_instant):
    found = sorted(read(text, zone, order), key=lambda r: r[2])
    return found[0][3] if found else None


def test_instants():
    for text, zone, order, wanted in (
        ("2023-03-26 02:30:00", "Europe/Berlin", "dmy", "2023-03-26T01:30:00.000000Z"),  # skipped: the offset before
        ("2023-10-29 02:30:00", "Europe/Berlin", "dmy", "2023-10-29T00:30:00.000000Z"),  # twice: the first
        ("06/04/2024 05:31", "America/New_York", "mdy", "2024-06-04T09:31:00.000000Z"),
        ("06/04/2024 05:31", "UTC", "dmy", "2024-04-06T05:31:00.000000Z"),
        ("31/12/2023 23:12", "UTC", "mdy", "2023-12-31T23:12:00.000000Z"),
        ("1761444896.252", "UTC", "dmy", "2025-10-26T02:14:56.252000Z"),
        ("1672005635974", "UTC", "dmy", "2022-12-25T22:00:35.974000Z"),
        ("2024-W40-1T15:48:01Z", "UTC", "dmy", "2024-09-30T15:48:01.000000Z"),
        ("2024-124T03:22:21Z", "UTC", "dmy", "2024-05-03T03:22:21.000000Z"),
        ("2025-11-25 17:12:41 CET", "UTC", "dmy", "2025-11-25T16:12:41.000000Z"),
        ("2023-11-23T03:27:33.015240917Z", "UTC", "dmy", "2023-11-23T03:27:33.015240Z"),
        ("Tue, 18 Nov 2025 04:17:29 +0100", "UTC", "dmy", "2025-11-18T03:17:29.000000Z"),
        ("Mar 13, 2022 12:22 AM", "UTC", "dmy", "2022-03-13T00:22:00.000000Z"),
        ("2025-01-22", "Asia/Tokyo", "dmy", "2025-01-21T15:00:00.000000Z"),
        (' "2024-08-15T08:18:07Z"\n', "UTC", "dmy", "2024-08-15T08:18:07.000000Z"),
    ):
        assert first(text, zone, order) == wanted, text
    for text in (None, "", "n/a", "25:61", "2023-02-30 08:00:00", "0000-00-00 00:00:00", "2024-06-31T09:15:00+02:00", "yesterday", "x" * 100_000):
        assert read_instant(text, "UTC", "dmy") == [], text


def test_dates():
    for text, wanted in (
        ("März 2013", "2013-03"), ("9 août 1974", "1974-08-09"), ("31 de diciembre de 2014", "2014-12-31"), ("May. 27, 2011", "2011-05-27"), ("20-Jun-14", "2014-06-20"), ("c. 2019", "2019"),
        ("©1972", "1972"), ("[2006]", "2006"), ("1980.", "1980"), ("04/2017", "2017-04"), ("1970-290", "1970-10-17"), ("2018年2月13日", "2018-02-13"), ("03/07/05", "2005-07-03"),
        ("2025-08-05T17:06:00+09:00", "2025-08-05"), ("20220129", "2022-01-29"), ("2021-13", None), ("2023-02-30", None), ("0000", None), ("forthcoming", None), ("in press", None), ("n.d.", None),
    ):
        assert first(text, read=read_date) == wanted, text


def _options(text, *_):
    """Readings written out: 'a3|b5' is style a at time 3 or style b at 5."""
    return [(x[0], int(x[1:]), 0, x) for x in text.split("|")] if text else []


def _cost(path):
    return sum(r[2] for r in path) + sum((a[0] != b[0]) * t.SWITCH + (b[1] < a[1]) * t.BACKWARD for a, b in zip(path, path[1:]))


def test_cheapest_path_over_partitions(spark):
    rng = random.Random(3)
    texts = ["|".join(f"{rng.choice('abc')}{rng.randint(0, 9)}" for _ in range(rng.choice([1, 2, 2, 3]))) for _ in range(9)] + [None]
    best = min(_cost(p) for p in itertools.product(*(_options(x) for x in texts if x)))
    rows = [("g", "s", i, i, x) for i, x in enumerate(texts)] + [("g", "other", 0, 100, "a1")]
    df = spark.createDataFrame(rows, "tbl string, source string, seq long, row_id long, text string")
    for partitions in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = t.chosen_readings(df, F.col("tbl"), F.col("source"), F.col("seq"), F.col("row_id"), F.col("text"), None, {"g": (_options, lambda x: False)}).collect()
        path = [(r.norm[0], int(r.norm[1:]), 0) for r in sorted(found, key=lambda r: r.row_id) if r.row_id < 100]
        assert len(path) == 9 and _cost(path) == best
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_declared_reading_wins(spark):
    df = spark.createDataFrame([("g", None, 1, 1, "05/06/2024 10:00", 1), ("g", "us", 1, 2, "05/06/2024 10:00", 1), ("g", "us", 2, 3, "2024-05-06T10:00:00Z", 1), ("g", "us", 2, 3, None, 1)], "tbl string, source string, seq long, row_id long, text string, norm int")
    found = t.chosen_readings(df, F.col("tbl"), F.col("source"), F.col("seq"), F.col("row_id"), F.col("text"), spark.createDataFrame([("us", "UTC", "mdy"), (None, "Asia/Tokyo", "mdy")], "source string, zone string, date_order string"), {"g": (read_instant, is_exact_instant)}).collect()
    assert sorted((r.row_id, r.norm) for r in found) == [(1, "2024-06-05T10:00:00.000000Z"), (2, "2024-05-06T10:00:00.000000Z")]
    assert AGAINST > 100
    assert t.chosen_readings(df.limit(0), F.col("tbl"), F.col("source"), F.col("seq"), F.col("row_id"), F.col("text"), None, {"g": (read_instant, is_exact_instant)}).count() == 0


def test_path_decides_what_no_declaration_settles(spark):
    """Orders of day and month, years of two digits and zone abbreviations that are left open, against all paths."""
    rng = random.Random(12)
    made = []
    for source, order in (("a", ANY_ORDER), ("b", ANY_ORDER), ("c", "dmy"), ("d", ANY_ORDER)):
        at = 0
        for seq in range(7):
            at += rng.randint(1, 40)
            day, month = 1 + at % 12, 1 + (at // 12) % 12
            text = rng.choice([f"{day:02d}/{month:02d}/2024 10:00", f"{month:02d}-{day:02d}-24 08:00", f"2024-{month:02d}-{day:02d} 10:00 IST", f"2024-{month:02d}-{day:02d}T10:00:00Z", "no time"])
            made.append((source, order, seq, text))
    rows = [("g", s, n, i, x, "clash") for i, (s, _, n, x) in enumerate(made)]
    df = spark.createDataFrame(rows, "tbl string, source string, seq long, row_id long, text string, norm string")
    declared = spark.createDataFrame(sorted({(s, "UTC", o) for s, o, _, _ in made}), "source string, zone string, date_order string")
    args = (df, F.col("tbl"), F.col("source"), F.col("seq"), F.col("row_id"), F.col("text"), declared, {"g": (read_instant, lambda x: False)})
    found = {r.row_id: r.norm for r in t.chosen_readings(*args).collect()}
    several = {r.row_id for r in t.all_readings(*args).where("size(times) > 1").collect()}
    assert len(several) > 8
    decided = 0
    for source in "abcd":
        own = [(i, read_instant(x, "UTC", o)) for i, (s, o, _, x) in enumerate(made) if s == source]
        own = [(i, readings) for i, readings in own if readings]
        best = min(_cost(p) for p in itertools.product(*(r for _, r in own)))
        path = [next(r for r in readings if r[3] == found[i]) for i, readings in own]
        assert _cost(path) == best
        decided += sum(found[i] != readings[0][3] for i, readings in own)
    assert decided > 0  # without the path the reading listed first would stand
