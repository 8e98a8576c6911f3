"""The year of log lines that carry none."""

import random
from datetime import datetime, timedelta

import pytest

from fleetsift.operators import logs


def _written(moment, style):
    if style == 0:
        return f"{moment:%Y-%m-%d %H:%M:%S} x"
    return f"{moment:%b} {moment.day:2d} {moment:%H:%M:%S} host x"


def _files(seed=1):
    """(file, line_no, line, mtime, time) of logs with gaps of days to months, late lines and lines without a time."""
    r = random.Random(seed)
    rows = []
    for f in range(6):
        at, n = datetime(2018 + f, r.randint(1, 12), r.randint(1, 28)), 0
        own = []
        for _ in range(r.randint(1, 60)):
            at += timedelta(days=r.choice([0, 0, 1, 20, 90, 200]), seconds=r.randint(0, 80_000))
            shown = at - timedelta(hours=r.choice([0, 0, 0, 3]))
            n += r.choice([1, 1, 40_000])
            own.append((f"log{f}", n, _written(shown, r.choice([0, 1, 1])), shown))
            if r.random() < 0.2:
                n += 1
                own.append((f"log{f}", n, "no time", None))
        rows += [(*row[:3], at + timedelta(days=r.choice([0, 3])), row[3]) for row in own]
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_years_are_inferred_along_each_file(spark, seed):
    rows = _files(seed)
    frame = spark.createDataFrame([r[:4] for r in rows], "file string, line_no long, line string, mtime timestamp").repartition(5)
    got = {(r.file, r.line_no): r.time for r in logs.with_line_time(frame).collect()}
    assert got == {(r[0], r[1]): r[4].replace(microsecond=0) if r[4] else None for r in rows}
    kept = logs.timeline_range(frame, "2020-11-01 00:00:00", "2021-03-01 00:00:00", files=None).collect()
    assert {(r.file, r.line_no) for r in kept} == {(r[0], r[1]) for r in rows if r[4] and datetime(2020, 11, 1) <= r[4] <= datetime(2021, 3, 1)}


def test_a_classic_line_lies_in_one_year_only(spark):
    frame = spark.createDataFrame([("h", "syslog", 1, "Jan  5 10:00:00 a"), ("h", "syslog", 2, "Feb 29 10:00:00 b"), ("h", "syslog", 3, "Foo 29 10:00:00 c")],
                                  "host string, file string, line_no long, line string")
    for start, end, found in (("2022-12-01", "2023-02-01", [1]), ("2021-12-01", "2022-02-01", []), ("2021-12-01", "2024-03-01", [1])):
        out = logs.timeline_range(frame, start, end, as_of="2023-06-01 00:00:00").collect()
        assert [r.line_no for r in out] == found
    # without an anchor no year is known; 2023 has no 29 February, 2024 has one
    assert [r.time for r in logs.with_line_time(frame, None, ["host", "file"]).collect()] == [None] * 3
    times = logs.with_line_time(frame, "2024-03-01 00:00:00", ["host", "file"]).orderBy("line_no").collect()
    assert [r.time for r in times] == [datetime(2024, 1, 5, 10), datetime(2024, 2, 29, 10), None]
    assert logs.with_line_time(frame.limit(0), "2024-03-01").count() == 0
