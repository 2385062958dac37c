import datetime as dt
import random

from faultline.operators.asof import asof_release

D = dt.date


def rel(spark, rows):
    return spark.createDataFrame(rows, "project string, release_id string, release_date date")


def brute(releases, project, day, fallback):
    rs = sorted([r for r in releases if r[0] == project], key=lambda r: (r[2], r[1]))
    if not rs or day is None:
        return None
    for r in rs:
        if day <= r[2]:
            return r[1]
    return max(rs, key=lambda r: (r[2], r[1]))[1] if fallback == "last" else None


def test_asof_matches_brute_force(spark):
    rnd = random.Random(7)
    releases = []
    for p in ("A", "B"):
        day = D(2020, 1, 1)
        for i in range(6):
            day += dt.timedelta(days=rnd.randint(0, 40))
            releases.append((p, f"{p}{i}", day))
    events = [(f"e{i}", rnd.choice("ABC"), D(2019, 12, 1) + dt.timedelta(days=rnd.randint(0, 300))) for i in range(200)]
    events.append(("null_day", "A", None))
    ev = spark.createDataFrame(events, "id string, project string, d date")
    for fb in ("last", None):
        got = {r["id"]: r["release_id"] for r in asof_release(ev, "d", rel(spark, releases), fallback=fb).collect()}
        for i, p, d in events:
            assert got[i] == brute(releases, p, d, fb), (i, p, d, fb)


def test_same_day_first_release_wins(spark):
    r = rel(spark, [("A", "r1", D(2020, 1, 10)), ("A", "r2", D(2020, 1, 10)), ("A", "r3", D(2020, 2, 1))])
    ev = spark.createDataFrame([("x", "A", D(2020, 1, 10)), ("y", "A", D(2020, 1, 1))], "id string, project string, d date")
    got = {r["id"]: r["release_id"] for r in asof_release(ev, "d", r).collect()}
    assert got == {"x": "r1", "y": "r1"}


def test_calendar_size_check_and_large_calendar_path(spark, monkeypatch):
    from faultline.operators import asof
    r = rel(spark, [("A", "r1", D(2020, 1, 10)), ("A", "r2", D(2020, 2, 1)), ("B", "s1", D(2021, 1, 1))])
    assert asof.calendar_rows(asof.last_release(r)) == 23 + 1
    ev = spark.createDataFrame([("x", "A", D(2020, 1, 20)), ("y", "B", D(2019, 1, 1))], "id string, project string, d date")
    monkeypatch.setattr(asof, "CALENDAR_BROADCAST_ROWS", 0)  # take the shuffle-hash path
    got = {row["id"]: row["release_id"] for row in asof.asof_release(ev, "d", r).collect()}
    assert got == {"x": "r2", "y": "s1"}
