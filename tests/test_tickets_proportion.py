import datetime as dt

import pytest
from pyspark.sql import functions as F

from faultline.operators import proportion, tickets

D = dt.date


@pytest.fixture
def releases(spark):
    rows = [("P", f"r{i}", f"1.{i}", D(2020, 1, 1) + dt.timedelta(days=100 * i), i + 1) for i in range(6)]
    return spark.createDataFrame(rows, "project string, release_id string, name string, release_date date, ord int")


def issues(spark, rows):
    return spark.createDataFrame(rows, "project string, ticket_key string, created date, resolved date, "
                                       "affected_names array<string>")


def test_consistency_rules(spark, releases):
    d = lambda n: D(2020, 1, 1) + dt.timedelta(days=n)
    rows = [
        ("P", "P-1", d(50), d(250), ["1.0"]),            # valid, IV = 1.0
        ("P", "P-2", d(50), d(250), []),                 # valid, IV unknown
        ("P", "P-3", d(50), None, []),                   # unresolved
        ("P", "P-4", d(50), d(900), []),                 # FV past the last release
        ("P", "P-5", d(50), d(250), ["1.3"]),            # first AV after OV
        ("P", "P-6", d(50), d(250), ["1.0", "1.3"]),     # FV not after last AV
        ("P", "P-7", d(50), d(250), ["nope", "1.0"]),    # unknown name dropped
    ]
    v = {r["ticket_key"]: r for r in tickets.ticket_versions(issues(spark, rows), releases).collect()}
    assert "P-3" not in v
    assert v["P-1"]["reject_reason"] is None and v["P-1"]["iv_release_id"] == "r0"
    assert v["P-2"]["reject_reason"] is None and v["P-2"]["iv_release_id"] is None
    assert v["P-4"]["reject_reason"] == "no_fixed_version"
    assert v["P-5"]["reject_reason"] == "opening_before_first_affected"
    assert v["P-6"]["reject_reason"] == "fixed_not_after_last_affected"
    assert v["P-7"]["reject_reason"] is None and v["P-7"]["n_av"] == 1


def test_proportion_golden(spark):
    # IV day 0, OV day 100, FV day 200 -> P = 2.0 (fixture of the reference formula).
    base = D(2000, 1, 1)
    day = lambda n: base + dt.timedelta(days=n)
    df = spark.createDataFrame([(day(200), day(100), day(0), "x")],
                               "fv_release_date date, ov_release_date date, iv_release_date date, iv_release_id string")
    assert df.select(proportion.ticket_p().alias("p")).first()["p"] == 2.0
    # OV day 300, FV day 400, P = 2.0 -> IV date = day 200.
    est = spark.createDataFrame([(day(400), day(300))], "fv date, ov date").select(
        F.date_sub("fv", (F.datediff("fv", "ov") * F.lit(2.0)).cast("int")).alias("iv")).first()["iv"]
    assert est == day(200)


def test_cold_start_median_of_others(spark):
    per = spark.createDataFrame([("A", 1, 1, 1.0), ("B", 1, 1, 3.0), ("C", 1, 1, 2.0), ("D", 1, 0, -1.0)],
                                "project string, n_known long, n_computable long, p_mean double")
    out = {r["project"]: r["p_cold"] for r in proportion._median_of_others(per).collect()}
    assert out == {"A": 2.5, "B": 1.5, "C": 2.0, "D": 2.0}
    one = spark.createDataFrame([("A", 1, 1, 1.0)], "project string, n_known long, n_computable long, p_mean double")
    assert proportion._median_of_others(one).first()["p_cold"] == 0.5
