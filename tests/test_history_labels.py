import datetime as dt

from pyspark.sql import functions as F

from faultline.functions.paths import class_of, fix_file, package_of, touched_file
from faultline.operators import history, labels

D = dt.date


def test_ticket_key_extraction(spark):
    df = spark.createDataFrame([("PROJ", "fix proj-12 and PROJ-13"), ("PROJ", "see OTHER-5"), ("PROJ", "tidy"),
                                ("PROJ", "XPROJ-7 inside")], "project string, message string")
    got = [r[0] for r in df.select(history.ticket_key_in_message()).collect()]
    assert got == ["PROJ-12", None, None, "PROJ-7"]


def test_file_filters(spark):
    paths = ["a/src/test/X.java", "a/test/X.java", "a/X.kt", "a/src/main/X.java", "X.java"]
    df = spark.createDataFrame([(p, "MODIFY") for p in paths], "path string, change_type string")
    rows = df.select("path", fix_file().alias("fix"), touched_file().alias("touched"), package_of().alias("pkg"),
                     class_of().alias("cls")).collect()
    r = {x["path"]: x for x in rows}
    assert [r[p]["fix"] for p in paths] == [False, False, False, True, True]
    assert [r[p]["touched"] for p in paths] == [False, True, False, True, True]
    assert r["X.java"]["pkg"] == "" and r["a/src/main/X.java"]["cls"] == "X"


def test_churn_pairs_and_history_modes(spark):
    touched = spark.createDataFrame([
        ("P", "f.java", "c1", "ann", dt.datetime(2020, 1, 1), 1, 10, 0),
        ("P", "f.java", "c2", "bob", dt.datetime(2020, 2, 1), 1, 4, 2),
        ("P", "f.java", "c3", "ann", dt.datetime(2020, 5, 1), 2, 6, 1),
        ("P", "g.java", "c2", "bob", dt.datetime(2020, 2, 1), 1, 7, 0),
    ], "project string, path string, sha string, author string, committed_at timestamp, ord int, added int, deleted int")
    snaps = spark.createDataFrame([("P", "r1", "f.java", 1), ("P", "r2", "f.java", 2), ("P", "r2", "g.java", 2)],
                                  "project string, release_id string, path string, ord int")
    got = {(r["release_id"], r["path"]): r for r in history.file_churn(touched, snaps).collect()}
    assert (got[("r1", "f.java")]["revisions"], got[("r1", "f.java")]["total_churn"]) == (2, 6)
    f2 = got[("r2", "f.java")]
    assert (f2["revisions"], f2["authors"], f2["total_churn"], f2["max_churn"], f2["avg_churn"]) == (3, 2, 13, 6, 5.0)
    assert got[("r2", "g.java")]["total_churn"] == 0 and got[("r2", "g.java")]["avg_churn"] == 0.0
    leak = {(r["release_id"], r["path"]): r for r in history.file_churn(touched, snaps, history="all").collect()}
    assert leak[("r1", "f.java")]["revisions"] == 3


def test_line_churn_multiset(spark):
    revs = spark.createDataFrame([("f", 1, "a\nb\nc\n"), ("f", 2, "b\na\nd\nd"), ("f", 3, "")],
                                 "path string, rev int, content string")
    got = {r["rev"]: (r["added"], r["deleted"]) for r in history.line_churn(revs).collect()}
    assert got == {2: (2, 1), 3: (1, 4)}


def test_interval_labels(spark):
    snaps = spark.createDataFrame([("P", "r1", D(2020, 1, 1), "f"), ("P", "r2", D(2020, 2, 1), "f"),
                                   ("P", "r3", D(2020, 3, 1), "f"), ("P", "r3", D(2020, 3, 1), "g")],
                                  "project string, release_id string, release_date date, path string")
    iv = spark.createDataFrame([("P", "f", D(2020, 2, 1), D(2020, 3, 1))],
                               "project string, path string, iv_date date, fv_date date")
    got = {(r["release_id"], r["path"]): r["buggy"] for r in labels.label_snapshots(snaps, iv).collect()}
    assert got == {("r1", "f"): False, ("r2", "f"): True, ("r3", "f"): False, ("r3", "g"): False}


def test_links_release_vs_ticket(spark):
    fixing = spark.createDataFrame([("P", "s1", "P-1", "r3")], "project string, sha string, ticket_key string, release_id string")
    tks = spark.createDataFrame([("P", "P-1", "r1", "r3"), ("P", "P-2", "r2", "r3"), ("P", "P-3", "r1", "r4")],
                                "project string, ticket_key string, iv_release_id string, fv_release_id string")
    t = sorted(r["iv_release_id"] for r in labels.injected_links(fixing, tks, "ticket").collect())
    r = sorted(r["iv_release_id"] for r in labels.injected_links(fixing, tks, "release").collect())
    assert t == ["r1"] and r == ["r1", "r2"]
