import json
import os

import pytest
from pyspark.sql import functions as F

from faultline.operators import dataset
from faultline.sources import landed, results_store


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_release_and_issue_json(spark, tmpdir_path):
    write(f"{tmpdir_path}/rel/STORM.json", json.dumps({"versions": [
        {"id": "1", "name": "1.0", "releaseDate": "2020-01-01"}, {"id": "2", "name": "1.1"},
        {"id": "3", "name": "1.2", "releaseDate": "2020-03-01"}]}))
    r = landed.read_releases(spark, f"{tmpdir_path}/rel").collect()
    assert sorted(x["name"] for x in r) == ["1.0", "1.2"] and {x["project"] for x in r} == {"STORM"}
    page = {"total": 3, "issues": [
        {"key": "STORM-1", "fields": {"created": "2020-01-05T10:00:00.000+0000",
                                      "resolutiondate": "2020-02-01T00:00:00.000+0000", "versions": [{"name": "1.0"}]}},
        {"key": "STORM-2", "fields": {"created": "2020-01-05T10:00:00.000+0000", "resolutiondate": "",
                                      "versions": []}},
        {"key": "STORM-3", "fields": {"created": "2020-01-05T10:00:00.000+0000",
                                      "resolutiondate": "2020-02-01T00:00:00.000+0000"}}]}
    write(f"{tmpdir_path}/iss/STORM_0.json", json.dumps(page))
    write(f"{tmpdir_path}/iss/STORM_1.json", json.dumps(page))  # overlapping page
    write(f"{tmpdir_path}/iss/bad.json", "{not json")
    issues, corrupt = landed.read_issue_pages(spark, f"{tmpdir_path}/iss")
    got = {x["ticket_key"]: x for x in issues.collect()}
    assert set(got) == {"STORM-1", "STORM-2"}
    assert got["STORM-2"]["resolved"] is None and got["STORM-1"]["affected_names"] == ["1.0"]
    assert corrupt.count() == 1


def test_violation_xml(spark, tmpdir_path):
    write(f"{tmpdir_path}/pmd/STORM/1.2.xml", """<?xml version="1.0"?>
<pmd><file name="A.java"><violation beginline="3" class="A" method="run" rule="GodClass">x</violation>
<violation beginline="9" class="A" method="stop" rule="Long">y</violation></file></pmd>""")
    v = landed.read_violations(spark, f"{tmpdir_path}/pmd/*").collect()
    assert {(x["project"], x["release_name"], x["class"], x["method"], x["beginline"]) for x in v} == {
        ("STORM", "1.2", "A", "run", 3), ("STORM", "1.2", "A", "stop", 9)}


def test_csv_round_trip_and_refusal(spark, tmpdir_path):
    row = ("S", "4.10", "A/m(int, String)", 3, 1, 2, 1, 1, 4, 2, 10, 5, 2.5, 0, "yes")
    df = spark.createDataFrame([row], dataset.DATASET_SCHEMA)
    dataset.write_dataset_csv(df, f"{tmpdir_path}/ds")
    back = dataset.read_dataset_csv(spark, f"{tmpdir_path}/ds").first()
    assert back["Release"] == "4.10" and back["MethodName"] == "A/m(int, String)" and back["AvgChurn"] == 2.5
    write(f"{tmpdir_path}/norel/x.csv", "A,B\n1,2\n")
    with pytest.raises(ValueError):
        dataset.read_dataset_csv(spark, f"{tmpdir_path}/norel")
    write(f"{tmpdir_path}/ref/x.csv", "S,S,\"A/m(a, b)\",4,2,1,0,0,0,0,0,0,0.00,0,no\nshort,row\n")
    r = landed.read_refactored_csv(spark, f"{tmpdir_path}/ref").collect()
    assert len(r) == 1 and r[0]["LOC"] == 4.0 and r[0]["NumberOfCodeSmells"] == 0.0
    write(f"{tmpdir_path}/folds/r.csv", "Model , Precision,AUC \nRF,0.5,0.7\n")
    f = landed.read_fold_results(spark, f"{tmpdir_path}/folds")
    assert f.columns == ["Model", "Precision", "AUC"]


def test_results_json_and_store(spark, tmpdir_path):
    write(f"{tmpdir_path}/res/S.json", json.dumps([{"project": "S", "classifierName": "RF", "avgAuc": 0.9,
                                                    "unknownKey": 1, "numberOfRuns": 10}]))
    res, corrupt = landed.read_results(spark, f"{tmpdir_path}/res")
    assert res.first()["avgAuc"] == 0.9 and corrupt.count() == 0
    old = spark.createDataFrame([("S", "RF", 1, 0.8), ("S", "NB", 1, 0.7)], "project string, classifier string, run_ts int, auc double")
    new = spark.createDataFrame([("S", "RF", 2, 0.9)], "project string, classifier string, run_ts int, auc double")
    store = f"{tmpdir_path}/store"
    results_store.save(old, store)
    results_store.append(spark, store, new)
    got = {(r["classifier"], r["run_ts"]) for r in results_store.load(spark, store).collect()}
    assert got == {("RF", 2), ("NB", 1)}


def test_projects_snapshots_columns_and_sinks(spark, tmpdir_path):
    from faultline.functions import columns
    from faultline.sources import sinks

    write(f"{tmpdir_path}/cfg/config.json", json.dumps({"STORM": "https://x/storm.git", "BOOKKEEPER": "https://x/bk.git"}))
    p = {r["project"]: r["url"] for r in landed.read_projects(spark, f"{tmpdir_path}/cfg").collect()}
    assert p == {"STORM": "https://x/storm.git", "BOOKKEEPER": "https://x/bk.git"}
    df = spark.createDataFrame([(" 'LOC' ", "YES"), ("x", "no")], ["a", "b"]).toDF(" \"LOC\" ", "Bugginess")
    c = columns.clean_columns(df)
    assert c.columns == ["LOC", "Bugginess"] and columns.find_column(c, "loc") == "LOC"
    assert [r[0] for r in c.select(columns.label_to_int("Bugginess")).collect()] == [1, 0]
    rk = spark.createDataFrame([(1, "LOC", 0.5, True)], "rank int, feature string, spearman_rho double, actionable boolean")
    sinks.write_feature_ranking(rk, f"{tmpdir_path}/rank")
    back = spark.read.option("header", True).csv(f"{tmpdir_path}/rank").collect()
    assert back[0]["Feature"] == "LOC" and back[0]["Rank"] == "1"


def test_dataset_column_operations(spark):
    from faultline.functions import columns
    from faultline.operators import models

    df = spark.createDataFrame([("S", "1.0", "m", "3", "x", "yes"), ("S", "1.0", "m", "3", "x", "yes")],
                               "ProjectName string, Release string, MethodName string, LOC string, Note string, "
                               "Bugginess string")
    c = dataset.coerce_numeric(df, ["LOC", "Note"])
    assert c.first()["LOC"] == 3.0 and c.first()["Note"] == 0.0
    f = columns.features_and_label(c.drop("Note"))
    assert f.columns == ["LOC", "Bugginess"]
    assert columns.drop_string_columns(c, keep=("Bugginess",)).columns == ["LOC", "Note", "Bugginess"]
    assert columns.distinct_rows(df).count() == 1
    a = models.align_columns(c, ["LOC", "Revisions"])
    assert a.columns == ["LOC", "Revisions"] and a.first()["Revisions"] is None


def test_project_case_is_the_same_everywhere(spark, tmpdir_path):
    write(f"{tmpdir_path}/rel/storm.json", json.dumps({"versions": [{"id": "1", "name": "1.0", "releaseDate": "2020-01-01"}]}))
    write(f"{tmpdir_path}/pmd/storm/1.0.xml", "<pmd><violation class='A' method='m' rule='R' beginline='1'>x</violation></pmd>")
    assert landed.read_releases(spark, f"{tmpdir_path}/rel").first()["project"] == "STORM"
    assert landed.read_violations(spark, f"{tmpdir_path}/pmd/*").first()["project"] == "STORM"


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_snapshot_paths_are_relative_and_decoded(spark, tmpdir_path, scheme):
    root = f"{tmpdir_path}/src/test/checkouts"  # a test folder above the checkouts is no test folder of theirs
    write(f"{root}/storm/1.0/src/main/A B+c.java", "class A {}\n")
    write(f"{root}/storm/1.0/src/test/T.java", "class T {}\n")
    write(f"{root}/storm/1.1/src/main/D.java", "class D {}\n")
    write(f"{root}/storm/1.1/README.md", "x")
    releases = spark.createDataFrame([("STORM", "r0", "1.0"), ("STORM", "r1", "1.1")], "project string, release_id string, name string")
    s = landed.read_snapshot_files(spark, scheme + root, releases).collect()
    assert {(r["project"], r["release_id"], r["path"], r["content"].strip()) for r in s} == {
        ("STORM", "r0", "src/main/A B+c.java", "class A {}"), ("STORM", "r1", "src/main/D.java", "class D {}")}


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_store_keeps_other_classifiers_over_runs(spark, tmpdir_path, scheme):
    store = f"{scheme}{tmpdir_path}/store"
    rows = lambda *r: spark.createDataFrame(list(r), "project string, classifier string, run_ts int, auc double")
    results_store.append(spark, store, rows(("S", "RF", 1, 0.8), ("T", "RF", 1, 0.5)))
    results_store.append(spark, store, rows(("S", "NB", 2, 0.7)))
    results_store.append(spark, store, rows(("S", "RF", 3, 0.9)))
    got = {(r["project"], r["classifier"], r["run_ts"]) for r in results_store.load(spark, store).collect()}
    assert got == {("S", "RF", 3), ("S", "NB", 2), ("T", "RF", 1)}


def test_landed_files_meet(spark, tmpdir_path):
    """Commits, changes and snapshots of landed files meet on project and path."""
    from faultline.operators import history

    write(f"{tmpdir_path}/rel/storm.json", json.dumps({"versions": [
        {"id": str(i), "name": f"1.{i}", "releaseDate": f"2020-0{i + 1}-01"} for i in range(4)]}))
    write(f"{tmpdir_path}/log/storm.tsv", "c1\tann\t2020-01-10T00:00:00Z\tstart\nc2\tbob\t2020-02-10T00:00:00Z\tmore\n"
          "c3\tann\t2020-03-10T00:00:00Z\tSTORM-7 fix\tit\nbad line\nc3\tann\t2020-03-10T00:00:00Z\tSTORM-7 fix\tit\n")
    write(f"{tmpdir_path}/files/storm.tsv", "c1\tA\tsrc/A.java\t10\t0\nc2\tM\tsrc/A.java\t5\t2\nc3\tMODIFY\tsrc/A.java\t3\t1\nc3\tM\tlogo.png\t-\t-\n")
    for i in range(4):
        write(f"{tmpdir_path}/snap/storm/1.{i}/src/A.java", "class A {}\n")
    rel = landed.read_releases(spark, f"{tmpdir_path}/rel")
    commits = landed.read_commits(spark, f"{tmpdir_path}/log")
    changes = landed.read_file_changes(spark, f"{tmpdir_path}/files")
    snaps = landed.read_snapshot_files(spark, f"{tmpdir_path}/snap", rel)
    assert commits.count() == 3 and commits.filter("sha = 'c3'").first()["message"] == "STORM-7 fix\tit"
    assert {(r["sha"], r["change_type"], r["added"]) for r in changes.collect()} == {
        ("c1", "ADD", 10), ("c2", "MODIFY", 5), ("c3", "MODIFY", 3), ("c3", "MODIFY", 0)}
    keyed = commits.withColumn("ticket_key", history.ticket_key_in_message())
    assert [r["ticket_key"] for r in keyed.filter("ticket_key IS NOT NULL").collect()] == ["STORM-7"]
    fixed = history.fix_files(keyed.filter("ticket_key IS NOT NULL"), changes)
    assert [(r["path"], r["sha"]) for r in fixed.collect()] == [("src/A.java", "c3")]
    assert snaps.join(fixed, ["project", "path"]).count() == 4
