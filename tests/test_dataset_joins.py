from pyspark.sql import functions as F

from faultline.operators import dataset
from faultline.session import materialize
from faultline.sources import analogs


def plan(df):
    return df._jdf.queryExecution().toString()


def test_methods_meet_the_small_tables_without_a_shuffle(spark):
    kind = "project string, release_id string, path string"
    methods = spark.createDataFrame([("P", "r1", "a", 1, "m(1)"), ("P", "r1", "a", 2, "m(2)"), ("P", "r1", None, 3, "m(3)"), ("P", "r2", "b", 4, "m(4)")], f"{kind}, method_ord long, signature string")
    metrics = spark.createDataFrame([(1, 7, 1, 2, 3, 4)], "method_ord long, loc long, params long, cyclomatic long, cognitive long, nesting long")
    churn = spark.createDataFrame([("P", "r1", "a", 5, 2, 9, 8, 4.5), ("P", "r1", "a", 6, 2, 9, 8, 4.5), ("P", "r1", None, 9, 9, 9, 9, 9.0)],
                                  f"{kind}, revisions long, authors long, total_churn long, max_churn long, avg_churn double")
    labelled = spark.createDataFrame([("P", "r1", "a", True), ("P", "r2", "b", True), ("P", "r1", None, True)], f"{kind}, buggy boolean")
    smells = spark.createDataFrame([("P", "r1", "a", 2, 3)], f"{kind}, method_ord long, n_smells long")
    releases = spark.createDataFrame([("P", "r1", "1.0"), ("P", "r2", "1.1")], "project string, release_id string, name string")
    got = dataset.assemble(methods, materialize(metrics, "metrics"), churn, labelled, smells, materialize(releases, "releases"))
    rows = sorted((r.MethodName, r.LOC, r.Revisions, r.NumberOfCodeSmells, r.Bugginess) for r in got.collect())
    assert rows == [("a/m(1)", 7, 5, 0, "yes"), ("a/m(1)", 7, 6, 0, "yes"), ("a/m(2)", 0, 5, 3, "yes"), ("a/m(2)", 0, 6, 3, "yes"),
                    ("b/m(4)", 0, 0, 0, "yes"), ("m(3)", 0, 0, 0, "no")]
    assert "SortMergeJoin" not in plan(got) and "Exchange hashpartitioning" not in plan(got)


def test_files_of_one_class_are_dealt_to_all_tasks(spark):
    snaps = spark.createDataFrame([("P", f"r{i}", "core/src/F1.java") for i in range(40)], "project string, release_id string, path string").coalesce(1)
    pm = spark.createDataFrame([(i, "F1", "m", f"m({i})") for i in range(5)], "method_ord long, class string, simple_name string, signature string")
    got = analogs.snapshot_methods(snaps, pm)
    assert got.count() == 200 and got.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_profile_counts_each_column_on_its_own(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", None, 1), (None, None, 2), ("a", None, 2)], "x string, y string, n long")
    got = dataset.column_profile(df, max_nominal=1)
    assert [tuple(r) for r in got.collect()] == [("x", 2, "text"), ("y", 0, "text")]
    assert "Expand" not in plan(got)
