import pytest
from pyspark.sql import functions as F

from faultline.operators import models, sampling
from faultline.sources import results_store


@pytest.fixture(scope="module")
def table(spark):
    rows = [(str(i), float(i % 7), float(i * i % 11), float(i % 7 > 3)) for i in range(60)]
    return spark.createDataFrame(rows, "id string, a double, b double, label double")


def scores(model, df):
    x = model.transform(df)
    return {r[0]: (round(r[1], 9), r[2]) for r in x.select("id", models.positive_probability(x), "prediction").collect()}


@pytest.mark.parametrize("name", ["NaiveBayes", "RandomForest", "IBk", "GrownForest", "prior"])
def test_every_kind_of_model_comes_back(spark, table, tmp_path, name):
    features = [] if name == "prior" else ["a", "b"]
    model = models.build_classifier(name, features, max_depth=5).fit(table)
    results_store.save_model(model, table.select(*features).schema.json(), str(tmp_path / name))
    again, names = results_store.load_model(spark, str(tmp_path / name))
    assert names == features and scores(again, table) == scores(model, table)


def test_refactor_runs_with_a_stored_kind(spark, table, tmp_path):
    from faultline.plans import study

    model = models.build_classifier("IBk", ["LOC"]).fit(table.withColumn("LOC", F.col("a")))
    results_store.save_model(model, table.select(F.col("a").alias("LOC")).schema.json(), str(tmp_path / "best"))
    (tmp_path / "methods.csv").write_text("".join(f"P,m{i}(),R,{i},1,1,1,1,1,1,1,1,1,0,no\n" for i in range(3)))
    totals = study.refactor(spark, str(tmp_path / "methods.csv"), str(tmp_path / "best"), str(tmp_path / "out"))
    assert totals.count() == 1


def test_empty_sides(spark, table):
    none = table.filter("id = 'x'")
    assert models.knn(table, none, ["a", "b"]).count() == 0 and models.knn(none, table, ["a", "b"]).count() == 0
    assert models.knn_exact(none, none, ["a", "b"], "id").count() == 0
    folds = sampling.stratified_folds(none, "id", "label", k=3)
    pred = models.cross_validate(none.withColumnRenamed("label", "buggy"), folds, ["a"], ["NaiveBayes"])
    assert pred.count() == 0 and pred.columns == ["model", "rep", "fold", "id", "label", "score", "pred"]
    assert models.cross_validate_by(none.withColumn("p", F.lit("x")).withColumnRenamed("label", "buggy"), "p", ["a"], ["NaiveBayes"]).count() == 0
