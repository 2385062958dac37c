import os

from faultline.plans import study


def test_study_end_to_end(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "study")
    inputs, ds = study.build_dataset(spark, "/root/testdata/sf0.001", out)
    projects = sorted(r[0] for r in ds.select("ProjectName").distinct().collect())[:2]
    info = study.train_and_choose(spark, inputs, ds, out, models=("NaiveBayes",), k=2, repeats=1, select=None, projects=projects)
    assert {p: i["best_model"] for p, i in info.items()} == {p: "NaiveBayes" for p in projects}
    for name in ("dataset_csv", "dataset_A", "full_feature_ranking", "fold_results", "results_store",
                 "composite_ranking", "best_model"):
        assert os.path.exists(os.path.join(out, name)), name
    stored = {(r["project"], r["classifier"]) for r in spark.read.parquet(f"{out}/results_store").collect()}
    assert stored == {(p, "NaiveBayes") for p in projects}
    v = study.what_if(spark, study.dataset_a(ds, inputs.releases), "NestingDepth", out, smote_percent=0, select=None).first()
    assert v["rows_conserved"] and v["actual_conserved"] and v["predicted_conserved"]
    os.makedirs(f"{out}/refactored")
    with open(f"{out}/refactored/x.csv", "w") as f:
        f.write('S,S,"A/m(a, b)",4,2,1,0,0,0,0,0,0,0.00,0,no\nS,S,B/n(),90,9,30,40,8,0,0,0,0,0.00,9,no\nshort,row\n')
    totals = study.refactor(spark, f"{out}/refactored", f"{out}/best_model/{projects[0]}", out).first()
    assert totals["n_scored"] == 2 and 0 <= totals["n_predicted_buggy"] <= 2
