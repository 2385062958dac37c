"""The whole study as four Spark programs, as a user of the reference runs it:

1. :func:`build_dataset` — releases, tickets, proportion, history, labels,
   metrics → the 15-column method dataset (K-1, Parquet copy too);
2. :func:`train_and_choose` — release cut (dataset A), Spearman ranking and
   the worst method of the best actionable feature (K-3, K-4), repeated CV
   of the classifiers with selection/SMOTE, results store (K-5), composite
   ranking (W-7) and the best model fitted on all of A (M-12, K-10);
3. :func:`what_if` — B+ / C split, counterfactual B, bagging trained on A,
   summary and verdict (K-7, K-8, M-15);
4. :func:`refactor` — refactored methods scored by a stored model (S-10, P-20,
   M-14, K-9).

Choice and evaluation are per project (``ProjectName``).
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dataset as ds_ops
from ..operators import evaluation as ev_ops
from ..operators import models as ml_ops
from ..operators import sampling as samp_ops
from ..operators import stats as stat_ops
from ..operators import whatif as wi_ops
from ..sources import landed, results_store, sinks, versioned_store
from .catalog import Inputs

FEATURES = ["LOC", "ParameterCount", "CycloComplexity", "CognitiveComplexity", "NestingDepth", "Revisions",
            "Authors", "TotalChurn", "MaxChurn", "AvgChurn", "NumberOfCodeSmells"]


def build_dataset(spark: SparkSession, sf_dir: str, out: str) -> tuple[Inputs, DataFrame]:
    i = Inputs(spark, sf_dir)
    ds = i.dataset
    ds_ops.write_dataset_parquet(ds, f"{out}/dataset_parquet")
    ds_ops.write_dataset_csv(ds, f"{out}/dataset_csv")
    return i, ds


def dataset_a(ds: DataFrame, releases: DataFrame, cut: float = 0.34) -> DataFrame:
    """P-10: the rows of each project's first releases."""
    return ds_ops.release_cut(ds, cut, order="date", releases=releases, project="ProjectName")


def _with_id(ds: DataFrame) -> DataFrame:
    return (ds.withColumn("id", F.concat_ws("|", "ProjectName", "Release", "MethodName"))
            .withColumn("buggy", (F.col("Bugginess") == "yes").cast("int")))


def train_and_choose(spark: SparkSession, inputs: Inputs, ds: DataFrame, out: str,
                     models: tuple[str, ...] = ml_ops.CLASSIFIERS, k: int = 10, repeats: int = 10,
                     cut: float = 0.34, select: float | None = 0.01, smote_percent: float | None = None,
                     leaky: bool = False, np_scale: float = 1.0, projects: list[str] | None = None,
                     max_rows: int | None = None) -> dict[str, dict]:
    """Every step per project, as the reference has it: ranking, worst method
    of the last release, CV (of all rows; with ``max_rows`` a larger project is thinned to them),
    store, choice and best model.  Returns what was chosen for each project."""
    a = _with_id(dataset_a(ds, inputs.releases, cut))
    if projects is not None:
        a = a.filter(F.col("ProjectName").isin(projects))
    a = a.checkpoint(eager=True)
    ds_ops.write_dataset_csv(a, f"{out}/dataset_A")
    rho = stat_ops.spearman(a, FEATURES, "buggy", by="ProjectName")
    ranking = stat_ops.feature_ranking(rho, by="ProjectName").checkpoint(eager=True)
    last = stat_ops.last_release(a, releases=inputs.releases, project="ProjectName").checkpoint(eager=True)
    names = projects if projects is not None else sorted(r[0] for r in a.select("ProjectName").distinct().collect())
    pred = ml_ops.cross_validate_by(a, "ProjectName", FEATURES, list(models), k=k, repeats=repeats, max_rows=max_rows,
                                    only=names, select=select, smote_percent=smote_percent, leaky=leaky)
    pred = pred.withColumn("model", F.concat_ws("/", "ProjectName", "model")).drop("ProjectName")
    fm = ev_ops.fold_metrics(pred).checkpoint(eager=True)
    at = F.split("model", "/")
    fm.withColumn("project", at[0]).withColumn("model", at[1]).write.mode("overwrite").partitionBy("project").parquet(f"{out}/fold_results")
    summary = ev_ops.cv_summary(fm).withColumn("project", at[0]).withColumn("model", at[1]).checkpoint(eager=True)
    new = summary.select("project", F.col("model").alias("classifier"), F.lit(int(time.time())).alias("run_ts"),
                         *[c for c in summary.columns if c not in ("model", "project")])
    versioned_store.append(spark, f"{out}/results_store", new)
    info = {}
    for p in names:
        own = F.col("ProjectName") == F.lit(p)
        ranks, rows = ranking.filter(own).drop("ProjectName"), a.filter(own)
        sinks.write_feature_ranking(ranks, f"{out}/full_feature_ranking/{p}")
        best = stat_ops.best_actionable(ranks).collect()  # at most one row
        focus = best[0]["feature"] if best else None
        worst = stat_ops.worst_method(last.filter(own), focus, "buggy", "id").collect() if focus else []  # at most one row
        if worst:
            sinks.write_method_ranking(stat_ops.method_feature_ranking(rows, ranks, FEATURES, worst[0]["id"], "id", focus),
                                       f"{out}/method_feature_ranking/{p}")
        result = summary.filter(F.col("project") == p).drop("project")
        ev_ops.composite_ranking(result, np_scale).write.mode("overwrite").parquet(f"{out}/composite_ranking/{p}")
        name, feats, model = ml_ops.fit_best(result, rows, FEATURES, "buggy", np_scale, select, smote_percent)
        results_store.save_model(model, a.select(*feats).schema.json(), f"{out}/best_model/{p}")
        info[p] = {"best_model": name, "features": feats, "best_feature": focus}
    return info


def what_if(spark: SparkSession, ds: DataFrame, feature: str, out: str, smote_percent: float = 20.0,
            select: float | None = 0.0) -> DataFrame:
    """On dataset A (see :func:`dataset_a`): bagging on the features that pass
    information gain > ``select``, fitted on all rows after SMOTE."""
    a = _with_id(ds)
    train = a.select("id", *[F.col(f).cast("double").alias(f) for f in FEATURES], F.col("buggy").cast("double")
                     .alias("label"))
    feats = ml_ops.select_features(train, FEATURES, "label", select)
    if smote_percent:
        train = samp_ops.smote(train, FEATURES, "label", "id", percent=smote_percent).drop("synthetic")
    model = ml_ops.build_classifier("Bagging", feats).fit(train.checkpoint(eager=True))
    tagged = wi_ops.tagged_sets(a.select("id", *FEATURES, "buggy"), feature)
    sinks.write_whatif_datasets(tagged, f"{out}/whatif_datasets")
    scored = model.transform(tagged.select("dataset", "buggy", *[F.col(f).cast("double").alias(f) for f in FEATURES])) \
        .withColumn("pred", F.col("prediction").cast("int"))
    summ = wi_ops.summary(scored).checkpoint(eager=True)
    wi_ops.write_summary_csv(summ, f"{out}/whatif_summary")
    return wi_ops.verdict(summ)


def refactor(spark: SparkSession, methods_csv: str, model_path: str, out: str) -> DataFrame:
    """Score a headerless CSV of refactored methods with a stored model: the
    training columns by name (absent ones 0), per-method lines and totals as
    CSV.  Returns the totals row."""
    model, features = results_store.load_model(spark, model_path)
    rows = landed.read_refactored_csv(spark, methods_csv)
    x = ml_ops.align_columns(rows, ["MethodName", *features]).fillna(0.0, subset=features)
    scored = model.transform(x)
    scored = scored.select("MethodName", ml_ops.positive_probability(scored).alias("score"), F.col("prediction").cast("int").alias("pred"))
    lines, totals = sinks.prediction_report(scored)
    lines.write.mode("overwrite").option("header", True).csv(f"{out}/prediction_lines")
    totals.write.mode("overwrite").option("header", True).csv(f"{out}/prediction_totals")
    return totals
