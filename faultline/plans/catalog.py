"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the landed tables of ``sf_dir`` (through the analog views of
:mod:`faultline.sources.analogs`) so its work grows with the data.  The twin
DuckDB SQL of each key lives in :mod:`faultline.plans.oracle`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window

from pyspark.sql import functions as F

from ..functions.paths import snapshot_file
from ..operators import commit_graph as graph_ops
from ..operators import dataset as ds_ops
from ..operators import history as hist_ops
from ..operators import smells as smell_ops
from ..operators import evaluation as ev_ops
from ..operators import fold_bayes as nb_ops
from ..operators import linediff as diff_ops
from ..operators import models as ml_ops
from ..operators import ownership as own_ops
from ..operators import whatif as wi_ops
from ..operators import sampling as samp_ops
from ..operators import stats as stat_ops
from ..operators import trees as tree_ops
from ..operators import structure as st_ops
from ..operators import labels as lab_ops
from ..operators import proportion as prop_ops
from ..operators.asof import asof_release
from ..operators import releases as rel_ops
from ..operators import tickets as tk_ops
from ..sources import analogs
from ..session import ensure_checkpoint_dir, materialize, scratch_folder
from ..sources import results_store, sinks, versioned_store
from ..sources.tables import Tables


class Inputs:
    """The analog engine tables of one data directory, built lazily once.

    The analog tables stand for *landed* tables (commits, releases, issues,
    file changes, snapshots, ...).  Each is materialised once with a reliable
    ``checkpoint()`` into ``spark.checkpoint.dir`` the first time a query
    needs it: downstream jobs then start from stored data, as they would from
    landed tables, and plans do not re-embed the derivation lineage.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, materialize: bool = True):
        self.t = Tables(spark, sf_dir)
        self.materialize = materialize
        self.run = uuid.uuid4().hex
        self._cache: dict[str, DataFrame] = {}

    def _get(self, name: str, build: Callable[[], DataFrame], store: bool = False) -> DataFrame:
        if name not in self._cache:
            df = build()
            if store and self.materialize:
                df = materialize(df, name, self.run)
            self._cache[name] = df
        return self._cache[name]

    @property
    def commits(self) -> DataFrame:
        return self._get("commits", lambda: analogs.commits(self.t), store=True)

    @property
    def releases(self) -> DataFrame:
        return self._get("releases", lambda: analogs.releases(self.t, self.commits), store=True)

    @property
    def file_changes(self) -> DataFrame:
        return self._get("file_changes", lambda: analogs.file_changes(self.t, self.commits), store=True)

    @property
    def issues(self) -> DataFrame:
        return self._get("issues", lambda: analogs.issues(self.t, self.releases), store=True)

    @property
    def release_ord(self) -> DataFrame:
        return self._get("release_ord", lambda: analogs.release_ordinals(self.releases), store=True)

    @property
    def versions(self) -> DataFrame:
        return self._get("versions", lambda: tk_ops.ticket_versions(self.issues, self.release_ord))

    @property
    def valid(self) -> DataFrame:
        return self._get("valid", lambda: tk_ops.valid_tickets(self.versions), store=True)

    @property
    def proportion(self) -> DataFrame:
        return self._get("proportion", lambda: prop_ops.project_proportion(self.valid), store=True)

    @property
    def snapshots(self) -> DataFrame:
        return self._get("snapshots", lambda: analogs.snapshots(self.t, self.file_changes, self.commits,
                                                                self.releases), store=True)

    @property
    def java_snapshots(self) -> DataFrame:
        return self._get("java_snapshots", lambda: self.snapshots.filter(snapshot_file()))

    @property
    def commits_rel(self) -> DataFrame:
        return self._get("commits_rel", lambda: asof_release(
            self.commits, F.to_date("committed_at"), self.release_ord, fallback="last", extra=("ord",)),
            store=True)

    @property
    def final_tickets(self) -> DataFrame:
        return self._get("final_tickets", lambda: prop_ops.estimate_injected(
            self.valid, self.release_ord, self.proportion), store=True)

    @property
    def fixing(self) -> DataFrame:
        return self._get("fixing", lambda: hist_ops.fixing_commits(self.commits_rel, self.final_tickets), store=True)

    @property
    def fix_files(self) -> DataFrame:
        return self._get("fix_files", lambda: hist_ops.fix_files(self.fixing, self.file_changes))

    def links(self, link: str = "ticket") -> DataFrame:
        return self._get(f"links_{link}", lambda: lab_ops.effective_links(
            lab_ops.injected_links(self.fixing, self.final_tickets, link), self.commits_rel))

    @property
    def intervals(self) -> DataFrame:
        return self._get("intervals", lambda: lab_ops.buggy_intervals(self.links(), self.fix_files,
                                                                      self.releases))

    @property
    def labelled(self) -> DataFrame:
        return self._get("labelled", lambda: lab_ops.label_snapshots(self.java_snapshots, self.intervals))

    @property
    def page_metrics(self) -> DataFrame:
        def build():
            pages = self.t.pages
            ev = st_ops.html_events(pages)
            m = st_ops.structural_metrics(ev, st_ops.rules_frame(self.t.spark), ["page_id"])
            loc = pages.select("page_id", st_ops.line_count("html").alias("loc"))
            return m.join(loc, "page_id", "right").withColumnRenamed("page_id", "method_ord")
        return self._get("page_metrics", build, store=True)

    @property
    def methods(self) -> DataFrame:
        return self._get("methods", lambda: analogs.snapshot_methods(self.java_snapshots,
                                                                     analogs.page_methods(self.t)))

    @property
    def smells(self) -> DataFrame:
        return self._get("smells", lambda: smell_ops.smell_counts(smell_ops.match_violations(
            analogs.violations(self.t), self.releases, self.methods)))

    @property
    def churn(self) -> DataFrame:
        return self._get("churn", lambda: hist_ops.file_churn(self.touched, self.java_snapshots))

    @property
    def dataset(self) -> DataFrame:
        return self._get("dataset", lambda: ds_ops.assemble(
            self.methods, self.page_metrics, self.churn, self.labelled, self.smells, self.releases), store=True)

    @property
    def touched(self) -> DataFrame:
        return self._get("touched", lambda: hist_ops.touched(self.file_changes, self.commits_rel), store=True)


def q_release_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Inputs(spark, sf_dir)
    return rel_ops.release_activity(i.commits, i.releases)


def q_ticket_versions(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return i.valid.select("project", "ticket_key", "created", "resolved", "ov_release_id", "fv_release_id",
                          "iv_release_id", "n_av")


def q_ticket_rejects(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return tk_ops.reject_counts(i.issues, i.releases)


def q_affected_versions(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    av = tk_ops.affected_versions(i.issues, i.releases)
    return av.select("project", "ticket_key", F.posexplode("affected").alias("p", "a")).select(
        "project", "ticket_key", (F.col("p") + 1).cast("bigint").alias("av_pos"),
        F.col("a.release_id").alias("release_id"), F.col("a.release_date").alias("release_date"))


def q_proportion_by_project(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return i.proportion


def q_proportion_self_cold_start(spark, sf_dir):
    """A-8 parity: the cold-start list holds only the project's own value."""
    i = Inputs(spark, sf_dir)
    return prop_ops.project_proportion(i.valid, cold_start="self")


def q_proportion_incremental(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return prop_ops.incremental_proportion(i.valid, cold=i.proportion)


def q_injected_versions(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    est = prop_ops.estimate_injected(i.valid, i.release_ord, i.proportion)
    return est.select("project", "ticket_key", "iv_release_id", "fv_release_id", "estimated", "n_affected")


def q_fix_commits(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    n = i.fix_files.groupBy("project", "sha").agg(F.count(F.lit(1)).alias("n_fix_files"))
    return (i.fixing.join(n, ["project", "sha"], "left")
            .select("project", "sha", "ticket_key", "release_id",
                    F.coalesce("n_fix_files", F.lit(0)).alias("n_fix_files")))


def q_bug_introducing_pairs(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return lab_ops.bug_introducing_counts(i.links(), i.commits_rel)


def q_bug_introducing_pairs_release(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return lab_ops.bug_introducing_counts(i.links("release"), i.commits_rel)


def q_buggy_commits(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return (lab_ops.buggy_commits(i.links(), i.commits_rel)
            .groupBy("project", "release_id").agg(F.count(F.lit(1)).alias("n_buggy_commits")))


def q_labelled_snapshots(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return i.labelled.select("project", "release_id", "path", "buggy")


def q_label_counters(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return lab_ops.label_counters(i.fix_files, i.links(), i.intervals, i.labelled)


def q_file_history(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return hist_ops.file_history(i.touched)


def q_file_churn(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return hist_ops.file_churn(i.touched, i.java_snapshots)


def q_line_churn(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return hist_ops.line_churn(analogs.revisions(i.t))


def q_release_snapshot(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return hist_ops.release_snapshot_commit(i.commits_rel)


def q_release_snapshot_log_last(spark, sf_dir):
    """J-9 parity: the oldest commit of each release, as the reference's list order gives."""
    i = Inputs(spark, sf_dir)
    return hist_ops.release_snapshot_commit(i.commits_rel, snapshot="log_last")


def q_file_churn_all_history(spark, sf_dir):
    """J-10 parity: churn over a file's whole history, later releases included."""
    i = Inputs(spark, sf_dir)
    return hist_ops.file_churn(i.touched, i.java_snapshots, history="all")


def q_nesting_depth(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return i.page_metrics.select(F.col("method_ord").alias("page_id"), "n_nodes", "nesting")


def q_weighted_complexity(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return i.page_metrics.select(F.col("method_ord").alias("page_id"), "params", "cyclomatic", "cognitive")


def q_text_size(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", F.length("text").cast("bigint").alias("n_chars"),
                    st_ops.line_count("text").alias("n_lines"))


def q_smell_counts(spark, sf_dir):
    return Inputs(spark, sf_dir).smells


def q_range_smell_counts(spark, sf_dir):
    """Violations per innermost method by line range (J-8)."""
    i = Inputs(spark, sf_dir)
    methods = i.methods.join(analogs.method_lines(i.t), "method_ord")
    return smell_ops.range_smell_counts(analogs.violations(i.t), i.releases, methods)


def q_method_dataset(spark, sf_dir):
    return Inputs(spark, sf_dir).dataset


def q_dataset_cut(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    cut = ds_ops.release_cut(i.dataset, 0.34, order="date", releases=i.releases, project="ProjectName")
    return cut.groupBy("ProjectName", "Release").agg(F.count(F.lit(1)).alias("n_rows"),
                                                     F.count(F.when(F.col("Bugginess") == "yes", 1)).alias("n_buggy"))


def q_dataset_cut_by_name(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    cut = ds_ops.release_cut(i.dataset, 0.34, order="name", project="ProjectName")
    return cut.groupBy("ProjectName", "Release").agg(F.count(F.lit(1)).alias("n_rows"),
                                                     F.count(F.when(F.col("Bugginess") == "yes", 1)).alias("n_buggy"))


def q_column_profile(spark, sf_dir):
    return ds_ops.column_profile(Inputs(spark, sf_dir).dataset)


ML_FEATURES = list(analogs.METHOD_FEATURES)


def _rows(spark, sf_dir):
    return analogs.method_rows(Tables(spark, sf_dir))


def q_spearman_ranking(spark, sf_dir):
    rho = stat_ops.spearman(_rows(spark, sf_dir), ML_FEATURES, "buggy")
    r = stat_ops.feature_ranking(rho)
    return r.select("rank", "feature", F.round("spearman_rho", 6).alias("spearman_rho"), "actionable")


def q_best_actionable(spark, sf_dir):
    r = stat_ops.feature_ranking(stat_ops.spearman(_rows(spark, sf_dir), ML_FEATURES, "buggy"))
    return stat_ops.best_actionable(r).select("feature", F.round("spearman_rho", 6).alias("spearman_rho"))


def q_worst_method(spark, sf_dir):
    """W-4 in the last release."""
    return stat_ops.worst_method(stat_ops.last_release(_rows(spark, sf_dir)), "NestingDepth", "buggy", "id")


def q_worst_method_all_releases(spark, sf_dir):
    """W-4 with all releases competing, as the reference does."""
    return stat_ops.worst_method(_rows(spark, sf_dir), "NestingDepth", "buggy", "id")


def q_text_feature_ranking(spark, sf_dir):
    """M-1 / W-2 on a second dataset: whole-text features of labelled documents."""
    rows = analogs.text_methods(Tables(spark, sf_dir))
    r = stat_ops.feature_ranking(stat_ops.spearman(rows, list(analogs.TEXT_FEATURES), "buggy"))
    return r.select("rank", "feature", F.round("spearman_rho", 6).alias("spearman_rho"), "actionable")


def q_info_gain_fixed_bins(spark, sf_dir):
    ig = stat_ops.info_gain_fixed_bins(_rows(spark, sf_dir), ML_FEATURES, "buggy", bins=10)
    return ig.select("feature", "n_bins", F.round("info_gain", 6).alias("info_gain"))


# Deterministic rule "classifiers": (name, score expression, prediction expression).
RULE_MODELS = (
    ("rule_loc", "LOC / 50.0", "LOC >= 30"),
    ("rule_nest", "NestingDepth / 10.0", "NestingDepth >= 6"),
    ("rule_mix", "0.02 * LOC + 0.08 * NestingDepth", "0.02 * LOC + 0.08 * NestingDepth >= 1.1"),
)
CV_FOLDS, CV_REPEATS = 5, 2


def _folds(spark, sf_dir):
    return samp_ops.stratified_folds(_rows(spark, sf_dir), "id", "buggy", k=CV_FOLDS, repeats=CV_REPEATS)


def _rule_scored(folded: DataFrame, *prefix: str) -> DataFrame:
    """predictions(model, rep, fold, id, label, score, pred) of the rule models
    for rows that have their fold, read once for all models; ``prefix`` columns
    go before a model's name."""
    found = F.array(*[F.struct(F.concat_ws("/", *prefix, F.lit(name)).alias("model"), F.expr(score).cast("double").alias("score"),
                               F.expr(pred).cast("int").alias("pred")) for name, score, pred in RULE_MODELS])
    x = folded.select("rep", "fold", "id", F.col("buggy").alias("label"), F.explode(found).alias("m"))
    return x.select("m.model", "rep", "fold", "id", "label", "m.score", "m.pred")


def rule_predictions(spark, sf_dir) -> DataFrame:
    """predictions(model, rep, fold, id, label, score, pred) of the rule models,
    every row scored once per repetition in its test fold."""
    rows = _rows(spark, sf_dir).select("id", "buggy", "LOC", "NestingDepth")
    return _rule_scored(samp_ops.folded_rows(rows, "id", "buggy", k=CV_FOLDS, repeats=CV_REPEATS))


#: The reference's cross-validation: ten repetitions of ten folds.
FULL_FOLDS, FULL_REPEATS = 10, 10


def _folds_full(spark, sf_dir):
    return samp_ops.stratified_folds(_rows(spark, sf_dir), "id", "buggy", k=FULL_FOLDS, repeats=FULL_REPEATS)


def _r6(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def q_folds_10x10(spark, sf_dir):
    """W-11 at the reference's 10 × 10."""
    return _folds_full(spark, sf_dir)


def _nb_full(spark, sf_dir):
    """M-9 at 10 × 10: fold measures of the 100 naive-Bayes models."""
    i = Inputs(spark, sf_dir)
    rows = _rows(spark, sf_dir).select("id", "buggy", *NB_FEATURES)
    folded = samp_ops.folded_chunks(rows, "id", "buggy", k=FULL_FOLDS, repeats=FULL_REPEATS)
    pred = i._get("nb_predictions", lambda: nb_ops.cross_validated_rows(folded, NB_FEATURES))
    return i._get("nb_fold_metrics", lambda: ev_ops.fold_metrics(pred), store=True)


def q_nb_cv_10x10(spark, sf_dir):
    return _r6(_nb_full(spark, sf_dir))


def q_nb_cv_summary_10x10(spark, sf_dir):
    """A-11, A-12 over ten repetitions."""
    return _r6(ev_ops.cv_summary(_nb_full(spark, sf_dir)))


# Kinds of the page events that stand for methods, which nest.
METHOD_KINDS = ("article", "lambda", "for", "li", "p", "footer")


def q_method_owner(spark, sf_dir):
    """C-1: events of each method itself, without those of the methods in it."""
    ev = st_ops.html_events(Tables(spark, sf_dir).pages)
    x = own_ops.owners(ev, ["page_id"], F.col("kind").isin(*METHOD_KINDS))
    return x.groupBy("page_id", "owner", "level").agg(F.count(F.lit(1)).alias("n_events"), F.max("seq").alias("last_seq"))


def q_nested_method_metrics(spark, sf_dir):
    """C-1, C-4…C-6 of every method, nested ones on their own and within theirs."""
    ev = st_ops.html_events(Tables(spark, sf_dir).pages)
    x = materialize(own_ops.owners(ev, ["page_id"], F.col("kind").isin(*METHOD_KINDS), count="all"), "owned_events")
    return st_ops.structural_metrics(x, st_ops.rules_frame(spark), ["page_id", "owner"])


def q_first_parent_order(spark, sf_dir):
    """S-4: root and depth of each commit along first parents."""
    return graph_ops.first_parent_order(analogs.commit_parents(Tables(spark, sf_dir)))


def _release_tips(i: Inputs) -> DataFrame:
    """The last commit of each release, as the one it was made from."""
    c = i.commits_rel.filter("ord is not null")
    return c.groupBy("project", "ord").agg(F.max(F.struct("committed_at", "sha")).alias("c")).select("project", F.col("c.sha").alias("sha"), "ord")


def q_first_releases(spark, sf_dir):
    """S-4: the first release that holds each commit, by ancestry."""
    i = Inputs(spark, sf_dir)
    return graph_ops.first_releases(analogs.commit_parents(i.t), _release_tips(i))


def q_commits_not_in_release(spark, sf_dir):
    """S-4: commits that no release holds, by ancestry."""
    i = Inputs(spark, sf_dir)
    return graph_ops.commits_not_in_release(analogs.commit_parents(i.t), _release_tips(i))


def q_snapshot_tree(spark, sf_dir):
    """S-7 / J-9: the files at each release, deleted ones gone."""
    i = Inputs(spark, sf_dir)
    changes = i.file_changes.join(i.commits_rel.filter("ord is not null").select("project", "sha", "committed_at", "ord"), ["project", "sha"])
    return graph_ops.snapshot_tree(changes, i.release_ord)


def q_smote_rows(spark, sf_dir):
    """M-3: the synthetic rows of every training side, from one neighbour graph."""
    made = samp_ops.smote_rows(_rows(spark, sf_dir), _folds(spark, sf_dir), NB_FEATURES)
    return _r6(made)


TREE_FEATURES = ["LOC", "NestingDepth", "ParameterCount", "TotalChurn"]


def _grown(spark, sf_dir):
    """M-6: one un-bagged tree, grown to purity on all folds but the first."""
    rows = samp_ops.folded_rows(_rows(spark, sf_dir).select("id", "buggy", *TREE_FEATURES), "id", "buggy", k=CV_FOLDS)
    return rows, tree_ops.grow(rows.filter("fold <> 0"), TREE_FEATURES, "buggy", "id", criterion="gini")


def q_tree_nodes(spark, sf_dir):
    """M-6: every node of the tree."""
    return _grown(spark, sf_dir)[1].select("node", "feature", "value", "n0", "n1")


def q_tree_holdout(spark, sf_dir):
    """M-6: the leaf that each row of the first fold reaches, and its classes."""
    rows, nodes = _grown(spark, sf_dir)
    nodes = materialize(nodes, "tree")
    return tree_ops.score(nodes, rows.filter("fold = 0"), TREE_FEATURES).drop("tree")


def q_line_diff(spark, sf_dir):
    """C-7: ordered diff of consecutive revisions, one word a line."""
    return diff_ops.line_diff(analogs.word_revisions(Tables(spark, sf_dir)))


def q_folds(spark, sf_dir):
    return _folds(spark, sf_dir)


def q_downsample(spark, sf_dir):
    return samp_ops.downsample(_rows(spark, sf_dir), 20000, "id", seed=42).select("id", "buggy")


def _fold_metrics(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    # The folded rows are a stage border: stored once, scored as they are read.
    pred = i._get("predictions", lambda: rule_predictions(spark, sf_dir))
    return i._get("fold_metrics", lambda: ev_ops.fold_metrics(pred), store=True)


def q_fold_metrics(spark, sf_dir):
    return _r6(_fold_metrics(spark, sf_dir))


def q_cv_summary(spark, sf_dir):
    return _r6(ev_ops.cv_summary(_fold_metrics(spark, sf_dir)))


def q_composite_ranking(spark, sf_dir):
    return _r6(ev_ops.composite_ranking(ev_ops.cv_summary(_fold_metrics(spark, sf_dir))))


def q_metric_distribution(spark, sf_dir):
    return _r6(ev_ops.metric_distribution(_fold_metrics(spark, sf_dir)))


NB_FEATURES = ["LOC", "NestingDepth", "ParameterCount", "TotalChurn"]


def q_gaussian_nb_scores(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    model = ml_ops.gaussian_nb_fit(rows, NB_FEATURES, "buggy")
    return ml_ops.gaussian_nb_score(rows, model, NB_FEATURES).select(
        "id", F.round("score", 6).alias("score"), "pred")


def q_knn_scores(spark, sf_dir):
    emb = Tables(spark, sf_dir).embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"),
                                                  "label")
    scaled = ml_ops.minmax_scale_vector(emb, "v")
    nn = ml_ops.knn_exact(scaled, scaled, "v", "vec_id", k=5, exclude_self=True)
    vote = ml_ops.knn_vote(nn, emb, "vec_id", "label")
    return vote.select(F.col("query_id").cast("bigint").alias("vec_id"), "pred_label",
                       F.round("score", 6).alias("score"))


WHATIF_FEATURE = "NestingDepth"
WHATIF_RULE = ("0.02 * LOC + 0.08 * NestingDepth", "0.02 * LOC + 0.08 * NestingDepth >= 0.9")


def _whatif_scored(spark, sf_dir):
    sets = wi_ops.tagged_sets(_rows(spark, sf_dir), WHATIF_FEATURE)
    return sets.withColumn("pred", F.expr(WHATIF_RULE[1]).cast("int"))


def q_whatif_split(spark, sf_dir):
    sets = wi_ops.tagged_sets(_rows(spark, sf_dir), WHATIF_FEATURE)
    return sets.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"),
                                       F.sum(F.col(WHATIF_FEATURE)).alias("feature_sum"))


def q_whatif_summary(spark, sf_dir):
    return wi_ops.summary(_whatif_scored(spark, sf_dir))


def q_whatif_verdict(spark, sf_dir):
    v = wi_ops.verdict(wi_ops.summary(_whatif_scored(spark, sf_dir)))
    return v.select(F.round("avoided_share", 6).alias("avoided_share"), "rows_conserved", "actual_conserved",
                    "predicted_conserved")


def q_smote_balance(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    bal = samp_ops.smote(rows, NB_FEATURES, "buggy", "id", percent=65.0, k=5, seed=42)
    return bal.groupBy("buggy", "synthetic").agg(F.count(F.lit(1)).alias("n_rows"))


FOREST_FOLDS, FOREST_REPEATS = 3, 1


def forest_cv(spark, sf_dir, k: int = FOREST_FOLDS, repeats: int = FOREST_REPEATS) -> tuple[DataFrame, DataFrame]:
    """M-9: (predictions, cv summary) of the three classifiers, with
    information-gain selection (> 0.01) and SMOTE (65 %) inside each training
    fold.  The reference runs 10 × 10; both are parameters."""
    rows = _rows(spark, sf_dir)
    folds = samp_ops.stratified_folds(rows, "id", "buggy", k=k, repeats=repeats)
    pred = ml_ops.cross_validate(rows, folds, ML_FEATURES, list(ml_ops.CLASSIFIERS), select=0.01, smote_percent=65.0)
    return pred, ev_ops.cv_summary(ev_ops.fold_metrics(pred))


def q_forest_cv(spark, sf_dir):
    """What holds for any tree learner, per model, repetition and fold: the
    fold's rows are scored once each, keep their labels, and get a probability."""
    pred, _ = forest_cv(spark, sf_dir)
    score = F.col("score")
    return pred.groupBy("model", "rep", "fold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"),
        F.sum(F.col("label").cast("bigint")).alias("n_buggy"),
        F.min((score >= 0) & (score <= 1) & F.col("pred").isin(0, 1)).alias("scores_valid"))


def whatif_forest(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """M-13: (summary, verdict) of bagged trees fitted on A after selection
    (information gain > 0) and SMOTE (20 %)."""
    rows = _rows(spark, sf_dir)
    train = rows.select("id", *[F.col(f).cast("double").alias(f) for f in ML_FEATURES], F.col("buggy").cast("double")
                        .alias("label"))
    feats = ml_ops.select_features(train, ML_FEATURES, "label", 0.0)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    train = samp_ops.smote(train, ML_FEATURES, "label", "id", percent=20.0).drop("synthetic")
    model = ml_ops.build_classifier("Bagging", feats).fit(train.repartition(n).checkpoint(eager=True))
    sets = wi_ops.tagged_sets(rows, WHATIF_FEATURE).select(
        "dataset", "buggy", *[F.col(f).cast("double").alias(f) for f in ML_FEATURES])
    scored = model.transform(sets).withColumn("pred", F.col("prediction").cast("int"))
    summary = materialize(wi_ops.summary(scored), "whatif_forest")
    return summary, wi_ops.verdict(summary)


def q_whatif_forest(spark, sf_dir):
    """Rows and labels of each set, and that predictions are conserved over A = B+ ∪ C."""
    summary, verdict = whatif_forest(spark, sf_dir)
    return summary.crossJoin(verdict.select("predicted_conserved")).select(  # four rows and one
        "dataset", "actual", "n_rows", ((F.col("predicted") >= 0) & (F.col("predicted") <= F.col("n_rows"))).alias("predicted_valid"),
        "predicted_conserved")


def q_spearman_by_project(spark, sf_dir):
    r = stat_ops.feature_ranking(stat_ops.spearman(_rows(spark, sf_dir), ML_FEATURES, "buggy", by="Project"), by="Project")
    return r.select("Project", "rank", "feature", F.round("spearman_rho", 6).alias("spearman_rho"), "actionable")


def _folds_by_project(spark, sf_dir):
    return samp_ops.stratified_folds(_rows(spark, sf_dir), "id", "buggy", k=CV_FOLDS, repeats=CV_REPEATS, by="Project")


def q_folds_by_project(spark, sf_dir):
    return _folds_by_project(spark, sf_dir)


def q_cv_by_project(spark, sf_dir):
    """A-11 / A-12 per project: the rule models over each project's own folds."""
    rows = _rows(spark, sf_dir).select("id", "Project", "buggy", "LOC", "NestingDepth")
    pred = _rule_scored(samp_ops.folded_rows(rows, "id", "buggy", k=CV_FOLDS, repeats=CV_REPEATS, by="Project"), "Project")
    s = _r6(ev_ops.cv_summary(ev_ops.fold_metrics(pred)))
    at = F.split("model", "/")
    return s.select(at[0].alias("Project"), at[1].alias("classifier"), *[c for c in s.columns if c != "model"])


ACTIONABLE = list(stat_ops.ACTIONABLE_FEATURES)


def _refactor_scored(spark, sf_dir) -> DataFrame:
    """M-14: naive Bayes on the six actionable metrics of the training releases
    (release cut), scoring the methods of each project's last release."""
    i = Inputs(spark, sf_dir)
    d = i.dataset.withColumn("buggy", (F.col("Bugginess") == "yes").cast("int"))
    train = ds_ops.release_cut(d, 0.34, order="date", releases=i.releases, project="ProjectName")
    model = ml_ops.gaussian_nb_fit(train, ACTIONABLE, "buggy")
    last = i.release_ord.filter(F.col("ord") == F.col("n_releases")).select(
        F.col("project").alias("ProjectName"), F.col("name").alias("Release"))
    test = d.join(last, ["ProjectName", "Release"], "left_semi")
    return ml_ops.gaussian_nb_score(test, model, ACTIONABLE)


def q_refactor_verdict(spark, sf_dir):
    """M-14 / A-14: totals and percentages per project."""
    return _refactor_scored(spark, sf_dir).groupBy("ProjectName").agg(
        F.count(F.lit(1)).alias("n_scored"), F.sum("pred").cast("bigint").alias("n_predicted_buggy"),
        F.round(F.avg("pred") * 100, 6).alias("pct_predicted_buggy"), F.round(F.max("score"), 6).alias("max_score"))


def q_prediction_report(spark, sf_dir):
    """K-9: the report's line of every scored method."""
    return sinks.prediction_report(_refactor_scored(spark, sf_dir))[0]


def q_project_results_upsert(spark, sf_dir):
    """K-5 / U-2: a store holding the results of a first run (repetition 0
    only) receives a newer run of one classifier; the store keeps the latest
    record per (project, classifier)."""
    fm = _fold_metrics(spark, sf_dir)

    def results(folds, ts):
        s = ev_ops.cv_summary(folds)
        return s.select(F.lit("method_rows").alias("project"), F.col("model").alias("classifier"),
                        F.lit(ts).alias("run_ts"), "avg_auc", "avg_recall", "runs")
    old = results(fm.filter(F.col("rep") == 0), 1)
    new = results(fm, 2).filter(F.col("classifier") == "rule_mix")
    up = results_store.upsert(old, new)
    return up.select("project", "classifier", "run_ts", F.round("avg_auc", 6).alias("avg_auc"),
                     F.round("avg_recall", 6).alias("avg_recall"), "runs")


def q_results_versions(spark, sf_dir):
    """K-5 / S-11: both versions of a store that received the runs of
    :func:`q_project_results_upsert`, the project of each record its classifier's
    first letter; read back by number."""
    fm = materialize(_fold_metrics(spark, sf_dir), "fold_metrics")

    def results(folds, ts):
        s = ev_ops.cv_summary(folds)
        return s.select(F.substring("model", 1, 1).alias("project"), F.col("model").alias("classifier"),
                        F.lit(ts).alias("run_ts"), "avg_auc", "avg_recall", "runs")
    store = scratch_folder(spark, "results_versions")
    versioned_store.append(spark, store, results(fm.filter(F.col("rep") == 0), 1))
    versioned_store.append(spark, store, results(fm.filter(F.col("model") == "rule_mix"), 2))
    one, two = (versioned_store.load(spark, store, n).withColumn("version", F.lit(n)) for n in (1, 2))
    return one.unionByName(two).select("version", "project", "classifier", "run_ts", F.round("avg_auc", 6).alias("avg_auc"),
                                       F.round("avg_recall", 6).alias("avg_recall"), "runs")


def q_info_gain_mdl(spark, sf_dir):
    ig = stat_ops.info_gain_mdl(_rows(spark, sf_dir), ML_FEATURES, "buggy")
    return ig.select("feature", "n_bins", F.round("info_gain", 6).alias("info_gain"))


def q_method_feature_ranking(spark, sf_dir):
    """W-3 → W-4 → W-8 / J-11: the best actionable feature, the buggy method
    with its largest value, and that method's features ranked with the focus
    feature first."""
    rows = _rows(spark, sf_dir)
    ranking = stat_ops.feature_ranking(stat_ops.spearman(rows, ML_FEATURES, "buggy"))
    focus = stat_ops.best_actionable(ranking).first()["feature"]  # one feature name
    worst = stat_ops.worst_method(rows, focus, "buggy", "id").select("id")
    one = rows.join(worst, "id", "left_semi")
    x = stat_ops.method_feature_ranking(one, ranking, ML_FEATURES, worst.first()["id"], "id", focus)  # one id
    return x.select("rank", "feature", "feature_value", F.round("spearman_rho", 6).alias("spearman_rho"))


def q_tickets_per_release(spark, sf_dir):
    """A-9: per project and release, tickets fixed in it and tickets injected in it."""
    t = Inputs(spark, sf_dir).final_tickets
    fixed = t.groupBy("project", F.col("fv_release_id").alias("release_id")).agg(F.count(F.lit(1)).alias("n_fixed"))
    inj = t.groupBy("project", F.col("iv_release_id").alias("release_id")).agg(F.count(F.lit(1)).alias("n_injected"))
    return fixed.join(inj, ["project", "release_id"], "full_outer").select(
        "project", "release_id", F.coalesce("n_fixed", F.lit(0)).alias("n_fixed"),
        F.coalesce("n_injected", F.lit(0)).alias("n_injected"))


def _with_checkpoint_dir(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Every query may cut lineage: make sure the session names a checkpoint
    folder (the cluster's shared one; a scratch folder only in local mode)."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        return fn(spark, sf_dir)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "release_activity": q_release_activity,
    "ticket_versions": q_ticket_versions,
    "ticket_rejects": q_ticket_rejects,
    "affected_versions": q_affected_versions,
    "proportion_by_project": q_proportion_by_project,
    "proportion_incremental": q_proportion_incremental,
    "proportion_self_cold_start": q_proportion_self_cold_start,
    "injected_versions": q_injected_versions,
    "fix_commits": q_fix_commits,
    "bug_introducing_pairs": q_bug_introducing_pairs,
    "bug_introducing_pairs_release": q_bug_introducing_pairs_release,
    "buggy_commits": q_buggy_commits,
    "labelled_snapshots": q_labelled_snapshots,
    "label_counters": q_label_counters,
    "file_history": q_file_history,
    "file_churn": q_file_churn,
    "line_churn": q_line_churn,
    "release_snapshot": q_release_snapshot,
    "release_snapshot_log_last": q_release_snapshot_log_last,
    "file_churn_all_history": q_file_churn_all_history,
    "nesting_depth": q_nesting_depth,
    "weighted_complexity": q_weighted_complexity,
    "text_size": q_text_size,
    "smell_counts": q_smell_counts,
    "range_smell_counts": q_range_smell_counts,
    "method_dataset": q_method_dataset,
    "dataset_cut": q_dataset_cut,
    "dataset_cut_by_name": q_dataset_cut_by_name,
    "column_profile": q_column_profile,
    "spearman_ranking": q_spearman_ranking,
    "best_actionable": q_best_actionable,
    "worst_method": q_worst_method,
    "worst_method_all_releases": q_worst_method_all_releases,
    "info_gain_fixed_bins": q_info_gain_fixed_bins,
    "text_feature_ranking": q_text_feature_ranking,
    "folds": q_folds,
    "folds_10x10": q_folds_10x10,
    "nb_cv_10x10": q_nb_cv_10x10,
    "nb_cv_summary_10x10": q_nb_cv_summary_10x10,
    "line_diff": q_line_diff,
    "method_owner": q_method_owner,
    "nested_method_metrics": q_nested_method_metrics,
    "first_parent_order": q_first_parent_order,
    "first_releases": q_first_releases,
    "commits_not_in_release": q_commits_not_in_release,
    "snapshot_tree": q_snapshot_tree,
    "tree_nodes": q_tree_nodes,
    "tree_holdout": q_tree_holdout,
    "downsample": q_downsample,
    "fold_metrics": q_fold_metrics,
    "cv_summary": q_cv_summary,
    "composite_ranking": q_composite_ranking,
    "metric_distribution": q_metric_distribution,
    "gaussian_nb_scores": q_gaussian_nb_scores,
    "knn_scores": q_knn_scores,
    "whatif_split": q_whatif_split,
    "whatif_summary": q_whatif_summary,
    "whatif_verdict": q_whatif_verdict,
    "smote_balance": q_smote_balance,
    "smote_rows": q_smote_rows,
    "forest_cv": q_forest_cv,
    "whatif_forest": q_whatif_forest,
    "spearman_by_project": q_spearman_by_project,
    "folds_by_project": q_folds_by_project,
    "cv_by_project": q_cv_by_project,
    "refactor_verdict": q_refactor_verdict,
    "prediction_report": q_prediction_report,
    "project_results_upsert": q_project_results_upsert,
    "results_versions": q_results_versions,
    "info_gain_mdl": q_info_gain_mdl,
    "method_feature_ranking": q_method_feature_ranking,
    "tickets_per_release": q_tickets_per_release,
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _with_checkpoint_dir(v) for k, v in _QUERIES.items()}
