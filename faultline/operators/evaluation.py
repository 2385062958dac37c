"""Classifier evaluation from a predictions table (M-10, M-11, W-6, W-7, A-11, A-12, A-15).

``predictions(model, rep, fold, id, label 0/1, score = P(yes), pred 0/1)``:
every metric is a grouped aggregate over it, so all models, repetitions and
folds are evaluated by one job.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import fold_chunks
from .fold_chunks import FoldedChunks
from .sampling import row_positions
from .stats import running_sums

GROUP = ["model", "rep", "fold"]
METRICS = ("precision", "recall", "f1", "auc", "kappa", "accuracy", "npofb20")

# Fixed values of the composite score: weights of AUC, recall, NPofB20, kappa.
COMPOSITE_WEIGHTS = (0.30, 0.40, 0.20, 0.10)


@dataclass
class ScoredChunks:
    """The predictions of one model for rows by chunks, scored anew by each pass:
    ``score(columns, folds)`` yields (rep, rows, their folds, scores) of a chunk."""

    folded: FoldedChunks
    model: str
    label: str
    features: list[str]
    score: Callable


def fold_metrics(pred: DataFrame | ScoredChunks, top_share: float = 0.2) -> DataFrame:
    """Per (model, rep, fold): the 7 measures for class "yes" (label 1).

    precision/recall/F1 are 0 when undefined; kappa is 1 when chance
    agreement is 1; AUC is the Mann–Whitney statistic with mid-ranks of the
    score (NaN without both classes); NPofB20 is the share of buggy rows found
    in the top min(ceil(0.2·n), #buggy) rows by score (ties by id), 0 without
    buggy rows.
    """
    if isinstance(pred, ScoredChunks):
        return _measures(*_chunk_counts(pred, top_share))
    y, p = F.col("label"), F.col("pred")
    # One histogram (group, score) serves all measures; rows are read again only
    # for the ties at the cut.
    counts = ["tp", "fp", "fn", "tn"]
    h = materialize(pred.groupBy(*GROUP, "score").agg(
        F.count(F.lit(1)).alias("c"), F.sum("label").alias("c1"),
        F.sum(F.when((y == 1) & (p == 1), 1).otherwise(0)).alias("tp"),
        F.sum(F.when((y == 0) & (p == 1), 1).otherwise(0)).alias("fp"),
        F.sum(F.when((y == 1) & (p == 0), 1).otherwise(0)).alias("fn"),
        F.sum(F.when((y == 0) & (p == 0), 1).otherwise(0)).alias("tn")), "score_histogram")
    conf = h.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in counts])
    # AUC: mid-ranks of the score per group.
    r = running_sums(h.select(*GROUP, "score", "c", "c1"), GROUP, "score", ["c"]).filter(F.col("score").isNotNull())
    r = r.withColumn("rank", F.col("cum_c") - (F.col("c") - 1) / 2.0)
    auc = r.groupBy(*GROUP).agg(F.sum(F.col("c1") * F.col("rank")).alias("_rs"))
    # NPofB20 from the same histogram: scores wholly above the cut count at
    # once; only the rows tied at the boundary score are ordered by id.
    # conf has one row per (model, rep, fold): bounded by configuration, broadcast.
    sizes = conf.select(*GROUP, (F.col("tp") + F.col("fn")).alias("_nb"),
                        (F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")).alias("_n"))
    top = r.join(F.broadcast(sizes), GROUP)
    above = F.col("_n") - F.col("cum_c")
    top = top.select(*GROUP, "score", "c", "c1", above.cast("long").alias("_above"),
                     F.least(F.ceil(F.col("_n") * top_share), F.col("_nb")).alias("_k"))
    whole = top.filter(F.col("_above") + F.col("c") <= F.col("_k")).select(*GROUP, F.col("c1").alias("_found"))
    edge = top.filter((F.col("_above") < F.col("_k")) & (F.col("_above") + F.col("c") > F.col("_k")))
    ties = pred.select(*GROUP, "id", "label", "score").join(  # one edge score per group
        F.broadcast(edge.select(*GROUP, "score", (F.col("_k") - F.col("_above")).alias("_take"))), [*GROUP, "score"])
    pos = row_positions(ties, GROUP, ["id"]).filter(F.col("_pos") <= F.col("_take"))
    found = whole.unionByName(pos.select(*GROUP, F.col("label").cast("long").alias("_found")))
    found = found.groupBy(*GROUP).agg(F.sum("_found").alias("_found"))
    return _measures(conf, auc, found)


def _measures(conf: DataFrame, auc: DataFrame, found: DataFrame) -> DataFrame:
    """The measures from confusion counts, rank sums of the buggy rows, and buggy rows at the top."""
    x = conf.join(auc, GROUP, "left").join(found, GROUP, "left")
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    n1, n0 = tp + fn, fp + tn
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(n1 > 0, tp / n1).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    po = (tp + tn) / n
    pe = ((tp + fp) * n1 + (fn + tn) * n0) / (n * n)
    kappa = F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0)
    auc_v = F.when((n1 > 0) & (n0 > 0), (F.col("_rs") - n1 * (n1 + 1) / 2) / (n1 * n0)).otherwise(F.lit(float("nan")))
    np20 = F.when(n1 > 0, F.coalesce(F.col("_found"), F.lit(0)) / n1).otherwise(0.0)
    return x.select(*GROUP, prec.alias("precision"), rec.alias("recall"), f1.alias("f1"), auc_v.alias("auc"),
                    kappa.alias("kappa"), po.alias("accuracy"), np20.alias("npofb20"))


#: Bins of scores that are counted first; ranges that are sorted are made of them.
SCORE_BINS = 2_048


def _chunk_counts(pred: ScoredChunks, top_share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Confusion counts, rank sums and buggy rows at the top of each fold, as :func:`fold_metrics` has them.

    A first pass counts the folds' rows by bins of the score.  Bins are put
    together to ranges of about ``RANGE_ROWS`` rows; the scores alone go to a task
    by range, which knows from the counts how many rows lie below.  Only for
    scores tied at the cut are rows read once more, for their ids.
    """
    folded, label, score = pred.folded, pred.label, pred.score
    spark, repeats, k, id_col = folded.spark, folded.repeats, folded.k, folded.id_col
    columns = list(dict.fromkeys([label, *pred.features]))

    def scored(own, folds, reps=None):
        from .fold_bayes import _labels

        y = _labels(own[label])
        for rep, rows, fold, s in score(own, folds):
            if reps is None or rep in reps:
                yield rep, rows, fold, np.where(np.isnan(s), np.inf, s) + 0.0, y[rows]  # a score that is none is above all

    def sampled(chunks):  # where bins lie changes the work only
        import pyarrow as pa

        for own, folds in chunks:
            s = np.concatenate([x[3] for x in scored(own, folds)] or [np.zeros(0)])
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(np.quantile(s, np.linspace(0, 1, SCORE_BINS), method="lower"))], names=["s"])

    some = [r["s"] for r in folded.over(columns, sampled, "s double").limit(16 * SCORE_BINS).collect()]
    edges = np.unique(np.quantile(np.array(some), np.linspace(0, 1, SCORE_BINS), method="lower")) if some else np.zeros(1)
    bins = len(edges) + 1

    def counted(chunks):
        import pyarrow as pa

        n, conf = np.zeros((repeats, k * bins), "i8"), np.zeros((repeats, k, 4), "i8")
        for own, folds in chunks:
            for rep, _, fold, s, y in scored(own, folds):
                n[rep] += np.bincount(fold * bins + np.searchsorted(edges, s, "right"), minlength=k * bins)
                yes = s >= 0.5
                for i, hit in enumerate(((y == 1) & yes, (y == 0) & yes, (y == 1) & ~yes, (y == 0) & ~yes)):
                    conf[rep, :, i] += np.bincount(fold[hit], minlength=k)
        for rep in range(repeats):
            own = n[rep].reshape(k, bins)
            fold, b = np.nonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), rep), pa.int32()), pa.array(fold, pa.int32()), pa.array(b, pa.int32()), pa.array(own[fold, b])],
                                             names=["rep", "fold", "bin", "n"])
            fold, b = np.nonzero(conf[rep])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), rep), pa.int32()), pa.array(fold, pa.int32()), pa.array(-1 - b, pa.int32()), pa.array(conf[rep][fold, b])],
                                             names=["rep", "fold", "bin", "n"])

    n, conf = np.zeros((repeats, k, bins), "i8"), np.zeros((repeats, k, 4), "i8")
    for r in folded.over(columns, counted, "rep int, fold int, bin int, n long").groupBy("rep", "fold", "bin").agg(F.sum("n").alias("n")).collect():  # folds x bins
        if r["bin"] < 0:
            conf[r["rep"], r["fold"], -1 - r["bin"]] = r["n"]
        else:
            n[r["rep"], r["fold"], r["bin"]] = r["n"]
    upto = np.cumsum(n, axis=2)
    span = (upto - n) // fold_chunks.RANGE_ROWS  # the range of each bin
    below = np.where(np.diff(span, axis=2, prepend=-1) > 0, upto - n, 0)
    below = np.maximum.accumulate(below, axis=2)  # the rows below a bin's range
    size = conf.sum(axis=2)
    top = np.minimum(np.ceil(size * top_share).astype("i8"), conf[:, :, 0] + conf[:, :, 2])

    def sent(reps):
        def work(chunks):
            import pyarrow as pa

            for own, folds in chunks:
                for rep, _, fold, s, y in scored(own, folds, reps):
                    b = np.searchsorted(edges, s, "right")
                    order, ends = fold_chunks._cuts((fold * bins + span[rep, fold, b]) * 2 + (y == 1))
                    first = [order[i] for i, _ in ends]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([rep] * len(ends), pa.int32()), pa.array([fold[i] for i in first], pa.int32()),
                        pa.array([below[rep, fold[i], b[i]] for i in first], pa.int64()), pa.array([y[i] == 1 for i in first], pa.bool_()),
                        pa.array([np.sort(s[order[i:j]]).tobytes() for i, j in ends], pa.binary())], names=["rep", "fold", "below", "yes", "scores"])
        return work

    def ranked(table):
        import pyarrow as pa

        rep, fold, under = (table.column(c)[0].as_py() for c in ("rep", "fold", "below"))
        yes = table.column("yes").to_numpy()
        part = [np.frombuffer(x) for x in table.column("scores").to_pylist()]
        s = np.concatenate(part)
        u, at = np.unique(s, return_inverse=True)
        c = np.bincount(at, minlength=len(u))
        c1 = np.bincount(at, weights=np.repeat(yes, [len(x) for x in part]), minlength=len(u))
        cum = under + np.cumsum(c)
        above = size[rep, fold] - cum
        most = top[rep, fold]
        edge = np.flatnonzero((above < most) & (above + c > most))
        one = lambda x, t: pa.array([x], t)
        return pa.table({"rep": one(rep, pa.int32()), "fold": one(fold, pa.int32()), "_rs": one(float((c1 * (cum - (c - 1) / 2)).sum()), pa.float64()),
                         "_found": one(int(c1[above + c <= most].sum()), pa.int64()), "edge": one(float(u[edge[0]]) if len(edge) else None, pa.float64()),
                         "take": one(int(most - above[edge[0]]) if len(edge) else None, pa.int64())})

    parts = None
    reps = fold_chunks.waves(folded.rows, repeats)
    for wave in reps:
        x = folded.over(columns, sent(set(wave)), "rep int, fold int, below long, yes boolean, scores binary")
        x = materialize(x.groupBy("rep", "fold", "below").applyInArrow(ranked, "rep int, fold int, _rs double, _found long, edge double, take long"), "fold_ranks")
        parts = x if parts is None else parts.unionByName(x)
        if len(reps) > 1:
            fold_chunks.release(spark)
    edge = {(r["rep"], r["fold"]): (r["edge"], r["take"]) for r in parts.filter("edge is not null").collect()}  # one a fold
    parts = parts.withColumn("model", F.lit(pred.model))
    auc = parts.groupBy(*GROUP).agg(F.sum("_rs").alias("_rs"))
    found = parts.select(*GROUP, "_found")
    if edge:
        at = np.full((repeats, k), -1.0)
        for (rep, fold), (s, _) in edge.items():
            at[rep, fold] = s

        def tied(chunks):
            import pyarrow as pa

            for own, folds in chunks:
                for rep, rows, fold, s, y in scored(own, folds):
                    hit = np.flatnonzero(s == at[rep][fold])
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), rep), pa.int32()), pa.array(fold[hit], pa.int32()), own[id_col].take(pa.array(rows[hit])),
                                                          pa.array(y[hit] == 1)], names=["rep", "fold", "id", "yes"])

        kind = dict(folded.table.dtypes)[id_col][len("array<"):-1]
        ties = folded.over(list(dict.fromkeys([*columns, id_col])), tied, f"rep int, fold int, id {kind}, yes boolean").withColumn("model", F.lit(pred.model))
        take = spark.createDataFrame([(pred.model, rep, fold, t) for (rep, fold), (_, t) in edge.items()], "model string, rep int, fold int, _take long")
        pos = row_positions(ties, GROUP, ["id"]).join(F.broadcast(take), GROUP).filter("_pos <= _take")  # one row a fold
        found = found.unionByName(pos.select(*GROUP, F.col("yes").cast("long").alias("_found")))
    counts = [(pred.model, rep, fold, *conf[rep, fold].tolist()) for rep in range(repeats) for fold in range(k) if n[rep, fold].any()]
    found = found.groupBy(*GROUP).agg(F.sum("_found").alias("_found"))
    return spark.createDataFrame(counts, "model string, rep int, fold int, tp long, fp long, fn long, tn long"), auc, found


def _reference_running_mean(m: str) -> F.Column:
    """A-12 exact parity: the reference's incremental mean over repetitions in
    order, whose run counter also counts NaN runs (so weights drift after a
    NaN).  Folded over the repetitions of one model (a short, bounded list)."""
    arr = F.array_sort(F.collect_list(F.struct("rep", F.col(m).alias("x"))))
    init = F.struct(F.lit(None).cast("double").alias("avg"), F.lit(0).alias("n"))

    def step(acc, e):
        x, avg, n = e["x"], acc["avg"], acc["n"]
        new = (F.when(n == 0, x).when(F.isnan(x), avg).when(F.isnan(avg), x)
               .otherwise((avg * n + x) / (n + 1)))
        return F.struct(new.alias("avg"), (n + 1).alias("n"))

    return F.aggregate(arr, init, step, lambda acc: acc["avg"])


def cv_summary(folds: DataFrame, running_mean: str = "skip_nan") -> DataFrame:
    """A-11 + A-12: fold measures → mean per repetition (a NaN poisons its
    repetition, as a plain sum does) → per model the mean over repetitions
    skipping NaN (``avg_*``), the last repetition's values (``last_*``) and
    the number of repetitions (``runs``).  ``running_mean="reference"``
    reproduces the reference's drifting incremental mean instead."""
    per_rep = folds.groupBy("model", "rep").agg(*[F.avg(m).alias(m) for m in METRICS])
    aggs = []
    for m in METRICS:
        if running_mean == "reference":
            aggs.append(_reference_running_mean(m).alias(f"avg_{m}"))
        elif running_mean == "skip_nan":
            aggs.append(F.avg(F.when(~F.isnan(m), F.col(m))).alias(f"avg_{m}"))
        else:
            raise ValueError("running_mean must be 'skip_nan' or 'reference'")
        aggs.append(F.max_by(m, "rep").alias(f"last_{m}"))
    return per_rep.groupBy("model").agg(*aggs, F.count(F.lit(1)).alias("runs"))


def composite_score(np_scale: float = 1.0):
    """M-11: 0.30·AUC + 0.40·recall + 0.20·clamp(NP/np_scale) + 0.10·(kappa+1)/2.
    ``np_scale=100`` reproduces the reference, which divides a 0–1 value by 100."""
    wa, wr, wn, wk = COMPOSITE_WEIGHTS
    np_ = F.least(F.greatest(F.col("avg_npofb20") / np_scale, F.lit(0.0)), F.lit(1.0))
    return (wa * F.col("avg_auc") + wr * F.col("avg_recall") + wn * np_
            + wk * (F.col("avg_kappa") + 1.0) / 2.0)


def composite_ranking(summary: DataFrame, np_scale: float = 1.0) -> DataFrame:
    """W-7: classifiers by composite score, best first; ties keep name order.
    The summary has one row per classifier."""
    x = summary.withColumn("composite", composite_score(np_scale))
    w = Window.orderBy(F.col("composite").desc(), F.col("model"))
    return x.select(F.row_number().over(w).cast("bigint").alias("position"), "model", "composite")


def metric_distribution(folds: DataFrame) -> DataFrame:
    """A-15: per (model, metric) quartiles, mean, sample std, min, max, range of
    the per-fold values (box-plot numbers)."""
    long = folds.unpivot(["model", "rep", "fold"], list(METRICS), "metric", "value")
    v = F.col("value")
    return long.groupBy("model", "metric").agg(
        F.percentile(v, 0.25).alias("q1"), F.percentile(v, 0.5).alias("median"),
        F.percentile(v, 0.75).alias("q3"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"), (F.max(v) - F.min(v)).alias("range"))
