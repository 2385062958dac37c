"""Naive Bayes of every fold from one pass (M-5, M-9, U-4).

A Gaussian model is a count, a sum and a sum of squares per class and feature.
These add up, so the model trained on all rows but a fold's is the sums of the
repetition less the sums of the fold: one aggregate over the fold table gives
all models of a repeated cross-validation, and one join scores all test folds.
No fit is run per fold.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hints import broadcast_if_small
from ..session import materialize
from .evaluation import ScoredChunks
from .fold_chunks import NO_FOLD, FoldedChunks
from .models import VAR_FLOOR


def _parts(prefix: str, features: list[str]) -> list[str]:
    return [f"{prefix}{k}_{f}" for f in features for k in ("n", "s", "q")]


def fold_sums(folded: DataFrame, features: list[str], centre: dict[str, float]) -> DataFrame:
    """(rep, fold, label, n, and per feature the count, sum and sum of squares of
    its values): one row per fold and class.  Values are taken from ``centre``,
    so that the difference of squares keeps its digits."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for f in features:
        x = F.col(f) - F.lit(centre[f])
        aggs += [F.count(f).alias(f"n_{f}"), F.coalesce(F.sum(x), F.lit(0.0)).alias(f"s_{f}"), F.coalesce(F.sum(x * x), F.lit(0.0)).alias(f"q_{f}")]
    return folded.groupBy("rep", "fold", "label").agg(*aggs)


def fold_models(sums: DataFrame, features: list[str], centre: dict[str, float]) -> DataFrame:
    """(rep, fold, label, n, m_<feature>, v_<feature>) of each training side,
    the repetition less the fold.  A class that only the fold has is left out."""
    parts = ["n", *_parts("", features)]
    total = sums.groupBy("rep", "label").agg(*[F.sum(c).alias(f"all_{c}") for c in parts])
    keys = sums.select("rep", "fold").distinct()
    own = sums.select("rep", "fold", "label", *[F.col(c).alias(f"own_{c}") for c in parts])
    x = keys.join(total, "rep").join(own, ["rep", "fold", "label"], "left")
    x = x.select("rep", "fold", "label", *[(F.col(f"all_{c}") - F.coalesce(F.col(f"own_{c}"), F.lit(0))).alias(c) for c in parts])
    cols: list[Column] = []
    for f in features:
        n = F.col(f"n_{f}")
        mean = F.col(f"s_{f}") / n
        cols += [F.when(n > 0, mean + centre[f]).alias(f"m_{f}"),
                 F.when(n > 0, F.greatest(F.col(f"q_{f}") / n - mean * mean, F.lit(VAR_FLOOR))).alias(f"v_{f}")]
    return x.filter("n > 0").select("rep", "fold", "label", "n", *cols)


def _log_likelihood(side: str, features: list[str]) -> Column:
    ll = F.log(F.col(f"{side}.n").cast("double"))
    for f in features:
        m, v = F.col(f"{side}.m_{f}"), F.col(f"{side}.v_{f}")
        term = F.log(v) * -0.5 - 0.5 * math.log(2 * math.pi) - (F.col(f) - m) ** 2 / (2 * v)
        ll = ll + F.coalesce(term, F.lit(0.0))  # a missing value says nothing
    return ll


def cross_validated(rows: DataFrame, folds: DataFrame, features: list[str], id_col: str = "id", label: str = "buggy",
                    name: str = "NaiveBayes") -> DataFrame:
    """predictions(model, rep, fold, id, label, score, pred): every row of
    ``folds`` (id, rep, fold) scored by the model of the other folds of its
    repetition.  Labels are 0 or 1; where the training side has one class only,
    it scores 1 if that is class 1, else 0.  Rows of a repetition with a single
    fold have no training side and are not scored."""
    own = rows.select(id_col, label, *features)
    return cross_validated_rows(materialize(folds.select(id_col, "rep", "fold").join(own, id_col), "folded_rows"), features, id_col, label, name)


def cross_validated_rows(folded: DataFrame | FoldedChunks, features: list[str], id_col: str = "id", label: str = "buggy",
                         name: str = "NaiveBayes") -> DataFrame | ScoredChunks:
    """As :func:`cross_validated`, from stored rows that have their rep and fold
    (:func:`faultline.operators.sampling.folded_rows`).  Of rows by chunks
    (:func:`faultline.operators.sampling.folded_chunks`) the same scores, made anew
    by each pass that :func:`faultline.operators.evaluation.fold_metrics` makes."""
    if isinstance(folded, FoldedChunks):
        return _scored_chunks(folded, features, label, name)
    folded = folded.select(F.col(id_col).alias("id"), "rep", "fold", F.col(label).cast("int").alias("label"), *[F.col(f).cast("double").alias(f) for f in features])
    means = folded.agg(*[F.avg(f).alias(f) for f in features]).first()  # one row
    centre = {f: means[f] or 0.0 for f in features}
    models = fold_models(materialize(fold_sums(folded, features, centre), "fold_sums"), features, centre)
    per_class = F.struct("n", *[f"{k}_{f}" for f in features for k in ("m", "v")])
    pair = models.groupBy("rep", "fold").agg(F.max(F.when(F.col("label") == 1, per_class)).alias("yes"), F.max(F.when(F.col("label") == 0, per_class)).alias("no"))
    x = folded.join(broadcast_if_small(materialize(pair, "fold_models")), ["rep", "fold"])
    odds = _log_likelihood("yes", features) - _log_likelihood("no", features)
    score = F.when(F.col("yes").isNull(), 0.0).when(F.col("no").isNull(), 1.0).otherwise(1.0 / (1.0 + F.exp(-odds)))
    return x.select(F.lit(name).alias("model"), "rep", "fold", "id", "label", score.alias("score"), (score >= 0.5).cast("int").alias("pred"))


def _numbers(array) -> tuple[np.ndarray, np.ndarray]:
    """Values of an Arrow array as doubles, and which are there."""
    there = array.is_valid().to_numpy(zero_copy_only=False)
    return array.cast("double").fill_null(0.0).to_numpy(zero_copy_only=False), there


def _labels(array) -> np.ndarray:
    """0, 1 or another number; -1 where there is none."""
    return array.cast("double", safe=False).fill_null(-1.0).to_numpy(zero_copy_only=False).astype("i8")


def _chunk_sums(folded: FoldedChunks, features: list[str], label: str, centre: dict[str, float]) -> DataFrame:
    """:func:`fold_sums` of rows by chunks: (rep, fold, class) sums by task, then over all."""
    names, k = ["n", *_parts("", features)], folded.k

    def work(chunks):
        import pyarrow as pa

        total: dict = {}
        for own, folds in chunks:
            y = _labels(own[label])
            classes, code = np.unique(y, return_inverse=True)
            parts = [np.ones(len(y))]
            for f in features:
                v, there = _numbers(own[f])
                x = np.where(there, v - centre[f], 0.0)
                parts += [there.astype(float), x, x * x]
            for rep, fold in enumerate(folds):
                dealt = fold < k
                key = (fold.astype("i8") * len(classes) + code)[dealt]
                sums = np.stack([np.bincount(key, weights=p[dealt], minlength=k * len(classes)) for p in parts])
                for c in np.flatnonzero(sums[0]):
                    at = rep, int(c // len(classes)), int(classes[c % len(classes)])
                    total[at] = total.get(at, 0) + sums[:, c]
        keys, sums = list(total), np.array(list(total.values())).reshape(len(total), len(names))
        whole = {i for i, n in enumerate(names) if n.startswith("n")}
        yield pa.RecordBatch.from_arrays([*[pa.array([x[i] for x in keys], pa.int32()) for i in range(3)],
                                          *[pa.array(sums[:, i].round().astype("i8") if i in whole else sums[:, i]) for i in range(len(names))]],
                                         names=["rep", "fold", "label", *names])

    schema = "rep int, fold int, label int, " + ", ".join(f"{n} {'long' if n.startswith('n') else 'double'}" for n in names)
    x = folded.over([label, *features], work, schema).groupBy("rep", "fold", "label").agg(*[F.sum(n).alias(n) for n in names])
    return x.withColumn("label", F.when(F.col("label") >= 0, F.col("label")))


def _scored_chunks(folded: FoldedChunks, features: list[str], label: str, name: str) -> ScoredChunks:
    first = folded.table.select(*features).first()  # one chunk: any centre keeps the digits
    centre = {f: float(np.mean([x for x in map(float, filter(lambda v: v is not None, first[f])) if math.isfinite(x)] or [0.0])) if first else 0.0 for f in features}
    models = fold_models(materialize(_chunk_sums(folded, features, label, centre), "fold_sums"), features, centre)
    model = np.full((folded.repeats, folded.k, 2, 1 + 2 * len(features)), np.nan)
    trained = np.zeros((folded.repeats, folded.k), bool)
    for r in models.collect():  # repetitions x folds x classes
        trained[r["rep"], r["fold"]] = True
        if r["label"] in (0, 1):
            model[r["rep"], r["fold"], r["label"]] = [r["n"], *[r[f"{m}_{f}"] if r[f"{m}_{f}"] is not None else np.nan for f in features for m in "mv"]]

    def score(own, folds):
        """(rep, rows, their folds, scores) of one chunk."""
        columns = [_numbers(own[f]) for f in features]
        for rep, fold in enumerate(folds):
            rows = np.flatnonzero(fold < NO_FOLD if fold.dtype == "u1" else fold < len(trained[0]))
            at = fold[rows].astype("i8")
            keep = trained[rep][at]
            rows, at = rows[keep], at[keep]
            sides = []
            for side in (1, 0):
                m = model[rep, :, side]
                ll = np.log(m[:, 0])[at]
                for i, (v, there) in enumerate(columns):
                    mean, var = m[:, 1 + 2 * i], m[:, 2 + 2 * i]
                    term = (np.log(var) * -0.5 - 0.5 * math.log(2 * math.pi))[at] - (v[rows] - mean[at]) ** 2 / (2 * var[at])
                    # A missing value says nothing, nor does a feature that a class never had.
                    none = ~there[rows] | (~np.isnan(m[:, 0]) & np.isnan(var))[at]
                    ll = ll + np.where(none, 0.0, term)
                sides.append(ll)
            with np.errstate(over="ignore", invalid="ignore"):
                s = 1.0 / (1.0 + np.exp(-(sides[0] - sides[1])))
            s = np.where(np.isnan(model[rep, :, 1, 0])[at], 0.0, np.where(np.isnan(model[rep, :, 0, 0])[at], 1.0, s))
            yield rep, rows, at, s

    return ScoredChunks(folded, name, label, features, score)
