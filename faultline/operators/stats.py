"""Rank statistics and feature ranking (W-1, M-1, W-2, W-3, W-4, W-8, P-14, M-2).

Global ranks are never computed with one unpartitioned window over a fact
table.  Rows are first reduced to a histogram (feature, value[, label]) with
partial aggregation; ranks are computed over the distinct values with a
two-phase running sum (range partitions → per-partition totals → offsets →
local running sums); statistics then come from the histogram joined to the
ranks, never from rows joined back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hints import broadcast_if_small
from ..session import ensure_checkpoint_dir, materialize

# Features a developer can act on.
ACTIONABLE_FEATURES = ("NumberOfCodeSmells", "CycloComplexity", "LOC",
                       "CognitiveComplexity", "ParameterCount", "NestingDepth")


def is_actionable(name: str | Column = "feature") -> Column:
    """P-14: lower-cased alphanumerics of the name in the actionable set."""
    c = F.col(name) if isinstance(name, str) else name
    norm = F.lower(F.regexp_replace(c, "[^a-zA-Z0-9]", ""))
    return norm.isin(*[f.lower() for f in ACTIONABLE_FEATURES])


def to_long(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """(keep…, feature, value) with value as double; null values dropped."""
    x = df.select(*keep, *[F.col(f).cast("double").alias(f) for f in features])
    return x.unpivot(list(keep), features, "feature", "value").filter(F.col("value").isNotNull())


def average_ranks(hist: DataFrame, group: str, value: str, count: str = "c",
                  partitions: int | None = None) -> DataFrame:
    """W-1: average rank (ties share the mean of their positions) of each distinct
    ``value`` within ``group``, given a histogram (group, value, count).

    Two-phase running sum: the histogram is range-partitioned on (group,
    value); each partition's total per group becomes an offset for the later
    partitions of that group (a table of groups × partitions); the running sum
    inside a partition is a window over that partition's rows only.
    """
    ensure_checkpoint_dir(hist.sparkSession)
    spark = hist.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Materialised once: both phases must see the same range bounds.
    h = (hist.select(group, value, count).repartitionByRange(n, group, value)
         .withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True))
    tot = h.groupBy(group, "_pid").agg(F.sum(count).alias("_t"))
    w_off = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(group, "_pid", F.coalesce(F.sum("_t").over(w_off), F.lit(0)).alias("_off"))
    w_loc = Window.partitionBy(group, "_pid").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = h.withColumn("_cum", F.sum(count).over(w_loc))
    # groups × partitions rows (bounded by configuration): broadcast.
    x = local.join(F.broadcast(off), [group, "_pid"])
    cum = F.col("_cum") + F.col("_off")
    return x.select(group, value, count, (cum - F.col(count) + (F.col(count) + 1) / 2.0).alias("rank"))


#: Joins a group and a feature name in one key; no name contains it.
UNIT = "\x1f"


def spearman(df: DataFrame, features: list[str], label: str, by: str | None = None) -> DataFrame:
    """M-1: Spearman rho of each feature with ``label`` (ties → average ranks),
    within each value of ``by`` if given.

    Rows with a null feature value or label are left out of that feature's
    statistic.  Result: (by, feature, n, spearman_rho); rho is NaN for a
    constant feature.
    """
    ensure_checkpoint_dir(df.sparkSession)
    keep = ["_y", by] if by else ["_y"]
    long = to_long(df.withColumn("_y", F.col(label).cast("double")), features, keep).filter(F.col("_y").isNotNull())
    if by:
        long = long.withColumn("feature", F.concat_ws(UNIT, by, "feature"))
    # The (feature, value, label) histogram feeds three branches: materialise it once.
    h = materialize(long.groupBy("feature", "value", "_y").agg(F.count(F.lit(1)).alias("c")), "spearman_histogram")
    rx = average_ranks(h.groupBy("feature", "value").agg(F.sum("c").alias("c")), "feature", "value") \
        .select("feature", "value", F.col("rank").alias("rx"))
    ry = average_ranks(h.groupBy("feature", "_y").agg(F.sum("c").alias("c")), "feature", "_y") \
        .select("feature", "_y", F.col("rank").alias("ry"))
    # ry has features × label values rows: broadcast by its stored size only,
    # since a numeric label makes it grow with the data.
    j = h.join(rx, ["feature", "value"]).join(broadcast_if_small(materialize(ry, "label_ranks")), ["feature", "_y"])
    c, x, y = F.col("c"), F.col("rx"), F.col("ry")
    s = j.groupBy("feature").agg(F.sum(c).alias("n"), F.sum(c * x).alias("sx"), F.sum(c * y).alias("sy"),
                                 F.sum(c * x * x).alias("sxx"), F.sum(c * y * y).alias("syy"),
                                 F.sum(c * x * y).alias("sxy"))
    n = F.col("n").cast("double")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    rho = F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).otherwise(F.lit(float("nan")))
    names = [F.col("feature")]
    if by:
        at = F.split("feature", UNIT)
        names = [at[0].alias(by), at[1].alias("feature")]
    return s.select(*names, F.col("n").cast("bigint").alias("n"), rho.alias("spearman_rho"))


def feature_ranking(rho: DataFrame, by: str | None = None) -> DataFrame:
    """W-2 / K-3: rank by |rho| descending (1-based, ties by name), NaN rho
    left out, with the actionable flag, within each value of ``by`` if given.
    The input has one row per (group and) feature."""
    r = rho.filter(~F.isnan("spearman_rho") & F.col("spearman_rho").isNotNull())
    keys = [by] if by else []
    w = Window.partitionBy(*keys).orderBy(F.abs("spearman_rho").desc(), F.col("feature"))
    return r.select(*keys, F.row_number().over(w).cast("bigint").alias("rank"), "feature", "spearman_rho",
                    is_actionable("feature").alias("actionable"))


def best_actionable(ranking: DataFrame) -> DataFrame:
    """W-3: first actionable feature with rho > 0 (empty when none)."""
    return ranking.filter(F.col("actionable") & (F.col("spearman_rho") > 0)).orderBy("rank").limit(1)


def worst_method(df: DataFrame, feature: str, label: str = "buggy", id_col: str = "id",
                 release: str | None = None, release_value=None) -> DataFrame:
    """W-4: the buggy method with the largest value of ``feature``; ties → the
    smallest id.  ``release``/``release_value`` restrict to one release, the
    last one (see :func:`last_release`); without them all releases compete.
    One global aggregate (``min_by`` over (−value, id)), no sort."""
    x = df.filter(F.col(label) == 1)
    if release is not None:
        x = x.filter(F.col(release) == F.lit(release_value))
    v = F.col(feature).cast("double")
    pick = F.min_by(F.struct(F.col(id_col).alias(id_col), v.alias("value")), F.struct(-v, F.col(id_col)))
    return (x.filter(v.isNotNull()).groupBy().agg(pick.alias("_w"))
            .filter(F.col("_w").isNotNull())
            .select(F.lit(feature).alias("feature"), F.col(f"_w.{id_col}").alias(id_col),
                    F.col("_w.value").alias("value")))


def last_release(df: DataFrame, release: str = "Release", releases: DataFrame | None = None,
                 project: str | None = None) -> DataFrame:
    """Rows of the last release of each project: the latest date in
    ``releases`` (project, name, release_date), or the largest name without it."""
    keys = [project] if project else []
    names = df.select(*keys, release).distinct()
    if releases is not None:
        cols = [F.col("project").alias(project)] if project else []
        names = names.join(releases.select(*cols, F.col("name").alias(release), "release_date"), [*keys, release])
    else:
        names = names.withColumn("release_date", F.col(release))
    last = names.groupBy(*keys).agg(F.max_by(release, F.struct("release_date", release)).alias(release))
    return df.join(broadcast_if_small(last), [*keys, release], "left_semi")


def method_feature_ranking(df: DataFrame, ranking: DataFrame, features: list[str], method_id,
                           id_col: str = "id", focus: str | None = None) -> DataFrame:
    """W-8 / J-11 / K-4: for one method, every ranked feature with its value and
    rho; the focus feature first, then by |rho| descending.  The ranking has
    one row per feature (tens of rows): broadcast."""
    row = to_long(df.filter(F.col(id_col) == F.lit(method_id)), features, [id_col])
    x = row.join(F.broadcast(ranking.select("feature", "spearman_rho")), "feature")
    first = (F.col("feature") == F.lit(focus)) if focus else F.lit(False)
    w = Window.partitionBy(id_col).orderBy(first.desc(), F.abs("spearman_rho").desc(), F.col("feature"))
    return x.select(F.row_number().over(w).cast("bigint").alias("rank"), "feature", F.col("value").alias("feature_value"),
                    "spearman_rho")


def entropy_bits(*counts: Column) -> Column:
    """Shannon entropy in bits of a class distribution given as count columns."""
    total = sum(counts[1:], counts[0])
    terms = [F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(F.lit(0.0)) for c in counts]
    return F.when(total > 0, sum(terms[1:], terms[0])).otherwise(F.lit(0.0))


def info_gain_fixed_bins(df: DataFrame, features: list[str], label: str = "buggy", bins: int = 10) -> DataFrame:
    """M-2 (oracle variant): information gain of each feature with the 0/1 label
    after equal-width binning into ``bins`` bins between the feature's min and
    max.  A histogram job: (feature, bin, label) counts, then entropy sums."""
    long = to_long(df.withColumn("_y", F.col(label).cast("int")), features, ["_y"])
    rng = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = F.col("hi") - F.col("lo")
    b = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("lo")) / width * bins), F.lit(bins - 1))) \
        .otherwise(F.lit(0))
    # One row per feature (bounded by the feature list): broadcast, so the long
    # table is never shuffled on the few feature keys.
    h = (long.join(F.broadcast(rng), "feature").withColumn("bin", b)
         .groupBy("feature", "bin").agg(F.sum(F.when(F.col("_y") == 1, 1).otherwise(0)).alias("n1"),
                                        F.sum(F.when(F.col("_y") == 1, 0).otherwise(1)).alias("n0")))
    per = h.groupBy("feature").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"),
        F.sum((F.col("n0") + F.col("n1")) * entropy_bits(F.col("n0"), F.col("n1"))).alias("_cond"),
        F.count(F.lit(1)).alias("n_bins"))
    n = F.col("n0") + F.col("n1")
    ig = entropy_bits(F.col("n0"), F.col("n1")) - F.col("_cond") / n
    return per.select("feature", F.col("n_bins").cast("bigint").alias("n_bins"), ig.alias("info_gain"))


def running_sums(df: DataFrame, group: list[str], order: str | list[str], sums: list[str],
                 partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of ``sums`` within ``group`` in ``order`` (columns
    ``cum_<name>``), two-phase like :func:`average_ranks`: range partitions,
    per-(group, partition) totals turned into broadcast offsets, then a window
    over one partition's rows of one group."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [order] if isinstance(order, str) else list(order)
    h = materialize(df.repartitionByRange(n, *group, *order).withColumn("_pid", F.spark_partition_id()), "running_sums")
    tot = h.groupBy(*group, "_pid").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    w_off = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*group, "_pid", *[F.coalesce(F.sum(f"_t_{s}").over(w_off), F.lit(0)).alias(f"_o_{s}")
                                       for s in sums])
    w = Window.partitionBy(*group, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = h.select("*", *[F.sum(s).over(w).alias(f"_l_{s}") for s in sums])
    x = local.join(F.broadcast(off), [*group, "_pid"])  # groups × partitions rows
    return x.select(*df.columns, *[(F.col(f"_l_{s}") + F.col(f"_o_{s}")).alias(f"cum_{s}") for s in sums])


def _h2(a: Column, b: Column) -> Column:
    return entropy_bits(a.cast("double"), b.cast("double"))


def _k(a: Column, b: Column) -> Column:
    return (F.when(a > 0, 1).otherwise(0) + F.when(b > 0, 1).otherwise(0)).cast("double")


#: Intervals of at most this many distinct values are finished in one task.
LOCAL_VALUES = 10_000

_BINS = "feature string, cut double, seg double, n0 long, n1 long"


def _entropy(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Entropy in bits of class counts, elementwise."""
    total = np.maximum(a + b, 1)
    return sum(-np.where(c > 0, c / total * np.log2(np.maximum(c, 1) / total), 0.0) for c in (a, b))


def _finish_interval(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """All cuts and final bins inside one interval with a bounded number of values."""
    pdf = pdf.sort_values("value")
    value, n0, n1 = (pdf[c].to_numpy() for c in ("value", "n0", "n1"))
    out, todo = [], [(0, len(value), float(key[1]))]
    while todo:
        lo, hi, seg = todo.pop()
        l0, l1 = np.cumsum(n0[lo:hi], dtype="float64"), np.cumsum(n1[lo:hi], dtype="float64")
        t0, t1 = l0[-1], l1[-1]
        at = None
        if hi - lo > 1:
            l0, l1 = l0[:-1], l1[:-1]
            r0, r1, n = t0 - l0, t1 - l1, t0 + t1
            e = np.round(((l0 + l1) * _entropy(l0, l1) + (r0 + r1) * _entropy(r0, r1)) / n, 12)
            i = int(np.argmin(e))  # the first of equals: the smallest value
            hs, h1, h2 = (float(_entropy(np.float64(x), np.float64(y))) for x, y in ((t0, t1), (l0[i], l1[i]), (r0[i], r1[i])))
            k, k1, k2 = (int(x > 0) + int(y > 0) for x, y in ((t0, t1), (l0[i], l1[i]), (r0[i], r1[i])))
            delta = np.log2(3.0 ** k - 2) - (k * hs - k1 * h1 - k2 * h2)
            if hs - e[i] > (np.log2(n - 1) + delta) / n:
                at = lo + i + 1
        if at is None:
            out.append((key[0], None, seg, int(t0), int(t1)))
        else:
            cut = float(value[at - 1])
            out.append((key[0], cut, None, None, None))
            todo += [(lo, at, seg), (at, hi, cut)]
    return pd.DataFrame(out, columns=["feature", "cut", "seg", "n0", "n1"]).astype({"n0": "Int64", "n1": "Int64"})


def mdl_cuts(df: DataFrame, features: list[str], label: str = "buggy") -> DataFrame:
    """(feature, cut) of :func:`mdl_discretize`."""
    return mdl_discretize(df, features, label)[0]


def mdl_discretize(df: DataFrame, features: list[str], label: str = "buggy",
                   local_values: int = LOCAL_VALUES) -> tuple[DataFrame, DataFrame]:
    """Supervised discretisation (Fayyad & Irani 1993, MDL stopping rule) of each
    feature against a 0/1 label: cuts (feature, cut), with a cut meaning
    "≤ cut", and final bins (feature, seg, n0, n1), ``seg`` being the cut
    below the bin (−∞ for the first).

    Works on the (feature, value) → (n0, n1) histogram until no interval is
    open.  An interval with more than ``local_values`` distinct values is cut
    by jobs: its best boundary (least weighted class entropy; ties → smallest
    value; entropies equal in 12 decimals tie) comes from two-phase running sums, and the MDL test splits or
    closes it.  Smaller intervals are finished in one task each, by the same
    rule.  Only open intervals are carried on, and per-interval totals and
    decisions (one row per open interval) are stored, so joins with them are
    broadcast by their size.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    long = to_long(df.withColumn("_y", F.col(label).cast("int")), features, ["_y"])
    open_ = materialize(long.groupBy("feature", "value")
                        .agg(F.sum(F.when(F.col("_y") == 1, 0).otherwise(1)).alias("n0"),
                             F.sum(F.when(F.col("_y") == 1, 1).otherwise(0)).alias("n1"))
                        .withColumn("seg", F.lit(float("-inf"))), "mdl_histogram")
    key = ["feature", "seg"]
    done = None
    while True:
        sizes = materialize(open_.groupBy(*key).agg(F.count(F.lit(1)).alias("_m"), F.sum("n0").alias("t0"),
                                                    F.sum("n1").alias("t1")), "mdl_intervals")
        small = open_.join(broadcast_if_small(sizes.filter(F.col("_m") <= local_values).select(*key)), key, "left_semi")
        part = materialize(small.groupBy(*key).applyInPandas(_finish_interval, _BINS), "mdl_finished")
        done = part if done is None else done.unionByName(part)
        large = sizes.filter(F.col("_m") > local_values).drop("_m")
        if large.isEmpty():
            break
        act = open_.join(broadcast_if_small(large.select(*key)), key, "left_semi")
        c = running_sums(act, key, "value", ["n0", "n1"]).join(broadcast_if_small(large), key)
        l0, l1 = F.col("cum_n0"), F.col("cum_n1")
        r0, r1 = F.col("t0") - l0, F.col("t1") - l1
        n = (F.col("t0") + F.col("t1")).cast("double")
        nl, nr = (l0 + l1).cast("double"), (r0 + r1).cast("double")
        ent = F.round((nl * _h2(l0, l1) + nr * _h2(r0, r1)) / n, 12)
        cand = c.filter(nr > 0).select(*key, "value", ent.alias("e"), l0.alias("l0"), l1.alias("l1"), "t0", "t1")
        best = cand.groupBy(*key).agg(
            F.min_by(F.struct("value", "e", "l0", "l1", "t0", "t1"), F.struct("e", "value")).alias("b"))
        b = best.select(*key, "b.*")
        t0, t1, bl0, bl1 = F.col("t0"), F.col("t1"), F.col("l0"), F.col("l1")
        br0, br1 = t0 - bl0, t1 - bl1
        nn = (t0 + t1).cast("double")
        hs, h1, h2 = _h2(t0, t1), _h2(bl0, bl1), _h2(br0, br1)
        k, k1, k2 = _k(t0, t1), _k(bl0, bl1), _k(br0, br1)
        delta = F.log2(F.pow(F.lit(3.0), k) - 2) - (k * hs - k1 * h1 - k2 * h2)
        accept = (hs - F.col("e")) > (F.log2(nn - 1) + delta) / nn
        dec = materialize(b.select(*key, F.col("value").alias("cut"), "t0", "t1", accept.alias("accept")), "mdl_decisions")
        null = F.lit(None)
        part = dec.select("feature", F.when(F.col("accept"), F.col("cut")).alias("cut"),
                          F.when(F.col("accept"), null).otherwise(F.col("seg")).cast("double").alias("seg"),
                          F.when(F.col("accept"), null).otherwise(F.col("t0")).cast("long").alias("n0"),
                          F.when(F.col("accept"), null).otherwise(F.col("t1")).cast("long").alias("n1"))
        done = done.unionByName(part)
        split = act.join(broadcast_if_small(dec.filter("accept").select(*key, "cut")), key)
        open_ = materialize(split.select("feature", "value", "n0", "n1", F.when(F.col("value") > F.col("cut"), F.col("cut"))
                                         .otherwise(F.col("seg")).alias("seg")), "mdl_open")
    return (done.filter(F.col("cut").isNotNull()).select("feature", "cut"),
            done.filter(F.col("cut").isNull()).select("feature", "seg", "n0", "n1"))


def info_gain_mdl(df: DataFrame, features: list[str], label: str = "buggy") -> DataFrame:
    """M-2: information gain of each feature discretised by MDL; exactly 0 when
    no cut is accepted (one bin)."""
    _, bins = mdl_discretize(df, features, label)
    per = bins.groupBy("feature").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"),
        F.sum((F.col("n0") + F.col("n1")) * _h2(F.col("n0"), F.col("n1"))).alias("_cond"),
        F.count(F.lit(1)).alias("n_bins"))
    ig = _h2(F.col("n0"), F.col("n1")) - F.col("_cond") / (F.col("n0") + F.col("n1"))
    return per.select("feature", F.col("n_bins").cast("bigint").alias("n_bins"),
                      F.when(F.col("n_bins") == 1, F.lit(0.0)).otherwise(ig).alias("info_gain"))
