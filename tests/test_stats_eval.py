import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultline.operators import evaluation, sampling, stats


def test_average_ranks_sum_and_ties(spark):
    vals = [3.0, 1.0, 3.0, 2.0, 3.0, 5.0]
    h = spark.createDataFrame([("f", v) for v in vals], "g string, v double").groupBy("g", "v").agg(
        F.count(F.lit(1)).alias("c"))
    r = {row["v"]: row["rank"] for row in stats.average_ranks(h, "g", "v", partitions=3).collect()}
    assert r == {1.0: 1.0, 2.0: 2.0, 3.0: 4.0, 5.0: 6.0}
    assert sum(r[v] for v in vals) == len(vals) * (len(vals) + 1) / 2


def test_spearman_matches_pandas(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 9), rnd.random(), rnd.randint(0, 1)) for _ in range(400)]
    df = spark.createDataFrame(rows, "a int, b double, y int")
    got = {r["feature"]: r["spearman_rho"] for r in stats.spearman(df, ["a", "b"], "y").collect()}
    pdf = pd.DataFrame(rows, columns=["a", "b", "y"])
    for f in ("a", "b"):
        # Spearman = Pearson of average ranks (brute force with pandas ranks).
        expect = pdf[f].rank(method="average").corr(pdf["y"].rank(method="average"))
        assert got[f] == pytest.approx(expect, abs=1e-12)


def test_ranking_and_actionable(spark):
    rho = spark.createDataFrame([("Revisions", 0.6), ("LOC", 0.15), ("Nesting Depth", -0.2), ("X", float("nan"))],
                                "feature string, spearman_rho double")
    r = stats.feature_ranking(rho).collect()
    assert [x["feature"] for x in r] == ["Revisions", "Nesting Depth", "LOC"]
    assert [x["actionable"] for x in r] == [False, True, True]
    assert stats.best_actionable(stats.feature_ranking(rho)).first()["feature"] == "LOC"


def preds(spark, rows):
    return spark.createDataFrame([("m", 0, 0, f"id{i:02d}", y, s, int(s >= 0.5)) for i, (y, s) in enumerate(rows)],
                                 "model string, rep int, fold int, id string, label int, score double, pred int")


def test_npofb20_golden(spark):
    # 10 rows, 3 buggy at ranks 1, 3, 4 by score -> N = min(ceil(2.0), 3) = 2 -> 1/3.
    ys = [1, 0, 1, 1, 0, 0, 0, 0, 0, 0]
    rows = [(y, 1.0 - i / 10) for i, y in enumerate(ys)]
    m = evaluation.fold_metrics(preds(spark, rows)).first()
    assert m["npofb20"] == pytest.approx(1 / 3)


def test_auc_symmetry_and_confusion(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 2)) for _ in range(300)]
    a = evaluation.fold_metrics(preds(spark, rows)).first()
    b = evaluation.fold_metrics(preds(spark, [(y, -s) for y, s in rows])).first()
    assert a["auc"] + b["auc"] == pytest.approx(1.0)
    tp = sum(1 for y, s in rows if y == 1 and s >= 0.5)
    fp = sum(1 for y, s in rows if y == 0 and s >= 0.5)
    assert a["precision"] == pytest.approx(tp / (tp + fp))


def test_composite_reproduces_reference_ranking(spark):
    s = spark.createDataFrame([
        ("NaiveBayes", 0.729981, 0.655736, 0.533183, 0.541389),
        ("RandomForest", 0.843516, 0.750443, 0.573450, 0.617554),
        ("IBk", 0.840986, 0.748298, 0.573284, 0.615091)],
        "model string, avg_auc double, avg_recall double, avg_npofb20 double, avg_kappa double")
    r = evaluation.composite_ranking(s, np_scale=100.0).collect()
    assert [x["model"] for x in r] == ["RandomForest", "IBk", "NaiveBayes"]
    assert r[0]["composite"] == pytest.approx(0.635257, abs=1e-6)
    assert r[2]["composite"] == pytest.approx(0.559424, abs=1e-6)


def test_cv_summary_skips_nan(spark):
    folds = spark.createDataFrame([("m", 0, 0, float("nan")), ("m", 1, 0, 0.5), ("m", 2, 0, 0.7)],
                                  "model string, rep int, fold int, auc double")
    for c in evaluation.METRICS:
        if c != "auc":
            folds = folds.withColumn(c, F.lit(1.0))
    s = evaluation.cv_summary(folds).first()
    assert s["avg_auc"] == pytest.approx(0.6) and s["last_auc"] == 0.7 and s["runs"] == 3
    # The reference's counter also counts the NaN run: (0.5 * 2 + 0.7) / 3.
    r = evaluation.cv_summary(folds, running_mean="reference").first()
    assert r["avg_auc"] == pytest.approx((0.5 * 2 + 0.7) / 3) and r["avg_precision"] == 1.0


def test_row_positions_and_folds(spark):
    rnd = random.Random(11)
    df = spark.createDataFrame([(f"r{i}", rnd.randint(0, 1), rnd.random()) for i in range(500)],
                               "id string, y int, s double")
    pos = sampling.row_positions(df, ["y"], ["s", "id"], partitions=5).collect()
    for y in (0, 1):
        mine = sorted(((r["s"], r["id"]), r["_pos"]) for r in pos if r["y"] == y)
        assert [p for _, p in mine] == list(range(1, len(mine) + 1))
    f = sampling.stratified_folds(df, "id", "y", k=4, repeats=2).collect()
    assert len(f) == 1000
    for rep in (0, 1):
        for y in (0, 1):
            sizes = [sum(1 for r in f if r["rep"] == rep and r["y"] == y and r["fold"] == k) for k in range(4)]
            assert max(sizes) - min(sizes) <= 1


def _brute_mdl(values, labels):
    """Reference implementation of recursive Fayyad–Irani MDL on one feature."""
    import math

    def h(a, b):
        n = a + b
        return -sum((x / n) * math.log2(x / n) for x in (a, b) if x > 0) if n else 0.0

    def k(a, b):
        return (a > 0) + (b > 0)

    pts = sorted(zip(values, labels))
    distinct = sorted(set(values))
    cuts = []

    def split(lo, hi):  # values in (lo, hi]
        seg = [(v, y) for v, y in pts if (lo is None or v > lo) and (hi is None or v <= hi)]
        vals = sorted(set(v for v, _ in seg))
        t0 = sum(1 for _, y in seg if y == 0)
        t1 = len(seg) - t0
        best = None
        for c in vals[:-1]:
            l0 = sum(1 for v, y in seg if v <= c and y == 0)
            l1 = sum(1 for v, y in seg if v <= c and y == 1)
            r0, r1 = t0 - l0, t1 - l1
            n = len(seg)
            e = ((l0 + l1) * h(l0, l1) + (r0 + r1) * h(r0, r1)) / n
            if best is None or e < best[0]:
                best = (e, c, l0, l1, r0, r1)
        if best is None:
            return
        e, c, l0, l1, r0, r1 = best
        n = len(seg)
        delta = math.log2(3 ** k(t0, t1) - 2) - (k(t0, t1) * h(t0, t1) - k(l0, l1) * h(l0, l1) - k(r0, r1) * h(r0, r1))
        if h(t0, t1) - e > (math.log2(n - 1) + delta) / n:
            cuts.append(c)
            split(lo, c)
            split(c, hi)

    split(None, None)
    return sorted(cuts), distinct


def test_mdl_matches_brute_force(spark):
    rnd = random.Random(21)
    rows = []
    for i in range(400):
        x = rnd.randint(0, 30)
        y = int(rnd.random() < (0.1 if x < 10 else 0.5 if x < 20 else 0.9))
        rows.append((x, y))
    df = spark.createDataFrame(rows, "x int, y int")
    got = sorted(r["cut"] for r in stats.mdl_cuts(df, ["x"], "y").collect())
    want, _ = _brute_mdl([float(x) for x, _ in rows], [y for _, y in rows])
    assert got == want and len(want) >= 1
    ig = stats.info_gain_mdl(df, ["x"], "y").first()
    assert ig["n_bins"] == len(want) + 1 and ig["info_gain"] > 0


def test_mdl_cuts_a_chain_of_blocks_without_a_level_cap(spark):
    """40 alternating pure blocks of 40 rows need 39 cuts at depth 39."""
    rows = [(float(b * 40 + i), b % 2) for b in range(40) for i in range(40)]
    df = spark.createDataFrame(rows, "x double, y int")
    got = sorted(r["cut"] for r in stats.mdl_cuts(df, ["x"], "y").collect())
    assert got == sorted(_brute_mdl([x for x, _ in rows], [y for _, y in rows])[0]) and len(got) == 39
    small = df.filter("x < 200")  # the same rule by jobs, interval by interval
    by_jobs = sorted(r["cut"] for r in stats.mdl_discretize(small, ["x"], "y", local_values=45)[0].collect())
    assert by_jobs == sorted(r["cut"] for r in stats.mdl_cuts(small, ["x"], "y").collect()) and len(by_jobs) == 4


def test_one_bin_has_no_gain(spark):
    df = spark.createDataFrame([(float(i % 7), i % 2, "ab"[i % 2]) for i in range(98)], "x double, y int, g string")
    r = stats.info_gain_mdl(df, ["x"], "y").first()
    assert (r["n_bins"], r["info_gain"]) == (1, 0.0)


def test_spearman_by_group_equals_one_group_at_a_time(spark):
    rows = [(float((i * 7) % 13), float(i % 5), int((i * 7) % 13 > 5), f"p{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, y int, project string")
    got = {(r["project"], r["feature"]): (r["n"], round(r["spearman_rho"], 9)) for r in stats.spearman(df, ["a", "b"], "y", by="project").collect()}
    for p in ("p0", "p1", "p2"):
        for r in stats.spearman(df.filter(f"project = '{p}'"), ["a", "b"], "y").collect():
            assert got[p, r["feature"]] == (r["n"], round(r["spearman_rho"], 9))
    ranks = stats.feature_ranking(stats.spearman(df, ["a", "b"], "y", by="project"), by="project").collect()
    assert sorted((r["project"], r["rank"]) for r in ranks) == [(f"p{i}", k) for i in range(3) for k in (1, 2)]
