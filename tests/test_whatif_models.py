import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import models, sampling, whatif


@pytest.fixture
def data(spark):
    rnd = random.Random(9)
    rows = [(f"m{i}", float(rnd.randint(0, 3)) if i % 17 else None, float(rnd.randint(1, 50)), int(rnd.random() < 0.3))
            for i in range(300)]
    return spark.createDataFrame(rows, "id string, nest double, loc double, buggy int")


def test_split_conserves_rows(spark, data):
    sets = whatif.tagged_sets(data, "nest")
    scored = sets.withColumn("pred", (F.coalesce(F.col("nest"), F.lit(0.0)) * 0.3 + F.col("loc") * 0.02 > 1).cast("int"))
    v = whatif.verdict(whatif.summary(scored)).first()
    assert v["rows_conserved"] and v["actual_conserved"] and v["predicted_conserved"]
    s = {r["dataset"]: r for r in whatif.summary(scored).collect()}
    assert s["B"]["actual"] is None and s["B"]["n_rows"] == s["B+"]["n_rows"]
    assert 0.0 <= v["avoided_share"] <= 1.0


def test_knn_exact_vs_brute_force(spark):
    rnd = random.Random(1)
    pts = [(f"p{i}", rnd.random(), rnd.random()) for i in range(120)]
    df = spark.createDataFrame(pts, "id string, x double, y double")
    nn = models.knn(df, df, ["x", "y"], "id", k=3, exclude_self=True).collect()
    got = {}
    for r in nn:
        got.setdefault(r["query_id"], []).append((r["nn_rank"], r["neighbor_id"]))
    for pid, x, y in pts:
        d = sorted(((((x - a) ** 2 + (y - b) ** 2) ** 0.5, q) for q, a, b in pts if q != pid))
        assert [n for _, n in sorted(got[pid])] == [q for _, q in d[:3]]


def test_gaussian_nb_separates(spark):
    rows = [(f"a{i}", float(i % 5), 0) for i in range(50)] + [(f"b{i}", 10.0 + i % 5, 1) for i in range(50)]
    df = spark.createDataFrame(rows, "id string, x double, buggy int")
    m = models.gaussian_nb_fit(df, ["x"], "buggy")
    s = models.gaussian_nb_score(df, m, ["x"])
    acc = s.select(F.avg((F.col("pred") == F.col("buggy")).cast("double"))).first()[0]
    assert acc == 1.0


def test_smote_counts(spark, data):
    d = data.fillna(0.0)
    out = sampling.smote(d, ["nest", "loc"], "buggy", "id", percent=65, k=3)
    n_min = d.filter("buggy = 1").count()
    syn = out.filter("synthetic")
    assert syn.count() == n_min * 65 // 100
    assert syn.filter("buggy != 1").count() == 0
    # Synthetic points lie inside the minority bounding box.
    lo, hi = d.filter("buggy = 1").agg(F.min("loc"), F.max("loc")).first()
    assert syn.filter((F.col("loc") < lo) | (F.col("loc") > hi)).count() == 0


def test_cross_validate_in_fold_and_leaky(spark, data):
    d = data.fillna(0.0)
    folds = sampling.stratified_folds(d, "id", "buggy", k=3, repeats=1)
    for leaky in (False, True):
        pred = models.cross_validate(d, folds, ["nest", "loc"], ["NaiveBayes"], smote_percent=50.0, leaky=leaky,
                                     parallelism=2)
        n = pred.count()
        assert (n == d.count()) if not leaky else (n > d.count())
        assert pred.filter((F.col("score") < 0) | (F.col("score") > 1)).count() == 0


def test_knn_training_side_is_bounded_but_every_query_is_scored(spark):
    pts = [(f"p{i:03}", float(i % 31), float(i % 17)) for i in range(200)]
    df = spark.createDataFrame(pts, "id string, x double, y double")
    nn = models.knn(df, df, ["x", "y"], "id", k=2, max_train=50).collect()
    assert len({r["query_id"] for r in nn}) == 200 and len({r["neighbor_id"] for r in nn}) <= 50


def test_smote_rows_equal_brute_force(spark, data):
    import hashlib
    d = data.fillna(0.0).filter("id < 'm2'")
    rows = [r for r in d.collect()]
    mino = sorted((r for r in rows if r["buggy"] == 1), key=lambda r: r["id"])
    feats = ["nest", "loc"]
    span = {f: (min(r[f] for r in mino), max(r[f] for r in mino)) for f in feats}
    scale = {r["id"]: [(r[f] - span[f][0]) / (span[f][1] - span[f][0]) for f in feats] for r in mino}
    md5 = lambda *x: hashlib.md5("-".join([*map(str, x), "42"]).encode()).hexdigest()
    order = sorted(mino, key=lambda r: (md5(r["id"]), r["id"]))
    want = {}
    for j in range(len(mino) * 65 // 100):
        a = order[j % len(order)]
        near = sorted((sum((p - q) ** 2 for p, q in zip(scale[a["id"]], scale[b["id"]])) ** 0.5, b["id"]) for b in mino if b is not a)[:3]
        h = md5(a["id"], j)
        b = next(r for r in mino if r["id"] == near[int(int(h[:8], 16) / 2**32 * 3) % len(near)][1])
        gap = int(h[8:16], 16) / 2**32
        want[f"{a['id']}~s{j}"] = tuple(round(a[f] + gap * (b[f] - a[f]), 9) for f in feats)
    got = {r["id"]: (round(r["nest"], 9), round(r["loc"], 9)) for r in sampling.smote(d, feats, "buggy", "id", percent=65, k=3).filter("synthetic").collect()}
    assert got == want and len(want) > 5


def test_neighbours_are_exact_beyond_the_rows_that_are_sent(spark):
    rnd = random.Random(3)
    pts = [(f"p{i:03}", rnd.choice([rnd.random(), rnd.randrange(4) / 4]), rnd.choice([rnd.random() ** 4, 0.5])) for i in range(300)]
    pts += [(f"q{i:03}", 0.25, 0.5) for i in range(40)]
    df = spark.createDataFrame(pts, "id string, x double, y double")
    want = {}
    for p, x, y in pts:
        d = sorted((((x - a) ** 2 + (y - b) ** 2) ** 0.5, q) for q, a, b in pts if q != p)
        want[p] = [q for _, q in d[:4]]
    got = {}
    for r in models.knn_exact(df, df, ["x", "y"], "id", k=4, exclude_self=True, whole=50, cell_rows=12).collect():
        got.setdefault(r["query_id"], {})[r["nn_rank"]] = r["neighbor_id"]
    assert {p: [n[i] for i in sorted(n)] for p, n in got.items()} == want


def test_smote_rows_do_not_hang_on_the_rows_that_are_sent(spark, data):
    d = data.fillna(0.0)
    made = [sorted(map(tuple, sampling.smote(d, ["nest", "loc"], "buggy", "id", percent=65, k=3, max_train=n).filter("synthetic").collect()))
            for n in (None, 8)]
    assert made[0] == made[1] and len(made[0]) > 5


def test_smote_returns_the_same_columns_on_every_path(spark):
    df = spark.createDataFrame([("a", 1.0, 9, 0), ("b", 2.0, 9, 0), ("c", 3.0, 9, 1)], "id string, x double, extra int, buggy int")
    for percent in (0.0, 65.0):
        assert sampling.smote(df, ["x"], "buggy", "id", percent=percent).columns == ["id", "x", "buggy", "synthetic"]
    assert sampling.smote(df.limit(0), ["x"], "buggy", "id").columns == ["id", "x", "buggy", "synthetic"]


def test_neighbours_in_factory_and_cv(spark, data):
    d = data.fillna(0.0).withColumn("project", F.when(F.col("loc") > 25, "P").otherwise("Q"))
    pred = models.cross_validate_by(d, "project", ["nest", "loc"], ["IBk", "NaiveBayes"], k=3, repeats=2, max_rows=100)
    got = {(r["project"], r["model"], r["rep"]): (r["n"], r["ids"]) for r in pred.groupBy("project", "model", "rep").agg(
        F.count("id").alias("n"), F.count_distinct("id").alias("ids")).collect()}
    want = {p: min(100, d.filter(f"project = '{p}'").count()) for p in "PQ"}
    assert got == {(p, m, r): (want[p], want[p]) for p in "PQ" for m in ("IBk", "NaiveBayes") for r in (0, 1)}
    assert pred.filter((F.col("score") < 0) | (F.col("score") > 1) | (F.col("pred") != F.col("score").__ge__(0.5).cast("int"))).count() == 0


def test_no_selected_feature_leaves_the_class_share(spark):
    df = spark.createDataFrame([(str(i), float(i % 7), i % 2) for i in range(98)], "id string, x double, label int")
    assert models.select_features(df, ["x"], "label", 0.0) == []
    m = models.build_classifier("RandomForest", []).fit(df)
    assert {(r["_positive"], r["prediction"]) for r in m.transform(df).collect()} == {(0.5, 1.0)}


def test_naive_bayes_of_one_and_three_classes(spark):
    df = spark.createDataFrame([(float(c * 10 + i % 3), c) for c in range(3) for i in range(30)], "x double, buggy int")
    m = models.gaussian_nb_fit(df, ["x"], "buggy")
    scored = models.gaussian_nb_score(df, m, ["x"]).groupBy("buggy").agg(F.min("score").alias("a"), F.max("score").alias("b")).collect()
    got = {r["buggy"]: (round(r["a"], 3), round(r["b"], 3)) for r in scored}
    assert got == {0: (0.0, 0.0), 1: (1.0, 1.0), 2: (0.0, 0.0)}
    for c, want in ((1, 1.0), (0, 0.0)):
        one = df.filter(f"buggy = {c}")
        assert {r["score"] for r in models.gaussian_nb_score(one, models.gaussian_nb_fit(one, ["x"], "buggy"), ["x"]).collect()} == {want}


@pytest.mark.parametrize("dims", [2, 9])
def test_blocks_find_the_least_pairs_and_skip_far_ones(dims, monkeypatch):
    r = np.random.default_rng(4)
    p = np.unique(np.r_[r.random((900, dims)), r.integers(0, 3, (300, dims)) / 2], axis=0)
    q = np.r_[p[::2], r.random((30, dims))]
    ids = [[f"{i % 7}-{i}-{j}" for j in range(1 + i % 3)] for i in range(len(p))]
    seen = []
    plain = models._distances
    monkeypatch.setattr(models, "BLOCK_ROWS", 32)
    monkeypatch.setattr(models, "_distances", lambda a, b: seen.append(len(a) * len(b)) or plain(a, b))
    for bound in (np.inf, 0.2):
        got = {}
        for rows, d, i in models._nearest(q, np.full(len(q), bound), p, ids, 5):
            for a, b, c in zip(rows, d, i, strict=True):
                got.setdefault(a, []).append((b, c))
        d = plain(q, p)
        want = {a: sorted((d[a, c], i) for c in range(len(p)) if d[a, c] <= bound for i in ids[c])[:5] for a in range(len(q))}
        assert {a: x for a, x in want.items() if x} == got
    assert max(seen) <= models.BLOCK_ROWS ** 2 and (dims > 2 or sum(seen) < 2 * d.size * 0.9)


def test_neighbours_in_many_dimensions_by_cells(spark):
    r = np.random.default_rng(5)
    pts = [(f"p{i:03}", [float(x) for x in v]) for i, v in enumerate(r.random((260, 12)))]
    df = spark.createDataFrame(pts, "id string, v array<double>")
    got = {}
    for x in models.knn_exact(df, df, "v", "id", k=3, exclude_self=True, whole=50, cell_rows=20).collect():
        got.setdefault(x["query_id"], {})[x["nn_rank"]] = x["neighbor_id"]
    v = np.array([x for _, x in pts])
    d = models._distances(v, v)
    np.fill_diagonal(d, np.inf)
    assert {p: [n[i] for i in sorted(n)] for p, n in got.items()} == {pts[i][0]: [pts[j][0] for j in np.argsort(d[i])[:3]] for i in range(len(v))}


def test_knn_classifier_searches_all_training_rows(spark):
    rows = spark.range(models.MAX_TRAIN + 4_000).selectExpr("string(id) AS id", "double(id) AS x", "double(id % 2) AS label")
    asked = rows.filter("id % 80 = 1 OR id % 80 = 2").select("id", "x", F.col("label").alias("want"))
    got = models.build_classifier("IBk", ["x"]).fit(rows).transform(asked).select("want", "prediction", "_positive").collect()
    assert len(got) == 600 and all(r.prediction == r.want and abs(r._positive - r.want) < 0.1 for r in got)  # each meets itself
