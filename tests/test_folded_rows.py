import hashlib
from collections import Counter

import pytest

from faultline.operators import evaluation, fold_bayes, sampling
from faultline.plans import catalog


def brute_folds(rows, k, repeats, seed=42):
    """(id, label, rep, fold) of rows (id, label, ...), label not null."""
    out = []
    for rep in range(repeats):
        for label in {r[1] for r in rows if r[1] is not None}:
            own = sorted((hashlib.md5("-".join([*([] if r[0] is None else [r[0]]), str(rep), str(seed)]).encode()).hexdigest(), r[0] or "", r[0]) for r in rows if r[1] == label)
            out += [(i, label, rep, n % k) for n, (_, _, i) in enumerate(own)]
    return out


@pytest.fixture
def rows():
    x = [(f"r{i}", i % 3 % 2, float(i)) for i in range(300)]
    return x + [(None, 1, 5.0), (None, 0, 6.0), (None, 1, 7.0), ("r7", 0, 70.0), ("r7", 1, 71.0), ("r8", None, 80.0), ("x", None, 1.0)]


def test_folds_are_dealt_in_hash_order_within_buckets(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, "id string, buggy int, a double").repartition(3)
    want = Counter(brute_folds(rows, 4, 2))
    for digits in (0, 1, 3):  # one bucket, some, more than rows
        monkeypatch.setattr(sampling, "BUCKET_DIGITS", digits)
        got = sampling.stratified_folds(df, "id", "buggy", k=4, repeats=2)
        assert Counter(map(tuple, got.select("id", "buggy", "rep", "fold").collect())) == want


def test_folds_shuffle_the_rows_once_and_sort_no_range(spark, rows):
    df = spark.createDataFrame(rows, "id string, buggy int, a double")
    plan = sampling.stratified_folds(df, "id", "buggy", k=4, repeats=2)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "ExistingRDD[rep" not in plan


def test_folded_rows_equal_a_join_by_id(spark, rows):
    df = spark.createDataFrame(rows, "id string, buggy int, a double").repartition(2)
    got = Counter(map(tuple, sampling.folded_rows(df, "id", "buggy", k=4, repeats=2).select("rep", "fold", "id", "buggy", "a").collect()))
    want = Counter((rep, fold, i, r[1], r[2]) for i, _, rep, fold in brute_folds(rows, 4, 2) if i is not None for r in rows if r[0] == i)
    assert got == want
    assert sampling.folded_rows(df.filter("id = '?'"), "id", "buggy", k=4, repeats=2).count() == 0


def test_folded_rows_by_project(spark):
    rows = [(f"r{i}", "pq"[i % 2], i % 3 % 2, float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "id string, Project string, buggy int, LOC double")
    got = {(r.rep, r.id): r.fold for r in sampling.folded_rows(df, "id", "buggy", k=5, repeats=2, by="Project").collect()}
    for p in "pq":
        for i, _, rep, fold in brute_folds([(r[0], r[2]) for r in rows if r[1] == p], 5, 2):
            assert got.pop((rep, i)) == fold
    assert not got


def test_models_are_scored_without_a_join_by_id(spark, rows):
    df = spark.createDataFrame([r for r in rows if r[1] is not None], "id string, buggy int, a double")
    folds = sampling.stratified_folds(df, "id", "buggy", k=3, repeats=2).drop("buggy").checkpoint(eager=True)
    old = fold_bayes.cross_validated(df, folds, ["a"])
    new = fold_bayes.cross_validated_rows(sampling.folded_rows(df, "id", "buggy", k=3, repeats=2), ["a"])
    key = lambda p: (p.rep, p.fold, p.id, p.label, round(p.score, 9), p.pred)
    assert Counter(map(key, old.collect())) == Counter(map(key, new.collect()))


def test_rule_models_score_each_row_once(spark):
    df = spark.createDataFrame([(0, 1, "a", 1, 40.0, 7.0), (1, 0, "b", 0, 10.0, None)], "rep int, fold int, id string, buggy int, LOC double, NestingDepth double")
    got = sorted(map(tuple, catalog._rule_scored(df).collect()), key=str)
    assert [r[:5] for r in got] == [(m, rep, fold, i, y) for m in ("rule_loc", "rule_mix", "rule_nest") for rep, fold, i, y in ((0, 1, "a", 1), (1, 0, "b", 0))]
    assert [r[6] for r in got] == [1, 0, 1, None, 1, None]


def test_missing_scores_count_before_all_others(spark):
    rows = [("m", 0, 0, str(i), i % 2, None if i < 4 else float(i // 3), int(i > 9)) for i in range(20)]
    pred = spark.createDataFrame(rows, "model string, rep int, fold int, id string, label int, score double, pred int")
    x = evaluation.fold_metrics(pred).first()
    ranks = {s: 4 + sum(r[5] < s for r in rows[4:]) + (sum(r[5] == s for r in rows[4:]) + 1) / 2 for s in {r[5] for r in rows[4:]}}
    assert x.auc == pytest.approx((sum(ranks[r[5]] for r in rows[4:] if r[4]) - 55) / 100)
    assert x.npofb20 == 0.2  # the four best rows, ties by id: 19, 18 and, of 15 to 17, 15 and 16
