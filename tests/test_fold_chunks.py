import random
from collections import Counter

import pytest

from faultline import session
from faultline.operators import evaluation, fold_bayes, fold_chunks, sampling

from test_folded_rows import brute_folds


@pytest.fixture
def small(monkeypatch):
    for name, n in (("CHUNK_ROWS", 20), ("RANGE_ROWS", 17), ("WAVE_ROWS", 400), ("FILE_CHUNKS", 2)):
        monkeypatch.setattr(fold_chunks, name, n)


@pytest.fixture
def rows():
    r = random.Random(2)
    x = [(f"r{i}", i % 3 % 2, r.choice([None, 1.0, 2.0, 3.0]), r.gauss(0, 1)) for i in range(150)]
    return x + [(None, 1, 5.0, 1.0), (None, 0, 6.0, 2.0), ("r7", 0, 70.0, 0.0), ("r7", 1, 71.0, 0.0), ("r8", None, 80.0, 1.0), ("x", None, 1.0, 1.0)]


def test_folds_by_chunks_and_ranges(spark, rows, small):
    df = spark.createDataFrame(rows, "id string, buggy int, a double, b double").repartition(3)
    got = sampling.stratified_folds(df, "id", "buggy", k=4, repeats=3)
    assert Counter(map(tuple, got.select("id", "buggy", "rep", "fold").collect())) == Counter(brute_folds(rows, 4, 3))
    none = sampling.stratified_folds(df.filter("id = '?'"), "id", "buggy", k=4, repeats=3)
    assert none.count() == 0 and none.columns == ["id", "buggy", "rep", "fold"]


def test_rows_of_equal_leading_bytes_are_told_apart(spark, monkeypatch):
    plain = fold_chunks._digests
    monkeypatch.setattr(fold_chunks, "_digests", lambda *a: plain(*a) & [[0xF << 60, 2**64 - 1]])
    rows = [(i, 0) for i in range(50)]
    first = sorted(rows, key=lambda r: tuple(plain([str(r[0]).encode()], 0, 42)[0] & [0xF << 60, 2**64 - 1]))
    got = {r.id: r.fold for r in sampling.stratified_folds(spark.createDataFrame(rows, "id int, buggy int"), "id", "buggy", k=3).collect()}
    assert got == {i: n % 3 for n, (i, _) in enumerate(first)}


@pytest.mark.parametrize("features", [["a", "b"], ["a"]])
def test_measures_by_chunks_equal_those_of_folded_rows(spark, rows, small, features):
    df = spark.createDataFrame(rows, "id string, buggy int, a double, b double").repartition(3)
    how = {"id_col": "id", "label": "buggy", "k": 4, "repeats": 3}
    found = [evaluation.fold_metrics(fold_bayes.cross_validated_rows(f(df, **how), features)).collect() for f in (sampling.folded_rows, sampling.folded_chunks)]
    plain = [sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in t) for t in found]
    assert plain[0] == plain[1] and len(plain[0]) == 12


def test_rows_are_not_stored_once_a_repetition(spark, monkeypatch):
    from faultline.plans import catalog

    r = random.Random(4)
    rows = [(str(i), i % 2, *[r.gauss(i % 2, 1) for _ in catalog.NB_FEATURES]) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, buggy int, " + ", ".join(f"{f} double" for f in catalog.NB_FEATURES))
    stored = {}
    monkeypatch.setattr(catalog, "_rows", lambda *_: df)
    monkeypatch.setattr(session, "on_store", lambda name, x: stored.update({name: x.count()}))
    assert catalog.q_nb_cv_10x10(spark, "/root/testdata/sf0.001").count() == 100
    assert stored and max(stored.values()) < 1000


def test_no_rows_and_one_class(spark):
    df = spark.createDataFrame([(str(i), 1, 1.0) for i in range(6)], "id string, buggy int, a double")
    for x, n in ((df, 2), (df.filter("id = 'x'"), 0)):
        m = evaluation.fold_metrics(fold_bayes.cross_validated_rows(sampling.folded_chunks(x, k=2), ["a"])).collect()
        assert len(m) == n and all(r.recall == 1 and r.npofb20 == pytest.approx(1 / 3) and r.auc != r.auc for r in m)
