import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import fold_bayes, linediff, models
from faultline.operators.sampling import stratified_folds


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_edit_counts_against_the_table_of_all_pairs():
    r = random.Random(2)
    for i in range(300):
        letters = "ab" if i % 2 else "abcdefghijklmnop"
        a, b = ("".join(r.choice(letters) + "\n" for _ in range(r.randrange(160))) + r.choice(["", "end"]) for _ in range(2))
        if i % 3 == 0:
            b = a[:40] + b[:30] + a[60:]
        x, y = linediff.lines_of(a), linediff.lines_of(b)
        n = lcs(x, y)
        assert "".join(x) == a and linediff.edit_counts(a, b) == (len(y) - n, len(x) - n)


def test_moved_line_and_line_feed_at_the_end():
    assert linediff.edit_counts("a\nb\nc\n", "b\nc\na\n") == (1, 1)
    assert linediff.edit_counts("a\nb", "a\nb\n") == (1, 1)
    assert linediff.edit_counts("", "") == (0, 0) and linediff.edit_counts("", "x\n") == (1, 0) and linediff.edit_counts("x\n\n", "") == (0, 2)


def test_large_files_need_linear_memory():
    a = [f"{i * 7919 % 5000}\n" for i in range(20_000)]
    b = a[:9000] + a[10_000:] + ["new\n"] * 3
    assert linediff.edit_counts("".join(a), "".join(b)) == (3, 1000)


def test_line_diff_pairs(spark):
    rows = [("f", 1, "a\nb\n"), ("f", 3, "b\na\n"), ("f", 9, None), ("f", 12, "z\n"), ("f", 13, "z\nz\n"), ("g", 1, "x"), ("h", 5, None)]
    got = linediff.line_diff(spark.createDataFrame(rows, "path string, rev int, content string").repartition(3))
    assert sorted(map(tuple, got.collect())) == [("f", 3, 1, 1), ("f", 13, 1, 0)]
    assert linediff.line_diff(spark.createDataFrame([], "path string, rev int, content string")).count() == 0


def test_fold_models_equal_a_fit_per_fold(spark):
    r = random.Random(1)
    rows = [(str(i), 1e6 + r.gauss(0, 1), r.choice([None, 1.0, 2.0]), int(r.random() < 0.3)) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, a double, b double, buggy int")
    folds = stratified_folds(df, "id", "buggy", k=4, repeats=2).checkpoint(eager=True)
    got = {(p.rep, p.fold, p.id): p.score for p in fold_bayes.cross_validated(df, folds.drop("buggy"), ["a", "b"]).collect()}
    assert len(got) == 400
    full = folds.drop("buggy").join(df, "id")
    for rep, fold in ((0, 0), (1, 3)):
        own = full.filter(F.col("rep") == rep)
        model = models.gaussian_nb_fit(own.filter(F.col("fold") != fold), ["a", "b"])
        for p in models.gaussian_nb_score(own.filter((F.col("fold") == fold) & F.col("b").isNotNull()), model, ["a", "b"]).collect():
            assert got[rep, fold, p.id] == pytest.approx(p.score, abs=1e-7)


def test_one_class_and_no_rows(spark):
    df = spark.createDataFrame([(str(i), 1.0, 1) for i in range(6)], "id string, a double, buggy int")
    folds = df.select("id", F.lit(0).alias("rep"), (F.col("id").cast("int") % 2).alias("fold"))
    assert {p.score for p in fold_bayes.cross_validated(df, folds, ["a"]).collect()} == {1.0}
    none = df.filter("id = 'x'")
    assert fold_bayes.cross_validated(none, folds, ["a"]).count() == 0
