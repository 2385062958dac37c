import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import sampling


def brute(rows, folds, k, percent):
    """Synthetic rows by searching each training side anew."""
    mino = {i: v for i, v, y in rows if y == 1}
    own = {(i, rep): fold for i, rep, fold in folds}
    digest = lambda *p: hashlib.md5("-".join([*map(str, p), "42"]).encode()).hexdigest()
    out = []
    for rep, fold in sorted({(r, f) for _, r, f in folds}):
        side = sorted((i for i in mino if own[i, rep] != fold), key=lambda i: (digest(i), i))
        n = len(side)
        for j in range(math.floor(n * percent / 100) if n > 1 else 0):
            base = side[j % n]
            near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(mino[base], mino[o], strict=True))), o) for o in side if o != base)[:k]
            h = digest(base, j)
            u, gap = int(h[:8], 16) / 2**32, int(h[8:16], 16) / 2**32
            o = near[math.floor(u * len(near))][1]
            out.append((rep, fold, f"{base}~s{j}", base, o, *[round(a + gap * (b - a), 9) for a, b in zip(mino[base], mino[o], strict=True)]))
    return sorted(out)


@pytest.mark.parametrize("spare,percent", [(10, 65.0), (0, 65.0), (0, 230.0)])
def test_every_training_side(spark, spare, percent):
    r = random.Random(3)
    rows = [(f"r{i}", (float(r.randrange(9)), r.gauss(0, 3)), int(r.random() < 0.4)) for i in range(90)]
    folds = [(i, rep, r.randrange(3)) for i, _, _ in rows for rep in range(2)]
    df = spark.createDataFrame([(i, *v, y) for i, v, y in rows], "id string, a double, b double, buggy int")
    got = sampling.smote_rows(df, spark.createDataFrame(folds, "id string, rep int, fold int"), ["a", "b"], percent=percent, k=4, spare=spare)
    found = sorted((x.rep, x.fold, x.id, x.base, x.neighbour, round(x.a, 9), round(x.b, 9)) for x in got.collect())
    assert found == brute(rows, folds, 4, percent)


def test_few_or_no_minority_rows(spark):
    df = spark.createDataFrame([(str(i), float(i), int(i < 2)) for i in range(9)], "id string, a double, buggy int")
    folds = df.select("id", F.lit(0).alias("rep"), (F.col("id").cast("int") % 3).alias("fold"))
    got = sampling.smote_rows(df, folds, ["a"], percent=100.0).collect()
    assert {(x.fold, x.base, x.neighbour) for x in got} == {(2, "0", "1"), (2, "1", "0")}  # elsewhere one is left
    assert sampling.smote_rows(df.filter("buggy = 0"), folds, ["a"]).count() == 0
