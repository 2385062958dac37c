import math
import random

import pytest
from pyspark.sql import functions as F

from faultline.llm import queries, topk

@pytest.fixture
def few_buckets(monkeypatch):
    monkeypatch.setattr(topk, "LEAST_BUCKETS", 5)


SCHEMA = "vec_id long, embedding array<double>, label int, bucket string, id string, reach int"


def brute(rows, k=5):
    whole = []
    for i, (vec_id, v, *_) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, vec_id, [math.floor(256 * x) for x in v]))
    out = []
    for i, q, a in whole:
        if q is not None and q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), c is None, c or 0) for j, c, b in whole if j != i)
            out += [(q, r, None if none else c, -s) for r, (s, none, c) in enumerate(scores[:k], 1)]
    return out


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def vectors(seed, n, kind):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        v = [r.gauss(0, 1) for _ in range(8)]
        if kind == "lengths":
            s = math.exp(r.gauss(0, 2))
            v = [x * s for x in v]
        elif kind == "close":  # cosines near 1: coordinates prune
            base = [[1, 0.2, 0, 0, 0, 0, 0, 0], [0, 0, 0, 1, -1, 0, 0.5, 0]][i % 2]
            v = [a + r.gauss(0, 0.02) for a in base]
        elif kind == "copies":
            v = [float(i % 3), 1.0, -0.5, 0.0, 0.0, 0.0, 0.0, 0.25]
        rows.append((i * 10, v, 1, "b", "x", 1))
    return rows


@pytest.mark.parametrize("kind", ["plain", "lengths", "close", "copies"])
def test_equals_brute_force(spark, kind, few_buckets):
    rows = vectors(kind, 900, kind)
    got = topk.search(spark.createDataFrame(rows, SCHEMA), F.col("id") % 50 == 0)
    assert found(got) == sorted(brute(rows), key=str)


def test_odd_rows(spark, few_buckets):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [-1.0, 0.5]), (None, [1.0, 2.0]), (50, None), (100, [nan, 1.0]), (150, [None, 1.0]),
            (200, [inf, 0.0]), (250, []), (-50, [0.1, 0.2, 0.3]), (300, [0.0, 0.0]), (7, [1e10, -1e10]), (8, [3.0]), (9, [-2.0, 4.0, 1.0])]
    rows = [(i, v, None, "b", "x", 1) for i, v in rows]
    got = topk.search(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("id") % 50 == 0)
    assert found(got) == sorted(brute(rows), key=str)
    assert topk.search(spark.createDataFrame(rows[:1], SCHEMA), F.col("id") % 50 == 0).count() == 0  # no other row
    assert topk.search(spark.createDataFrame([], SCHEMA), F.col("id") % 50 == 0).count() == 0


def test_scores_beyond_doubles(spark, few_buckets):
    rows = [(i, [2.0**20 + i, 3.0 * 2**19, float(i)], None, "b", "x", 1) for i in range(0, 60, 2)]
    got = topk.search(spark.createDataFrame(rows, SCHEMA), F.col("id") % 50 == 0)
    assert found(got) == sorted(brute(rows), key=str)


def test_coordinates_rule_out_what_is_far():
    import numpy as np

    r = np.random.default_rng(1)
    v = np.floor(256 * (np.array([[1, 0.5, 0, 0], [0.4, 0, 1, 0]])[np.arange(500) % 2] + r.normal(0, 0.03, (500, 4))))
    bucket = topk.Bucket(np.arange(500), np.arange(500), np.zeros(500, bool), v, np.sqrt((v**2).sum(axis=1)))
    q, length = v[:1], np.sqrt((v[:1]**2).sum(axis=1))
    score = np.sort(v @ q[0])[-6]
    few = bucket.by_angle(q[0], length[0], score / (length[0] * bucket.length[0]))
    assert 5 <= len(few) <= 250 and set(np.flatnonzero(bucket.m @ q[0] >= score)) <= set(few.tolist())


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = queries.op13_topk(spark, sf)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert found(got) == sorted(brute(rows), key=str)
