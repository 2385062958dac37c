"""Exact top-k search by integer inner product over buckets of equal length.

Vectors are sorted by Euclidean length and cut into buckets.  With ``t`` the
k-th best score a query is known to reach, a bucket whose longest vector has
length ``m`` holds a better one only if some of its vectors have a cosine of
at least ``t / (|q| m)`` with the query: the bucket's local threshold.  Above
1 the query never goes there.  Else the threshold picks the pruning:

* at ``COORD_FROM`` or more, by coordinates: a vector within the angle
  ``arccos(threshold)`` of the query has each coordinate within that angle of
  the query's.  Sorted lists of the coordinates where the query is largest
  give the few vectors inside all these ranges;
* below, by length: the bucket is sorted, and only vectors of at least
  ``t / |q|`` are multiplied, as one matrix product for a block of queries.

What is left is verified by the product itself, in whole numbers.

A query first visits one of the buckets of the longest vectors, dealt by hash;
this gives its threshold.  Then it goes to every bucket that may hold more.
Tasks hold one bucket (about ``BUCKET_ROWS`` vectors) and stream the queries,
so no number of queries, equal lengths or equal vectors fills one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hints import broadcast_if_small
from ..session import materialize

K = 5
BUCKET_ROWS = 65_536
LEAST_BUCKETS = 32
#: Queries first go to one of this part of the buckets, those of the longest vectors.
FIRST_PART = 8
#: Local cosine threshold from which coordinates prune.
COORD_FROM = 0.9
#: Coordinates whose ranges are tested.
FOCUS = 6
#: Scores of a block of queries held at once.
SCORES = 4_000_000
#: Room for rounding in bounds; the verified products are whole numbers.
SLACK = 1e-9
LONG = 2**63 - 1


# --- vectors ---------------------------------------------------------------

def scaled(rows: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(rid, id, v, len): ``floor(scale * x)`` of every component and the length
    of the result, without the vectors that are null or hold a null or
    non-finite component.  ``rid`` tells rows of one id apart."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def work(batches):
        for batch in batches:
            lists = batch.column(2)
            size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = np.floor(scale * lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
            end = np.cumsum(size)
            bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
            good = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[end] == bad[end - size])
            length = np.sqrt(np.bincount(np.repeat(np.arange(len(size)), size), np.where(np.isfinite(flat), flat, 0.0) ** 2, len(size)))
            keep = pa.array(good)
            v = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size[good])].astype(np.int32)), pa.array(flat[np.repeat(good, size)]))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), v, pa.array(length[good])],
                                             names=["rid", "id", "v", "len"])

    slim = rows.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("v"))
    return slim.mapInArrow(work, "rid long, id long, v array<double>, len double")


def matrix(lists, width: int = 0) -> np.ndarray:
    """Rows of an Arrow list column; missing components are zero."""
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = max(width, int(size.max(initial=0)))
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.repeat(np.arange(len(size)), size), np.concatenate([np.arange(n) for n in size])] = flat
    return out


def widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


# --- one bucket ------------------------------------------------------------

class Bucket:
    """The vectors of one bucket, longest first."""

    def __init__(self, rid, ids, no_id, vectors, length):
        order = np.argsort(-length, kind="stable")
        self.rid, self.ids, self.no_id, self.m, self.length = rid[order], ids[order], no_id[order], vectors[order], length[order]
        self.by_coordinate: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def widen(self, width: int) -> None:
        self.m = widened(self.m, width)

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted coordinate ``f`` of the vectors scaled to length 1, and whose it is."""
        if f not in self.by_coordinate:
            with np.errstate(invalid="ignore", divide="ignore"):
                x = np.where(self.length > 0, self.m[:, f] / self.length, np.nan)
            order = np.argsort(x, kind="stable")  # NaN of zero vectors last
            self.by_coordinate[f] = x[order], order
        return self.by_coordinate[f]

    def products(self, q: np.ndarray, rows) -> np.ndarray:
        """Inner products in whole numbers, as floats where these are exact."""
        p = self.m[rows]
        if not p.size or np.abs(q).max(initial=0) * np.abs(p).max(initial=0) * max(1, p.shape[1]) < 2**53:
            return q @ p.T
        whole = np.frompyfunc(int, 1, 1)
        return whole(q) @ whole(p).T

    def by_angle(self, q: np.ndarray, length: float, cosine: float) -> np.ndarray:
        """Rows that can have at least this cosine with ``q``, by the coordinates where ``q`` is largest."""
        unit = q / length
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        beta = np.arccos(min(1.0, cosine))
        alpha = np.arccos(np.clip(unit[focus], -1, 1))
        low = np.cos(np.minimum(np.pi, alpha + beta)) - SLACK
        high = np.cos(np.maximum(0, alpha - beta)) + SLACK
        spans = []
        for f, a, b in zip(focus.tolist(), low, high, strict=True):
            x, order = self.coordinate(f)
            spans.append((np.searchsorted(x, a, "left"), np.searchsorted(x, b, "right"), order))
        i, j, order = min(spans, key=lambda s: s[1] - s[0])
        rows = order[i:j]
        with np.errstate(invalid="ignore", divide="ignore"):
            near = self.m[np.ix_(rows, focus)] / self.length[rows, None]
        return rows[((near >= low) & (near <= high)).all(axis=1)]

    def best(self, q: np.ndarray, rid: np.ndarray, length: np.ndarray, reach: np.ndarray, k: int):
        """(query row, bucket row, score) of the ``k`` best of each query that reach ``reach``."""
        low = np.where(np.isfinite(reach), reach - np.abs(reach) * SLACK, -np.inf)
        most = length * (self.length[0] if len(self.length) else 0.0)
        with np.errstate(invalid="ignore", divide="ignore"):
            cosine = np.where((low > 0) & (most > 0), low / most, 0.0) * (1 - SLACK)
        for i in np.flatnonzero((cosine >= COORD_FROM) & (cosine <= 1)).tolist():
            rows = self.by_angle(q[i], length[i], cosine[i])
            score = self.products(q[i:i + 1], rows)[0]
            yield self.top(np.full(len(rows), i), rows, score, low, rid, k)
        plain = np.flatnonzero(cosine < COORD_FROM)
        for at in range(0, len(plain), step := max(1, SCORES // max(1, len(self.length)))):
            some = plain[at:at + step]
            with np.errstate(invalid="ignore", divide="ignore"):
                shortest = np.where((low[some] > 0) & (length[some] > 0), low[some] / length[some] * (1 - SLACK), -1.0)
            upto = int(np.searchsorted(-self.length, -shortest.min(), "right"))
            score = self.products(q[some], slice(0, upto))
            # k + 1: the query's own row may be one of them
            bound = np.maximum(low[some], np.partition(score, upto - k - 1, axis=1)[:, upto - k - 1].astype(float) if upto > k + 1 else -np.inf)
            i, rows = np.nonzero(score >= (bound - np.abs(np.where(np.isfinite(bound), bound, 0)) * SLACK)[:, None])
            yield self.top(some[i], rows, score[i, rows], low, rid, k)

    def top(self, i, rows, score, low, rid, k):
        keep = (score >= low[i]) & (self.rid[rows] != rid[i])
        i, rows, score = i[keep], rows[keep], score[keep]
        order = np.lexsort((self.rid[rows], self.ids[rows], self.no_id[rows], -score, i))
        i, rows, score = i[order], rows[order], score[order]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.empty(0, np.int64)
        place = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
        return i[place < k], rows[place < k], score[place < k]


def scan(batches, k: int):
    """Arrow batches sorted by (bucket, kind): vectors (kind 0), then the queries
    sent to the bucket (kind 1); out go each query's best ``k`` of the bucket."""
    import pyarrow as pa

    now, held, bucket = None, [], None
    for batch in batches:
        at, kind = (batch.column(i).to_numpy() for i in (0, 1))
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if at[a] != now:
                now, held, bucket = at[a], [], None
            if kind[a] == 0:
                held.append(part)
                continue
            if not held:
                continue  # an empty bucket
            if bucket is None:
                width = max(int(np.diff(p.column(4).offsets.to_numpy()).max(initial=0)) for p in held)
                ids = [p.column(3) for p in held]
                bucket = Bucket(np.concatenate([p.column(2).to_numpy() for p in held]),
                                np.concatenate([c.fill_null(0).to_numpy() for c in ids]),
                                np.concatenate([c.is_null().to_numpy(zero_copy_only=False) for c in ids]),
                                np.concatenate([matrix(p.column(4), width) for p in held]),
                                np.concatenate([p.column(5).to_numpy() for p in held]))
            q = matrix(part.column(4), bucket.m.shape[1])
            bucket.widen(q.shape[1])
            rid, length, reach = (part.column(i).to_numpy(zero_copy_only=False) for i in (2, 5, 6))
            for i, rows, score in bucket.best(q, rid, length, np.nan_to_num(reach, nan=-np.inf, neginf=-np.inf), k):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[i]), part.column(3).take(pa.array(i)), pa.array(bucket.rid[rows]),
                     pa.array(bucket.ids[rows], mask=bucket.no_id[rows]),
                     pa.array([max(-LONG - 1, min(LONG, int(s))) for s in score.tolist()], pa.int64())],
                    names=["query_rid", "query_id", "rid", "vec_id", "score"])


# --- the search ------------------------------------------------------------

def visit(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Best ``k`` of each (query, bucket) of ``queries``, which carry ``bucket`` and ``reach``."""
    columns = ["bucket", "kind", "rid", "id", "v", "len", "reach"]
    both = vectors.withColumns({"kind": F.lit(0), "reach": F.lit(None).cast("double")}).select(*columns).unionByName(
        queries.withColumn("kind", F.lit(1)).select(*columns))
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(max(n, LEAST_BUCKETS), "bucket").sortWithinPartitions("bucket", "kind")
    return dealt.mapInArrow(lambda batches: scan(batches, k), "query_rid long, query_id long, rid long, vec_id long, score long")


def search(rows: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest inner product
    with each row that ``queries`` (a condition on ``id``) selects, the row
    itself aside; fewer if there are fewer; ties to the smaller id.

    Components x count as ``floor(scale * x)``.  Vectors that are null or hold
    a null or non-finite component take no part, neither as query nor as
    candidate; a vector of no components scores 0, and of vectors of unequal
    size the missing components are 0.  Rows that share an id are rows of
    their own: each is a query, and each other's candidate.  A null id is no
    query; as a candidate it comes last among ties.  Scores beyond 64 bits are
    clamped.  An empty table gives no rows; other columns are ignored.
    """
    vectors = materialize(scaled(rows, id_col, vec_col, scale), "vectors")
    n = max(LEAST_BUCKETS, -(-vectors.count() // BUCKET_ROWS))
    # Equal lengths are cut by row, so that no bucket grows with them.
    dealt = vectors.repartitionByRange(n, F.col("len").desc(), F.col("rid")).withColumn("bucket", F.spark_partition_id())
    vectors = materialize(dealt, "buckets")
    longest = materialize(vectors.groupBy("bucket").agg(F.max("len").alias("longest")), "bucket_lengths")

    first = max(1, n // FIRST_PART)
    asked = materialize(vectors.filter(queries).withColumn("home", F.pmod(F.xxhash64("rid"), F.lit(first)).cast("int")).drop("bucket"), "queries")
    home = materialize(visit(vectors.filter(F.col("bucket") < first), asked.withColumn("bucket", F.col("home")).withColumn("reach", F.lit(None).cast("double")), k), "first_visit")
    reach = home.groupBy("query_rid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("reach"))
    last = longest.agg(F.max("bucket").alias("last")).first()["last"]
    far = asked.join(reach, asked["rid"] == reach["query_rid"], "left").drop("query_rid")
    far = far.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(last or 0)))).filter("bucket <> home")
    far = far.join(broadcast_if_small(longest), "bucket").filter(
        F.col("reach").isNull() | (F.col("len") * F.col("longest") * (1 + SLACK) >= F.col("reach") - F.abs("reach") * SLACK))
    found = home.unionByName(visit(vectors, far, k))
    rank = F.row_number().over(Window.partitionBy("query_rid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "rid"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
