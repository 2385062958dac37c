"""Fold assignment, downsampling, SMOTE (W-10, W-11, M-3, M-4, U-6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hints import broadcast_if_small
from ..session import materialize


def row_positions(df: DataFrame, group: list[str], order: list[Column | str],
                  partitions: int | None = None, broadcast_offsets: bool = True) -> DataFrame:
    """Exact ``row_number()`` within ``group`` by ``order`` (``_pos``, 1-based),
    without one window over a whole group.

    One range shuffle on (group, order) with a sort inside each partition;
    ``monotonically_increasing_id`` then numbers rows in partition order.  A
    (group, partition) count/min table — groups × partitions rows, bounded by
    configuration, broadcast — gives each group's offset in the earlier
    partitions; position = offset + index − first index of the group in the
    partition + 1.  A group holding a third of the data is spread over many
    tasks, and the data is shuffled once.  ``broadcast_offsets=False`` when
    the number of groups grows with the data (e.g. one group per file).
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    # Stored once, by columns: later reads must see the same range bounds and order.
    h = materialize(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                    .withColumn("_mid", F.monotonically_increasing_id()), "row_positions")
    h = h.withColumn("_pid", F.shiftright("_mid", 33)).withColumn("_idx", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    tot = h.groupBy(*group, "_pid").agg(F.count(F.lit(1)).alias("_t"), F.min("_idx").alias("_first"))
    w_off = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*group, "_pid", "_first", F.coalesce(F.sum("_t").over(w_off), F.lit(0)).alias("_off"))
    x = h.join(F.broadcast(off) if broadcast_offsets else off, [*group, "_pid"])
    return (x.withColumn("_pos", F.col("_off") + F.col("_idx") - F.col("_first") + 1)
            .drop("_mid", "_pid", "_idx", "_first", "_off"))


def seeded_hash(*cols: str | Column, seed: int = 42) -> Column:
    """md5 of the values and the seed: a reproducible shuffle key (same in SQL)."""
    return F.md5(F.concat_ws("-", *[F.col(c) if isinstance(c, str) else c for c in cols], F.lit(str(seed))))


#: Leading hex digits of a hash that number its bucket: 4,096 of about equal size.
BUCKET_DIGITS = 3


def _dealt(x: DataFrame, id_col: str, label: str, keep: list[str], k: int, seed: int) -> DataFrame:
    """``x`` with its ``fold``: the rows of each (``keep``, rep, label) in the order
    of md5(id, rep, seed), then id, dealt round-robin.

    The hash is uniform, so its first digits are buckets in order: one aggregate
    counts the rows of each bucket, and a window numbers the rows of one bucket.
    Rows shuffle once, with the bucket only; the hash is taken again behind it."""
    group = [*keep, "rep", label]
    x = x.withColumn("_b", F.substring(seeded_hash(id_col, "rep", seed=seed), 1, BUCKET_DIGITS))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = x.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    off = sizes.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # Groups x buckets rows: bounded by configuration but for the values of ``keep``.
    off = F.broadcast(off) if not keep else broadcast_if_small(materialize(off, "fold_offsets"))
    within = Window.partitionBy(*group, "_b").orderBy("_h", id_col)
    x = x.repartition(*group, "_b").withColumn("_h", F.unhex(seeded_hash(id_col, "rep", seed=seed)))
    x = x.withColumn("_pos", F.row_number().over(within)).drop("_h").join(off, [*group, "_b"])
    return x.withColumn("fold", ((F.col("_off") + F.col("_pos") - 1) % k).cast("int")).drop("_b", "_pos", "_off")


def _repeated(df: DataFrame, repeats: int) -> DataFrame:
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))


def stratified_folds(df: DataFrame, id_col: str = "id", label: str = "buggy", k: int = 10,
                     repeats: int = 1, seed: int = 42, by: str | None = None) -> DataFrame:
    """W-11: (by, id, label, rep, fold).  For each repetition rows of each class
    (of each value of ``by`` if given) are shuffled by md5(id, rep, seed) and
    dealt round-robin to the k folds, so fold sizes differ by at most one per
    class."""
    from .fold_chunks import fold_rows

    keep = [by] if by else []
    return fold_rows(df.select(*keep, id_col, label), id_col, [*keep, label], k, repeats, seed).select(*keep, id_col, label, "rep", "fold")


def folded_rows(df: DataFrame, id_col: str = "id", label: str = "buggy", k: int = 10,
                repeats: int = 1, seed: int = 42, by: str | None = None) -> DataFrame:
    """(rep, fold, columns of ``df``): ``df`` joined by id to its
    :func:`stratified_folds`, stored.  The columns travel with the rows that are
    dealt, so the folds of all repetitions are not shuffled a second time.  Rows
    of one id meet each other, as in a join; rows without an id are dealt, but
    meet none."""
    keep = [by] if by else []
    rest = [c for c in df.columns if c != id_col]
    some = df.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.collect_list(F.struct(*rest)).alias("_all"))  # rows of one id, mostly one
    some = some.select(id_col, F.explode("_all").alias("_own"), "_all").select(id_col, *[F.col("_own")[c].alias(c) for c in [*keep, label]], "_all")
    none = df.filter(F.col(id_col).isNull()).select(id_col, *keep, label)
    # Stored: buckets are counted first, then the rows are dealt.
    x = _repeated(materialize(some.unionByName(none, allowMissingColumns=True), "rows_by_id"), repeats)
    x = _dealt(x, id_col, label, keep, k, seed).select(id_col, "rep", "fold", F.explode("_all").alias("_row"))
    return materialize(x.select("rep", "fold", id_col, *[F.col("_row")[c].alias(c) for c in rest]), "folded_rows")


def folded_chunks(df: DataFrame, id_col: str = "id", label: str = "buggy", k: int = 10, repeats: int = 1, seed: int = 42):
    """:func:`folded_rows` with each row stored once, with its folds of all
    repetitions (:class:`.fold_chunks.FoldedChunks`)."""
    from .fold_chunks import FoldedChunks

    return FoldedChunks(df, id_col, label, k, repeats, seed)


def downsample(df: DataFrame, n: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """W-10 / M-4: a seeded uniform sample of exactly ``n`` rows (top-n by md5;
    the limit is the operator itself)."""
    return df.orderBy(seeded_hash(id_col, seed=seed), F.col(id_col)).limit(n)


def smote(df: DataFrame, features: list[str], label: str = "buggy", id_col: str = "id",
          percent: float = 65.0, k: int = 5, seed: int = 42, minority=None,
          max_train: int | None = None) -> DataFrame:
    """M-3 / U-6: SMOTE (Chawla et al. 2002) on the minority class.

    ``floor(n_min · percent / 100)`` synthetic rows are made; each picks one
    minority row (round-robin over an md5 order, so every row is used before
    any is used twice), one of its k nearest minority neighbours (exact,
    min-max scaled Euclidean, via :func:`faultline.operators.models.knn_exact`,
    which searches by cells beyond ``max_train`` rows) and a
    gap in [0, 1) from md5.  Returns original rows ∪ synthetic rows with a
    ``synthetic`` flag; ids of synthetic rows are ``<id>~s<j>``.
    """
    from .models import MAX_TRAIN, knn_exact, minmax_scale

    plain = df.select(id_col, *features, label).withColumn("synthetic", F.lit(False))
    if minority is None:
        counts = df.groupBy(label).count()
        least = counts.orderBy("count", label).first()  # one row per class
        if least is None:
            return plain
        minority = least[0]
    mino = df.filter(F.col(label) == F.lit(minority))
    n_min = mino.count()
    n_syn = int(n_min * percent // 100)
    if n_syn == 0 or n_min < 2:
        return plain
    scaled, _ = minmax_scale(mino, features)
    nn = knn_exact(scaled, scaled, features, id_col, k=k, exclude_self=True, whole=max_train or MAX_TRAIN)
    order = row_positions(mino.select(id_col).withColumn("_h", seeded_hash(id_col, seed=seed))
                          .withColumn("_g", F.lit(0)), ["_g"], ["_h", id_col]).select(id_col, "_pos")
    # Synthetic j (0-based) uses the row at position (j mod n_min) + 1.
    reps = (n_syn + n_min - 1) // n_min
    base = order.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))) \
        .withColumn("_j", (F.col("_r") * n_min + F.col("_pos") - 1)).filter(F.col("_j") < n_syn)
    pick = seeded_hash(id_col, "_j", seed=seed)
    u1 = F.conv(F.substring(pick, 1, 8), 16, 10).cast("double") / 4294967296.0
    u2 = F.conv(F.substring(pick, 9, 8), 16, 10).cast("double") / 4294967296.0
    base = base.withColumn("_nn", (F.floor(u1 * k) + 1).cast("int")).withColumn("_gap", u2)
    # Neighbour rank r of each row; fewer than k neighbours → wrap around.
    nn = nn.withColumn("_cnt", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    x = base.join(nn.select(F.col("query_id").alias(id_col), "nn_rank", "neighbor_id", "_cnt"), id_col)
    x = x.filter(F.col("nn_rank") == ((F.col("_nn") - 1) % F.col("_cnt")) + 1)
    a = mino.select(id_col, *features)
    b = mino.select(F.col(id_col).alias("neighbor_id"), *[F.col(f).alias(f"_n_{f}") for f in features])
    x = x.join(a, id_col).join(b, "neighbor_id")
    syn = x.select(F.concat(F.col(id_col), F.lit("~s"), F.col("_j").cast("string")).alias(id_col),
                   *[(F.col(f) + F.col("_gap") * (F.col(f"_n_{f}") - F.col(f))).alias(f) for f in features],
                   F.lit(minority).alias(label), F.lit(True).alias("synthetic"))
    return plain.unionByName(syn)


#: Neighbours kept beyond k, so that enough remain once a fold's rows are gone.
SPARE = 10


def neighbour_graph(mino: DataFrame, features: list[str], id_col: str = "id", k: int = 5, spare: int = SPARE) -> DataFrame:
    """(base, neighbour, dist): the ``k + spare`` nearest minority rows of each,
    by plain Euclidean distance.  The distance needs no fit, so one graph serves
    every fold of every repetition."""
    from .models import knn_exact

    near = knn_exact(mino, mino, features, id_col, k=k + spare, exclude_self=True)
    return near.select(F.col("query_id").alias("base"), F.col("neighbor_id").alias("neighbour"), "dist")


def smote_rows(df: DataFrame, folds: DataFrame, features: list[str], label: str = "buggy", id_col: str = "id", minority: int = 1,
               percent: float = 65.0, k: int = 5, seed: int = 42, spare: int = SPARE) -> DataFrame:
    """M-3 inside M-9: (rep, fold, id, base, neighbour, gap, features…), the
    synthetic rows of every training side of ``folds`` (id, rep, fold).

    Each training side has ``floor(n · percent / 100)`` of them for its n
    minority rows: these are taken in the order of md5(id, seed), again from the
    first when all were taken; synthetic j of a base goes towards the one of its
    k nearest minority rows *of the training side* (fewer: all) that a hash of
    (id, j) picks, by a gap from the same hash.  A training side with less than
    two minority rows has none.

    Neighbours come from one graph over all minority rows: a list of
    ``k + spare`` without the fold's rows still starts with the nearest of the
    training side.  Only where less than k remain, and the list left some rows
    out, those bases are searched again, against their own training side.
    """
    from .models import knn_exact

    folds = materialize(folds.select(id_col, "rep", "fold"), "folds")
    mino = materialize(df.filter(F.col(label) == F.lit(minority)).select(F.col(id_col).cast("string").alias("id"), *[F.col(f).cast("double").alias(f) for f in features]), "minority")
    at = materialize(folds.select(F.col(id_col).cast("string").alias("id"), "rep", "fold").join(mino.select("id"), "id"), "minority_folds")
    graph = materialize(neighbour_graph(mino, features, "id", k, spare), "neighbour_graph")
    # A row trains for every fold of its repetition but its own.
    every = folds.select("rep", "fold").distinct()  # one row a fold
    train = at.withColumnRenamed("fold", "own").join(F.broadcast(every), "rep").filter("own <> fold")
    order = row_positions(train.withColumn("_h", seeded_hash("id", seed=seed)), ["rep", "fold"], ["_h", "id"]).select("rep", "fold", "id", "_pos")
    total = train.groupBy("rep", "fold").agg(F.count(F.lit(1)).alias("n"))
    made = total.filter("n > 1").withColumn("made", F.floor(F.col("n") * percent / 100))
    base = order.join(F.broadcast(made), ["rep", "fold"]).filter(F.col("_pos") <= F.col("made"))  # one row a fold
    again = F.floor((F.col("made") - F.col("_pos")) / F.col("n"))
    base = base.withColumn("j", F.explode(F.sequence(F.lit(0), again))).withColumn("j", F.col("j") * F.col("n") + F.col("_pos") - 1)
    base = materialize(base.select("rep", "fold", F.col("id").alias("base"), "j", "n"), "smote_bases")

    used = base.select("rep", "fold", "base", "n").distinct()
    near = used.join(graph, "base").join(at.select("rep", F.col("id").alias("neighbour"), F.col("fold").alias("own")), ["rep", "neighbour"]).filter("own <> fold")
    place = lambda of: F.expr(f"transform(slice({of}, 1, {k}), x -> x.neighbour)")
    lists = near.groupBy("rep", "fold", "base", "n").agg(F.array_sort(F.collect_list(F.struct("dist", "neighbour"))).alias("all"))  # at most k + spare each
    lists = used.join(lists.select("rep", "fold", "base", place("all").alias("near")), ["rep", "fold", "base"], "left")
    lists = materialize(lists.withColumn("near", F.coalesce("near", F.array().cast("array<string>"))), "training_neighbours")
    # Enough, or all there are.
    whole = lists.filter(F.size("near") >= F.least(F.lit(k), F.col("n") - 1)).select("rep", "fold", "base", "near")
    short = materialize(lists.filter(F.size("near") < F.least(F.lit(k), F.col("n") - 1)).select("rep", "fold", "base"), "short_lists")
    for r in short.select("rep", "fold").distinct().collect():  # folds that have such rows, mostly none
        own = (F.col("rep") == r["rep"]) & (F.col("fold") == r["fold"])
        asked = mino.join(short.filter(own).select(F.col("base").alias("id")), "id", "left_semi")
        side = mino.join(train.filter(own).select("id"), "id", "left_semi")
        found = knn_exact(asked, side, features, "id", k=k, exclude_self=True).groupBy(F.col("query_id").alias("base")).agg(
            F.array_sort(F.collect_list(F.struct("dist", F.col("neighbor_id").alias("neighbour")))).alias("all"))
        whole = whole.unionByName(found.select(F.lit(r["rep"]).alias("rep"), F.lit(r["fold"]).alias("fold"), "base", place("all").alias("near")))

    pick = seeded_hash("base", F.col("j").cast("string"), seed=seed)
    part = lambda i: F.conv(F.substring(pick, i, 8), 16, 10).cast("double") / 4294967296.0
    x = base.join(whole, ["rep", "fold", "base"]).withColumn("gap", part(9))
    x = x.withColumn("neighbour", F.get("near", F.floor(part(1) * F.size("near")).cast("int")))
    a = mino.select(F.col("id").alias("base"), *[F.col(f).alias(f"_a_{f}") for f in features])
    b = mino.select(F.col("id").alias("neighbour"), *[F.col(f).alias(f"_b_{f}") for f in features])
    x = x.join(a, "base").join(b, "neighbour")
    return x.select("rep", "fold", F.concat("base", F.lit("~s"), F.col("j").cast("string")).alias("id"), "base", "neighbour", "gap",
                    *[(F.col(f"_a_{f}") + F.col("gap") * (F.col(f"_b_{f}") - F.col(f"_a_{f}"))).alias(f) for f in features])
