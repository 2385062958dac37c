"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Each source gets the share ``weight / sum of weights`` of the budget (all words
of the table), but at most ``MAX_EPOCHS`` times its own words.  What clamped
sources leave is reshared among the others by weight until none is above its
cap: the level ``budget per weight`` only rises, so every round clamps more
sources and the loop ends after a few aggregates over the source table.

A target of ``e`` epochs takes every document ``floor(e)`` times, and for the
fraction the first documents of the source in a seeded hash order, up to the
one whose middle lies beyond the wanted words.  That point is found from
totals, ever finer: hash buckets (as many as the rows need), the distinct (id,
size) of the one bucket that holds it, then, where rows share an id, the rows
themselves in buckets of a hash of all their columns.  Equal rows are counted,
not listed.  So a source, an id or a row with a third of all rows is never
gathered, and the target is met whatever the ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hints import broadcast_if_small
from ..operators.sampling import row_positions
from ..session import materialize
from .common import WORD, text_or_empty

MAX_EPOCHS = 3
SEED = 42
HASH_SPAN = 1 << 32
#: Rows wanted in a bucket, the most that one task sorts.
BUCKET_ROWS = 100_000
#: Copies of one row that one task writes.
CHUNK = 10_000


def cyclic_weights(position: Column) -> Column:
    """1, 2, 3, 1, 2, 3, ... by the place of a source in code-point order (from 1)."""
    return (position - 1) % 3 + 1


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, tie: Column) -> list[Column]:
    """size, source, a key that is never null, the seeded hash, its first 32 bits, and ``tie``."""
    source = F.col(f"`{source_col}`").cast("string")
    order = F.md5(F.concat_ws("-", F.col(f"`{id_col}`").cast("string"), F.lit(str(seed))))
    return [F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"), source.alias("source"),
            F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source)).alias("key"), order.alias("h"),
            F.conv(F.substring(order, 1, 8), 16, 10).cast("long").alias("u"), tie.cast("long").alias("tie")]


def _bucket(u: Column, buckets: Column) -> Column:
    return F.floor(u * buckets / HASH_SPAN).cast("long")


def _crossing(totals: DataFrame, slot: str, want: str) -> DataFrame:
    """Of ``totals`` (key, slot, n), joined to a ``want`` for each key: the slots,
    in order, where the running total passes it, with ``off`` = total before."""
    run = Window.partitionBy("key").orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("off", F.coalesce(F.sum("n").over(run), F.lit(0)))
    return before.filter((F.col("off") <= F.col(want)) & (F.col(want) < F.col("off") + F.col("n")))


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` (with long ``source_size`` and ``weight``) plus ``target``:
    min(level * weight, max_epochs * source_size), where the targets add up to
    all words.  An empty table gives an empty one."""
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (total or 0) / weights if weights else 0.0
    cap = F.col("source_size") * max_epochs
    clamped = -1
    while weights:
        over = F.col("weight") * F.lit(level) > cap
        n, held, free = sources.agg(F.count_if(over), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == clamped or not free:
            break
        clamped, level = n, (total - (held or 0)) / free
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), cap.cast("double")))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: Callable[[Column], Column] = cyclic_weights, max_epochs: int = MAX_EPOCHS,
             seed: int = SEED, tie: Column | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(measured rows, source table, buckets).  The source table has one row per
    source: key, source_size, weight, target, whole (times every document is
    taken), cut_b and cut (the last bucket and row that the fraction takes),
    equal and some (rows that are the cut row, and how many of them it takes).
    ``tie`` orders rows that share id and size."""
    tie = F.lit(0) if tie is None else tie
    slim = materialize(docs.select(F.col(f"`{id_col}`").alias("id"), *_measured(docs, id_col, text_col, source_col, seed, tie)), "sizes")
    buckets = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), slim.count() // BUCKET_ROWS)
    slim = slim.withColumn("b", _bucket(F.col("u"), F.lit(buckets))).drop("u")
    totals = materialize(slim.groupBy("key", "source", "b").agg(F.sum("size").alias("n")), "bucket_totals")
    sources = materialize(totals.groupBy("key", "source").agg(F.sum("n").alias("source_size")), "sources")
    placed = row_positions(sources, [], [F.col("source").asc_nulls_last()])
    filled = water_fill(materialize(placed.withColumn("weight", weights(F.col("_pos"))).drop("_pos"), "weights"), max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    filled = filled.withColumn("whole", F.floor(epochs)).withColumn("want", F.col("target") - F.col("whole") * F.col("source_size"))
    filled = materialize(filled.drop("source"), "targets")
    # The bucket where the running total passes the wanted words ...
    cross = _crossing(totals.join(broadcast_if_small(filled.select("key", "want")), "key"), "b", "want")
    cross = materialize(cross.select("key", "b", "off", "want"), "crossing")
    # ... the last (id, size) in it whose first row's middle lies before that, and how many of its rows fit ...
    same = slim.groupBy("key", "b", "h", "id", "size").agg(F.count(F.lit(1)).alias("c"))
    same = same.join(broadcast_if_small(cross), ["key", "b"])
    rows = Window.partitionBy("key").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    room = F.col("want") - F.col("off") - F.sum(F.col("size") * F.col("c")).over(rows) + F.col("size") * F.col("c")
    last = same.withColumn("room", room).filter(F.col("size") / 2 < F.col("room")).groupBy("key").agg(
        F.max(F.struct("h", "id", "size", "b", "c", "room")).alias("t")).select("key", "t.*")
    fits = F.when(F.col("size") == 0, F.col("c")).otherwise(F.least("c", F.ceil(F.col("room") / F.col("size") + 0.5) - 1))
    last = materialize(last.withColumn("m", fits.cast("long")).drop("room"), "last_ids")
    # ... and the last of those rows by ``tie``, again by buckets first.
    ties = slim.alias("s").join(broadcast_if_small(last).alias("l"), F.expr(
        "s.key = l.key AND s.b = l.b AND s.h = l.h AND s.id <=> l.id AND s.size = l.size"))
    parts = F.ceil(F.col("c") / BUCKET_ROWS).cast("long")
    ties = ties.select("l.*", "tie", F.floor(F.col("tie") / (2.0 ** 64) * parts).alias("tb"))
    ties = materialize(ties.groupBy("key", "h", "id", "size", "m", "tb", "tie").agg(F.count(F.lit(1)).alias("n")), "ties")
    at = _crossing(ties.groupBy("key", "tb", (F.col("m") - 1).alias("place")).agg(F.sum("n").alias("n")), "tb", "place")
    inside = ties.join(broadcast_if_small(at.select("key", "tb", "off", "place")), ["key", "tb"])
    run = Window.partitionBy("key").orderBy("tie").rowsBetween(Window.unboundedPreceding, -1)
    upto = inside.withColumn("upto", F.col("off") + F.coalesce(F.sum("n").over(run), F.lit(0)))
    cut = upto.filter("upto <= place AND place < upto + n").select(
        "key", F.struct("h", "id", "size", "tie").alias("cut"), F.col("n").alias("equal"), (F.col("m") - F.col("upto")).alias("some"))
    filled = filled.join(cross.select("key", F.col("b").alias("cut_b")), "key", "left").join(cut, "key", "left")
    return slim, materialize(filled, "mix"), buckets


def _judged(x: DataFrame) -> DataFrame:
    """Measured rows joined to their sources, with ``n``: how often each is taken.
    Where only some of equal rows get the fraction, all of them get ``whole``."""
    at = F.struct("h", "id", "size", "tie")
    extra = (F.col("b") < F.col("cut_b")) | ((F.col("b") == F.col("cut_b")) & ((at < F.col("cut")) | ((at == F.col("cut")) & _undivided())))
    return x.withColumn("n", F.col("whole") + F.coalesce(extra, F.lit(False)).cast("long"))


def _undivided() -> Column:
    return F.col("some") == F.col("equal")


def _at_divided_cut() -> Column:
    """This measured row is one of equal rows of which only some get the fraction."""
    at = F.struct("h", "id", "size", "tie")
    return F.coalesce((F.col("b") == F.col("cut_b")) & at.eqNullSafe(F.col("cut")) & ~_undivided(), F.lit(False))


def _repeat(df: DataFrame, times: Column) -> DataFrame:
    """Each row of ``df`` as often as ``times`` says, at most ``CHUNK`` in one task."""
    n = times.cast("long")
    chunks = df.withColumn("_times", n).filter("_times > 0").withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_times - 1) div {CHUNK}"))))
    held = F.least(F.lit(CHUNK), F.col("_times") - F.col("_chunk") * CHUNK).cast("int")
    return (chunks.repartition(F.col("_chunk")).withColumn("_copy", F.explode(F.array_repeat(F.lit(True), held)))
            .drop("_times", "_chunk", "_copy"))


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """(id, size, source_size, target, taken): one row per row of ``docs``.

    Size is the number of words; null and empty texts have none and are taken
    with 0 words.  Null sources form one source, placed last.  Where rows agree
    in id, source and size, as many of them get the fraction as the target
    needs.  An empty table gives no rows; other columns are ignored.
    """
    slim, sources, _ = plan_mix(docs, id_col, **how)
    columns = [F.col("id").alias(id_col), "size", "source_size", "target"]
    x = slim.join(broadcast_if_small(sources), "key").filter(~_at_divided_cut())
    out = _judged(x).select(*columns, (F.col("size") * F.col("n")).alias("taken"))
    divided = sources.filter(~_undivided()).select("cut.id", "cut.size", "source_size", "target", "whole", "equal", "some")
    for n, times in ((F.col("some"), F.col("whole") + 1), (F.col("equal") - F.col("some"), F.col("whole"))):
        out = out.unionByName(_repeat(divided, n).select(*columns, (F.col("size") * times).alias("taken")))
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: int = SEED, **how) -> DataFrame:
    """The mixed table: rows of ``docs`` with all their columns, each as often
    as the mix takes it.  Texts do not shuffle: every row is judged where it is
    read, against its source's row.  Only where the fraction takes some of
    rows that are equal in all columns is one of them sent, once a task, and
    repeated (maps do not count as columns here)."""
    tie = F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t])
    _, sources, buckets = plan_mix(docs, id_col, text_col, source_col, seed=seed, tie=tie, **how)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    x = docs.select(row, F.col(f"`{id_col}`").alias("id"), *_measured(docs, id_col, text_col, source_col, seed, tie))
    x = x.withColumn("b", _bucket(F.col("u"), F.lit(buckets))).join(broadcast_if_small(sources), "key")
    taken = _judged(x).filter("n > 0")
    out = taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("_copy")).select("_row")
    if not sources.filter(~_undivided()).isEmpty():
        one = x.filter(_at_divided_cut()).groupBy("key", "some").agg(F.any_value("_row").alias("_row"))
        out = out.unionByName(_repeat(one.select("_row", "some"), F.col("some")).select("_row"))
    return out.select("_row.*")
