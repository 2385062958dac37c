"""Order MinHash fingerprints (DataFrame functions only).

A text becomes word k-mers; equal k-mers are told apart by their occurrence
number, so repeats count.  Occurrence-numbered k-mers are hashed and split by
hash into ``BINS`` bins (one permutation instead of one per bin); each bin
selects its two smallest hashes, puts them back into text order and hashes
that pair.  A bin with one k-mer borrows the least k-mer of the next filled bin
(after the last, the first), so that short texts are signed in order, too.  Equal bins need the same k-mers *in the same order*, so
the share of equal bins follows edit distance, not only set overlap.

All steps are array functions inside one row: no explode and no shuffle per
k-mer.  A k-mer and its place are packed into one long, so sorting brings
equal k-mers together in text order; the occurrence number of a repeated one
is its distance from the first of its run, found by binary search.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import text_or_empty

K = 3
BINS = 64
#: Longer words are cut, so that a text without spaces still has k-mers.
TOKEN = r"[^\x20\x09-\x0D]{1,24}"
#: Most buckets of consecutive ids; beyond, buckets grow and windows spill.
MAX_BUCKETS = 1 << 16
PLACE_BITS = 31
MASK = (1 << PLACE_BITS) - 1


def _value(x: Column) -> Column:
    return F.shiftright(x, PLACE_BITS)


def _packed(value: Column, place: Column) -> Column:
    """32 bits of value above 31 bits of place."""
    return F.shiftleft(value.bitwiseAND(F.lit((1 << 32) - 1)), PLACE_BITS).bitwiseOR(place)


def _floor(x: Column, bits: int) -> Column:
    """``x`` with its lowest bits cleared: in a sorted array, an earlier element
    shares the upper bits of ``x`` exactly if it is not below this."""
    return x.bitwiseAND(F.lit(-1 << bits))


def _occurrence(run: Column, x: Column, i: Column) -> Column:
    """Equal k-mers before place ``i`` of the sorted array ``run``."""
    steps = F.array(*[F.lit(1 << b) for b in range(30, -1, -1)])
    same = lambda back: F.get(run, i - back) >= _floor(x, PLACE_BITS)
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(same(n + step), n + step).otherwise(n))


def with_fingerprint(df: DataFrame, text: str, name: str, k: int = K, bins: int = BINS) -> DataFrame:
    """``df`` with ``name``: sorted array of ints, ``bin << 24 | tuple hash``
    for each bin that got a k-mer.  Empty for a text without words."""
    w, s = f"{name}_w", f"{name}_s"
    bin_at = PLACE_BITS + 32 - (bins - 1).bit_length()
    df = df.withColumn(w, F.transform(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)), lambda x: F.xxhash64(x)))
    kmer = lambda x, i: F.xxhash64(x, *[F.get(F.col(w), i + j) for j in range(1, k)])
    df = df.withColumn(s, F.sort_array(F.transform(F.col(w), lambda x, i: _packed(kmer(x, i), i))))
    # A first occurrence keeps its hash; later ones get one of their own, by number.
    again = lambda x, i: F.get(F.col(s), i - 1) >= _floor(x, PLACE_BITS)
    numbered = lambda x, i: _packed(F.xxhash64(_value(x), _occurrence(F.col(s), x, i)), x.bitwiseAND(F.lit(MASK)))
    df = df.withColumn(s, F.sort_array(F.transform(F.col(s), lambda x, i: F.when(again(x, i), numbered(x, i)).otherwise(x))))
    # The upper bits of a hash are its bin: the least two of each bin stay.
    below = lambda x, i, back: F.coalesce(F.get(F.col(s), i - back) < _floor(x, bin_at), F.lit(True))
    df = df.withColumn(s, F.filter(F.col(s), lambda x, i: below(x, i, 2)))

    def signature(x: Column, i: Column) -> Column:
        # Sorted by bin, so the next one is the bin's second, or the least of the next filled bin.
        y = F.coalesce(F.get(F.col(s), i + 1), F.get(F.col(s), F.lit(0)))
        later = x.bitwiseAND(F.lit(MASK)) < y.bitwiseAND(F.lit(MASK))
        pair = F.when(later, F.xxhash64(_value(x), _value(y))).otherwise(F.xxhash64(_value(y), _value(x)))
        one = F.when(F.size(F.col(s)) > 1, pair).otherwise(F.xxhash64(_value(x)))
        return F.shiftleft(F.shiftright(x, bin_at), 24).bitwiseOR(one.bitwiseAND(F.lit((1 << 24) - 1))).cast("int")

    tuples = F.transform(F.col(s), lambda x, i: F.when(below(x, i, 1), signature(x, i)))
    return df.withColumn(name, F.array_compact(tuples)).drop(w, s)


def likeness(a: Column, b: Column) -> Column:
    """Equal bins as a share of the bins that either text filled; 1 for two empty texts."""
    bins = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, 24)), F.transform(b, lambda x: F.shiftright(x, 24))))
    return F.when(bins == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / bins)


def hex_form(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def _bucket_of(order: Column, bounds: list[int]) -> Column:
    """How many bounds lie above ``order`` (0: the largest ids; null ids last),
    looked up in two levels so that the work per row grows with the square
    root of the number of bounds."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    longs = lambda x: F.from_json(F.lit(json.dumps(x)), "array<bigint>")  # noqa: E731  one literal, folded once
    below = lambda part: F.size(F.filter(part, lambda b: (order < b) | order.isNull()))
    coarse = below(longs(bounds[step - 1::step]))
    return coarse * step + below(F.slice(longs(bounds), coarse * step + 1, F.lit(step)))


def with_next(df: DataFrame, id_col: str, carried: list[str], buckets: int,
              derive: Callable[[DataFrame], DataFrame] = lambda x: x, derived: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``next_<c>`` for each carried column: its value in the next
    row by descending id (nulls last; ties by a hash of ``carried``), after the
    last row the first.  ``derive`` adds the ``derived`` columns, which get a
    ``next_`` column, too; it runs behind the shuffle, once for each row.

    Rows are dealt into buckets of consecutive ids (bounds from approximate
    quantiles, at most ``MAX_BUCKETS`` of them on the driver), so one shuffle
    brings neighbours together and no window spans the table; the first row
    of each bucket is also sent to the bucket before it.
    """
    buckets = min(buckets, MAX_BUCKETS)
    number = F.col(f"`{id_col}`").cast("long")
    points = [i / buckets for i in range(buckets - 1, 0, -1)]
    found = df.agg(F.percentile_approx(number, points, max(10_000, 4 * buckets))).first()[0] if points else None
    x = df.withColumn("_b", _bucket_of(number, sorted(set(found or []), reverse=True))).withColumn("_tie", F.xxhash64(*carried))
    order = F.struct(number.alias("i"), "_tie")
    heads = materialize(x.groupBy("_b").agg(F.max(order).alias("_head")), "bucket_heads")  # one row per bucket
    around = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(F.col("_b").alias("_hb"), "_head", F.coalesce(
        F.lag("_b").over(Window.orderBy("_b")), F.max("_b").over(around)).alias("_before"))
    first = x.join(F.broadcast(heads), (F.col("_b") == F.col("_hb")) & order.eqNullSafe(F.col("_head")))
    first = first.dropDuplicates(["_hb"]).withColumn("_b", F.col("_before")).drop("_hb", "_head", "_before")
    both = x.withColumn("_copy", F.lit(0)).unionByName(first.withColumn("_copy", F.lit(1)))
    both = derive(both.repartition("_b"))  # the window below keeps this partitioning
    w = Window.partitionBy("_b").orderBy(F.col("_copy"), number.desc_nulls_last(), F.col("_tie").desc())
    return (both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in [*carried, *derived]])
            .filter("_copy = 0").drop("_copy", "_b", "_tie"))


def edit_study(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_chars: int = 4_000_000) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last third of
    its code points (rounded down) replaced by as many first ones of the next
    text by descending id.

    One row per row of ``docs``: (id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next).  Null texts count as empty;
    their fingerprint is empty, like 1.0 to another empty one and 0.0 to any
    other.  Rows may repeat ids or texts; a single row is its own next.  An
    empty table gives no rows; other columns are ignored.
    """
    x = docs.select(F.col(f"`{id_col}`").alias("doc"), text_or_empty(text_col).alias("text"))
    chars = docs.select(F.sum(F.length(text_or_empty(text_col)))).first()[0] or 0
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = with_next(x, "doc", ["text"], max(4 * shuffles, chars // bucket_chars),
                  lambda rows: with_fingerprint(rows, "text", "fp"), ("fp",))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    x = with_fingerprint(x.withColumn("edited", edited), "edited", "edited_fp")
    return x.select(
        F.col("doc").alias(id_col), n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        hex_form(F.col("fp")).alias("fingerprint"), hex_form(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
