"""Exact duplicates by two passes over a blocked Bloom filter (DataFrame functions only).

Pass 1 sets ``PROBES`` bits per text hash and counts how many rows set each
bit; bits set by two or more rows form the filter of *possibly repeated*
hashes.  Pass 2 probes it: a row with a bit set only once has a unique text
and passes straight through; only the others shuffle, by their SHA-256, which
decides exactly.  False positives cost a shuffle, never a wrong row.

The filter holds one row of four longs (256 bits) per block.  Its size follows
the number of rows (``BITS_PER_ROW``); up to ``BROADCAST_BLOCKS`` blocks it is
broadcast, beyond that the probe is a shuffled join on the block number, with
the same result.  That join holds digests only: the rows and their texts meet
the possibly repeated digests, as 8-byte hashes, which are broadcast while their
stored size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hints import broadcast_if_small
from ..session import materialize
from .common import row_key, text_or_empty

BITS_PER_ROW = 16
PROBES = 3
BLOCK_BITS = 256
BROADCAST_BLOCKS = 1 << 20  # 32 MB of bits
LANES = [f"_w{i}" for i in range(BLOCK_BITS // 64)]


def _block(digest: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(blocks))


def _bits(digest: Column) -> list[Column]:
    """``PROBES`` bit numbers inside the block, from a second hash of the digest."""
    h = F.xxhash64(F.lit("bits"), digest)
    return [F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for i in range(PROBES)]


def repeat_filter(digests: DataFrame, blocks: int) -> DataFrame:
    """Pass 1: (``_block``, four longs) with the bits that two or more rows of
    ``digests._digest`` set.  Counts are pre-aggregated before the shuffle."""
    d = F.col("_digest")
    bits = digests.select(_block(d, blocks).alias("_block"), F.explode(F.array_distinct(F.array(*_bits(d)))).alias("_bit"))
    twice = bits.groupBy("_block", "_bit").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    lane = [F.bit_or(F.when(F.shiftright("_bit", 6) == i, F.expr("shiftleft(1L, _bit & 63)")).otherwise(F.lit(0)))
            .alias(w) for i, w in enumerate(LANES)]
    return twice.groupBy("_block").agg(*lane)


def flag_repeats(df: DataFrame, digest: str, digests: DataFrame) -> DataFrame:
    """Pass 2: ``df`` with ``_again`` = its digest is possibly repeated among
    the rows of ``digests`` (one column, ``_digest``, stored)."""
    blocks = max(1, digests.count() * BITS_PER_ROW // BLOCK_BITS)
    found = materialize(repeat_filter(digests, blocks), "repeat_filter")
    found = F.broadcast(found) if blocks <= BROADCAST_BLOCKS else found
    d = F.col(f"`{digest}`")
    hit = F.lit(True)
    for b in _bits(d):
        hit = hit & _is_set(F.get(F.array(*LANES), F.shiftright(b, 6)), b)
    return (df.withColumn("_block", _block(d, blocks)).join(found, "_block", "left")
            .withColumn("_again", F.coalesce(hit, F.lit(False))).drop("_block", *LANES))


def flag_rows(df: DataFrame, digest: str, digests: DataFrame) -> DataFrame:
    """Pass 2 for wide rows: as :func:`flag_repeats`, but beyond the broadcast
    bound ``digests`` are probed in place of ``df``, and ``df`` joins the hashes of
    those that are possibly repeated.  Two digests of one hash are both flagged."""
    if digests.count() * BITS_PER_ROW // BLOCK_BITS <= BROADCAST_BLOCKS:
        return flag_repeats(df, digest, digests)
    again = flag_repeats(digests, "_digest", digests).filter("_again").select(F.xxhash64("_digest").alias("_hash")).distinct()
    again = broadcast_if_small(materialize(again, "repeated").withColumn("_again", F.lit(True)))
    joined = df.withColumn("_hash", F.xxhash64(F.col(f"`{digest}`"))).join(again, "_hash", "left")
    return joined.withColumn("_again", F.coalesce("_again", F.lit(False))).drop("_hash")


def _is_set(word: Column, bit: Column) -> Column:
    return F.call_function("bit_get", word, bit.bitwiseAND(F.lit(63))) == 1


def group_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical; null counts as empty.  In each group the
    largest id stays (a null id only where the group has no other).  Rows that
    repeat both id and text form one group with the rest; exactly one of them
    is kept.  Empty tables give no rows; other columns are ignored.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.sha2(text_or_empty(text_col), 256).alias("sha"))
    slim = materialize(slim, "digests")  # the texts are read once; both passes read the digests
    seen = flag_repeats(slim, "sha", slim.select(F.col("sha").alias("_digest")))
    alone = seen.filter(~F.col("_again")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    copies = (seen.filter("_again").groupBy("sha", "id").agg(F.count(F.lit(1)).alias("c")))
    copies = materialize(copies, "copies")
    groups = copies.groupBy("sha").agg(F.max("id").alias("keep_id"), F.sum("c").alias("group_size"))
    groups = materialize(groups, "groups")  # one row per text: joins below see its size; a hot text can be split
    rows = copies.join(groups, "sha").select(
        "id", "keep_id", "group_size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))).alias("i"), "sha")
    rows = rows.select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"), "sha")
    out = alone.unionByName(rows)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts (all its columns):
    the row with the largest id, ties by a hash of the row.  Rows whose text
    is not repeated do not shuffle (while the hashes of the repeated ones can be
    broadcast; see :func:`flag_rows`); repeated ones are reduced in the map tasks
    before they do, so a hot text sends one row per task."""
    # The caller's columns travel in one struct: no name can clash.
    row, key = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), row_key(docs, [id_col])
    held = docs.select(row.alias("_row"), key.alias("_key"), F.sha2(text_or_empty(text_col), 256).alias("_digest"))
    seen = flag_rows(held, "_digest", materialize(held.select("_digest"), "digests"))
    best = seen.filter("_again").groupBy("_digest").agg(F.max_by("_row", "_key").alias("_row"))
    return seen.filter(~F.col("_again")).select("_row").unionByName(best.select("_row")).select("_row.*")
