"""SimHash near-duplicates with exact, bit-sliced comparison.

Fingerprints within ``RADIUS`` differing bits are linked.  Distinct
fingerprints are cut into ``PARTS`` bit ranges; two that differ in at most
``RADIUS`` bits agree in at least ``PARTS - RADIUS`` ranges, so each goes under
one key per choice of that many ranges and no link is missed.  Inside a key
the comparison is bit-sliced: bit planes are stored vertically (64
fingerprints a word), one pass over the planes updates the distances of many
pairs in carry-save counters, and a block is abandoned once all its pairs
exceed the radius.

Keys with more than ``BLOCK`` fingerprints are cut into blocks, and every pair
of blocks becomes a group of its own, so that no task gets an unbounded group.
Only a spanning forest of each group's links leaves the tasks; components are
joined up by Spark.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hints import broadcast_if_small
from ..session import materialize
from .common import map_texts, text_or_empty
from .components import components

SHINGLE = 4
RADIUS = 4
BITS = 64
PARTS = 6
BLOCK = 2048
#: Groups up to this size are compared together, place by place, in one sweep.
SMALL = 24
SEED = 42


# --- fingerprints ----------------------------------------------------------

def shingle_hashes(text: str, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of ``width`` words (of the whole text if it is shorter)."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    pieces = map(line.__getitem__, map(slice, start[: 1 - width].tolist(), end[width - 1:].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(words) - width + 1)


def simhash(text: str, width: int = SHINGLE) -> int:
    """64 bits; a bit is set if over half of the shingle hashes have it.  0 without words."""
    h = shingle_hashes(text, width)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = np.unpackbits(h[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, fp, text_hash), one row per row of ``docs``."""
    def work(ids, texts, hashes):
        return ids, [simhash(t, width) for t in texts], hashes

    kind = docs.schema[id_col].dataType.simpleString()
    text = text_or_empty(text_col)
    return map_texts(docs, [F.col(f"`{id_col}`"), text, F.xxhash64(text)], work, f"id {kind}, fp long, text_hash long")


# --- bit-sliced comparison -------------------------------------------------

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 rows: bit b of all fingerprints, 64 of them a word."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return pack(bits)


def pack(bits: np.ndarray) -> np.ndarray:
    n = bits.shape[-1]
    wide = np.zeros((*bits.shape[:-1], -(-n // 64) * 64), np.uint8)
    wide[..., :n] = bits
    return np.packbits(wide, axis=-1, bitorder="little").view(np.uint64)


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def within(diff, valid: np.ndarray, radius: int = RADIUS) -> np.ndarray | None:
    """Pairs of ``valid`` (a bit each) that differ in at most ``radius`` planes.
    ``diff(b)`` gives the differences in plane b.  None as soon as there are none."""
    count = [np.zeros_like(valid) for _ in range(radius.bit_length())]
    over = ~valid
    for b in range(BITS):
        carry = diff(b)
        for i, c in enumerate(count):
            count[i], carry = c ^ carry, c & carry
        over = over | carry
        if b % 4 == 3:
            above, same = np.zeros_like(valid), ALL
            for i in reversed(range(len(count))):
                if radius >> i & 1:
                    same = same & count[i]
                else:
                    above, same = above | same & count[i], same & ~count[i]
            out = over | above
            if (out == ALL).all():
                return None
    return ~out


def near_in_sweep(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of one group, for sorted small groups: row i against
    row i + 1, all at once, then i + 2, and so on."""
    planes = planes_of(fps)
    left, right = [], []
    for step in range(1, len(fps)):
        same = group[:-step] == group[step:]
        if not same.any():
            break
        w, r = divmod(step, 64)

        def moved(p, w=w, r=r):
            q = np.zeros_like(p)
            q[: len(p) - w] = p[w:]
            if r:
                q >>= np.uint64(r)
                q[: len(p) - w - 1] |= p[w + 1:] << np.uint64(64 - r)
            return q

        wide = np.zeros(len(fps), np.uint8)
        wide[: len(same)] = same
        valid = pack(wide)
        for at in range(0, len(valid), 512):
            if valid[at:at + 512].any():
                reach = slice(at, at + 512 + w + 1)
                near = within(lambda b: planes[b, at:at + 512] ^ moved(planes[b, reach])[: len(valid) - at][:512], valid[at:at + 512], radius)  # noqa: B023
                if near is not None:
                    i = np.flatnonzero(unpack(near, 64 * len(near))) + 64 * at
                    left.append(i)
                    right.append(i + step)
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def near_in_block(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Boolean matrix of links inside one group, 64 rows against all at a time."""
    planes, n = planes_of(fps), len(fps)
    out = np.zeros((n, n), bool)
    full = pack(np.ones(n, np.uint8))
    for at in range(0, n, 64):
        own = fps[at:at + 64].view(np.uint64)
        flip = np.where((own[None, :] >> np.arange(BITS, dtype=np.uint64)[:, None]) & np.uint64(1) == 1, ALL, np.uint64(0))
        valid = np.broadcast_to(full, (len(own), len(full))).copy()
        near = within(lambda b: planes[b][None, :] ^ flip[b][:, None], valid, radius)  # noqa: B023
        if near is not None:
            out[at:at + 64] = unpack(near, n)
    return out


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least connected row of each of ``n`` rows, by the links i - j."""
    least = np.arange(n)
    while len(i):
        low = np.minimum(least[i], least[j])
        before = least.copy()
        np.minimum.at(least, i, low)
        np.minimum.at(least, j, low)
        least = least[least]
        if (least == before).all():
            break
    return least


def links_of(batches, radius: int = RADIUS):
    """Arrow batches of (group, fp), sorted, in; spanning links (a, b) out.
    A group that reaches over the end of a batch waits for the next one."""
    import pyarrow as pa

    def solve(group, fps):
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[start, len(group)])
        a, b = [], []
        small = np.repeat((size > 1) & (size <= SMALL), size)
        if small.any():
            f, g = fps[small], group[small]
            i, j = near_in_sweep(f, g, radius)
            least = forest(len(f), i, j)
            moved = least != np.arange(len(f))
            a.append(f[moved])
            b.append(f[least[moved]])
        for k in np.flatnonzero(size > SMALL):
            f = fps[start[k]:start[k] + size[k]]
            i, j = np.nonzero(np.triu(near_in_block(f, radius), 1))
            least = forest(len(f), i, j)
            moved = least != np.arange(len(f))
            a.append(f[moved])
            b.append(f[least[moved]])
        if a and sum(map(len, a)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], names=["a", "b"])

    held_g, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)
    for batch in batches:
        g = np.concatenate([held_g, batch.column(0).to_numpy(zero_copy_only=False)])
        f = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(g):
            continue
        cut = np.searchsorted(g, g[-1])  # the last group may go on
        if cut:
            yield from solve(g[:cut], f[:cut])
        held_g, held_f = g[cut:], f[cut:]
    if len(held_g):
        yield from solve(held_g, held_f)


# --- the join --------------------------------------------------------------

def _keys(radius: int, parts: int) -> list:
    """One hash per choice of bit ranges that must agree."""
    edges = [round(BITS * i / parts) for i in range(parts + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    return [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(sum(chosen)))))
            for k, chosen in enumerate(combinations(masks, parts - radius))]


def near_links(fps: DataFrame, radius: int = RADIUS, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that span the components of the distinct ``fps.fp``
    under "at most ``radius`` differing bits"."""
    spark = fps.sparkSession
    keyed = materialize(fps.select("fp").distinct().select("fp", F.explode(F.array(*_keys(radius, parts))).alias("key")), "keyed")
    hot = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
                      .select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "hot_keys")
    x = keyed.join(broadcast_if_small(hot), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", F.lit(SEED)), F.col("blocks"))
    x = x.select("fp", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    x = x.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "fp")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = x.repartition(n, "group").sortWithinPartitions("group", "fp")
    return dealt.mapInArrow(lambda batches: links_of(batches, radius), "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE,
                radius: int = RADIUS) -> DataFrame:
    """(id, fp, text_hash, component): one row per row of ``docs``; the
    component is the least id reachable over links, itself included (null
    only where all its ids are null).  Texts without words (null, empty) have
    fingerprint 0 and link like any other.  Repeated rows and equal texts have
    equal fingerprints and so one component.  An empty table gives no rows;
    other columns are ignored."""
    slim = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    least = materialize(slim.groupBy("fp").agg(F.min("id").alias("id")), "least_ids")
    linked = components(near_links(least, radius))
    rooted = least.join(linked.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    best = materialize(rooted.groupBy("root").agg(F.min("id").alias("component")), "component_ids")
    names = materialize(rooted.join(best, "root").select("fp", "component"), "components")
    return slim.join(names, "fp").select("id", "fp", "text_hash", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE,
             radius: int = RADIUS) -> DataFrame:
    """``docs`` (all columns) with one document of each component: the one with
    the least id (of several with that id, the least text hash).  Rows that
    repeat both id and text are one document and stay together."""
    found = materialize(near_groups(docs, id_col, text_col, width, radius), "near_groups")
    # A component's documents are compared with its best one; nothing is grouped per row.
    best = materialize(found.filter(F.col("id").eqNullSafe(F.col("component"))).groupBy("component").agg(F.min("text_hash").alias("best")), "best")
    gone = found.join(best, found["component"].eqNullSafe(best["component"])).filter(
        ~(F.col("id").eqNullSafe(found["component"])) | (F.col("text_hash") != F.col("best")))
    gone = materialize(gone.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "dropped")
    # The caller's columns travel in one struct: no name can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_doc"),
                       F.xxhash64(text_or_empty(text_col)).alias("_text"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash"))
    return rows.join(broadcast_if_small(gone), same, "left_anti").select("_row.*")
