"""Runs of repeated word sequences, by tiles of one period octave each.

A run is a maximal stretch of words with a smallest period q and a length of at
least ``max(6, 4 q)``.  Written as matches "word i equals word i + q" it is a
streak of at least ``max(3 q, 6 - q)`` matches.

* Periods are cut into octaves ``[G, 2 G)``.  In each, every multiple of G is a
  boundary; a streak of 3 G or more matches holds a boundary c with 2 G matches
  behind it, so the 2 G words from c recur at c + q.  Rolling hashes of 2 G
  words find these boundaries in one pass per octave; equal words always have
  equal hashes, and a chance hit is found out later.
* Boundaries go into overlapping tiles, rows of their own that Spark deals out
  anew: a long text does not stay with one task.  A tile is solved alone: the
  Z-function of the words from a boundary gives the matches behind it for all
  periods at once, and that of the reversed words the matches before it.
  Periods whose first q words themselves repeat are not the smallest and go.
* Tiles overlap by G before and 3 G behind a boundary, so the fragments of one
  streak touch.  They are shuffled by document and period and stitched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import small_batches, text_or_empty

#: A run is at least so many words, and so many periods, long.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Boundaries of one tile lie within so many words (or one octave, if that is longer).
TILE = 4096
ODD = 0x9E3779B97F4A7C15


def words_of(text: str) -> list[bytes]:
    """Runs of characters other than the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").split()


def numbered(words: list) -> np.ndarray:
    """Equal words, equal numbers."""
    of = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(of.__getitem__, words), np.int64, len(words))


# --- boundaries ------------------------------------------------------------

class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as needed."""

    def __init__(self):
        self.up, self.down = self.table(1024)

    @staticmethod
    def table(n: int) -> tuple[np.ndarray, np.ndarray]:
        inverse = pow(ODD, -1, 1 << 64)
        rows = []
        for base in (ODD, inverse):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            rows.append(np.multiply.accumulate(row))
        return rows[0], rows[1]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = self.table(2 * n)
        return self.up[:n], self.down[:n]


_powers = Powers()


def _long_enough(sums, down, c: np.ndarray, q: np.ndarray, g: int, n: int) -> np.ndarray:
    """Whether the words from ``c`` recur ``q`` later for as long as they must
    behind the first boundary of a streak of 3 q."""
    size = np.maximum(3 * q - g + 1, 2 * g)
    fits = c + q + size <= n
    c, q, size = c[fits], q[fits], size[fits]
    return (sums[c + size] - sums[c]) * down[c] == (sums[c + q + size] - sums[c + q]) * down[c + q]


def boundaries(x: np.ndarray):
    """(G, boundaries): multiples of G whose next 2 G words seem to recur G to
    2 G - 1 words later, for octaves in which one of them does so long enough."""
    n = len(x)
    if n < LEAST_WORDS:
        return
    with np.errstate(over="ignore"):
        mixed = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        up, down = _powers.upto(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed * up, out=sums[1:])
        g = 1
        while LEAST_PERIODS * g <= n:
            h = (sums[2 * g:] - sums[:-2 * g]) * down[: n - 2 * g + 1]
            rows = -(-(len(h) - g) // g)  # boundaries that have a word g places on
            later = np.zeros(rows * g, np.uint64)
            later[: len(h) - g] = h[g:]
            later = later.reshape(rows, g)
            same = later == h[: rows * g: g][:, None]
            same[-1, len(h) - g - (rows - 1) * g:] = False
            row, place = np.nonzero(same)
            if len(row) and _long_enough(sums, down, row * g, place + g, g, n).any():
                yield g, np.unique(row) * g
            g *= 2


def tiles(x: np.ndarray, width: int = TILE):
    """(G, start, words, boundaries within them): tiles that hold all boundaries."""
    for g, at in boundaries(x):
        span = max(width, g)
        i = 0
        while i < len(at):
            j = int(np.searchsorted(at, at[i] + span, "right"))
            gap = np.flatnonzero(np.diff(at[i:j]) > 6 * g)
            if len(gap):
                j = i + int(gap[0]) + 1
            start = max(0, int(at[i]) - g)
            yield g, start, x[start:int(at[j - 1]) + 5 * g], at[i:j] - start
            i = j


# --- one tile --------------------------------------------------------------

def z_function(s: list, upto: int) -> list[int]:
    """For each i < ``upto``: how long s[i:] agrees with s."""
    n = len(s)
    z = [0] * min(n, upto)
    if z:
        z[0] = n
    left = right = 0
    for i in range(1, len(z)):
        k = min(z[i - left], right - i) if i < right else 0
        if i + k >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def fragments(g: int, x: list, marks: list[int]) -> list[tuple[int, int, int]]:
    """(period, first, end) of matches "word i equals word i + period" around the
    boundaries, joined where they touch.  Periods are in [g, 2 g) and the
    smallest of their words."""
    last: dict[int, list[int]] = {}
    out = []
    for c in marks:
        ahead = z_function(x[c:c + 5 * g], 2 * g)
        inner = [p for p in range(1, g) if p < len(ahead) and ahead[p] >= g - p]  # periods of the first g words or more
        periods = [q for q in range(g, len(ahead)) if ahead[q] >= 2 * g and not any(q % p == 0 and ahead[p] >= q - p for p in inner)]
        if not periods:
            continue
        back = x[max(0, c - g):c][::-1]
        top = min(c + 2 * g, len(x))
        # Numbers are not negative: -1 keeps the two sides apart.
        behind = z_function([*back, -1, *x[max(0, c - g):top][::-1]], len(back) + 1 + top - c)
        for q in periods:
            before = behind[len(back) + 1 + top - c - q] if q < top - c else 0
            a, b = c - min(before, len(back)), c + min(ahead[q], 3 * g)
            if q in last and a <= last[q][1]:
                last[q][1] = max(last[q][1], b)
            else:
                if q in last:
                    out.append((q, *last[q]))
                last[q] = [a, b]
    return out + [(q, *ab) for q, ab in last.items()]


# --- the job ---------------------------------------------------------------

ROW = "rid long, id {kind}, n long, text string, plain string, g int, start long, tile array<int>, marks array<int>"


def _read(kind: str, change):
    """Per document a row: its words, or only their digest if no boundary is in them; and a row per tile."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ROW.format(kind=kind)))
    held_most = 2_000_000  # words in tiles that are handed on together

    def work(batches):
        for batch in batches:
            rows, held = [], 0
            for rid, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                if change is not None:
                    words = change(doc, words)
                some = False
                for g, start, x, marks in tiles(numbered(words)):
                    some = True
                    rows.append((rid, doc, None, None, None, g, start, x.astype(np.int32), marks.astype(np.int32)))
                    held += len(x)
                    if held > held_most:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                joined = b" ".join(words)
                rows.append((rid, doc, len(words), joined.decode("utf-8", "surrogatepass") if some else None,
                             None if some else hashlib.sha256(joined).hexdigest(), None, None, None, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return work


def _solve(batches):
    import pyarrow as pa

    for batch in batches:
        rid, period, first, end = [], [], [], []
        for r, g, start, x, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for q, a, b in fragments(g, x, marks):
                rid.append(r)
                period.append(q)
                first.append(start + a)
                end.append(start + b)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (rid, period, first, end)], names=["rid", "period", "first", "end"])


def stitched(found: DataFrame) -> DataFrame:
    """(rid, start, length, period): runs, from fragments of their matches."""
    before = Window.partitionBy("rid", "period").orderBy("first", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("rid", "period").orderBy("first", "end").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.col("reach").isNull() | (F.col("first") > F.col("reach"))
    whole = (found.withColumn("reach", F.max("end").over(before)).withColumn("streak", F.sum(fresh.cast("int")).over(upto))
             .groupBy("rid", "period", "streak").agg(F.min("first").alias("start"), (F.max("end") - F.min("first")).alias("matches")))
    length = F.col("matches") + F.col("period")
    return whole.filter(length >= F.greatest(F.lit(LEAST_WORDS), LEAST_PERIODS * F.col("period"))).select("rid", "start", length.alias("length"), "period")


def _sum_up(batches):
    """Digests of each document's runs, and of the words that stay."""
    import pyarrow as pa

    for batch in batches:
        out = []
        for _id, text, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs = sorted((r["start"], r["period"], r["length"]) for r in runs or [])
            words = text.encode("utf-8", "surrogatepass").split(b" ")
            gone = np.zeros(len(words) + 1, np.int64)
            for start, q, length in runs:
                gone[start + q] += 1
                gone[start + length] -= 1
            stay = np.cumsum(gone)[:-1] == 0
            top = min(runs, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1]), default=None)
            lines = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
            kept = b" ".join(w for w, s in zip(words, stay.tolist(), strict=True) if s)
            out.append((_id, len(runs), *((top[0], top[2], top[1], 1000 * top[2] // top[1]) if top else (None,) * 4),
                        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
        types = [batch.schema.field(0).type, *[pa.int64()] * 5, pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(types), types, strict=True)], names=NAMES)


NAMES = ["id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def read_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable | None = None) -> DataFrame:
    """Documents and their tiles, stored together (schema ``ROW``)."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text"))
    return materialize(slim.mapInArrow(_read(kind, change), ROW.format(kind=kind)), "documents_and_tiles")


def runs_of(read: DataFrame) -> DataFrame:
    """(rid, start, length, period): all runs of what ``read_documents`` stored."""
    n = int(read.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = read.filter("g is not null").select("rid", "g", "start", "tile", "marks").repartition(n, F.xxhash64("rid", "g", "start"))
    return stitched(dealt.mapInArrow(_solve, "rid long, period long, first long, end long"))


def periodic(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             change: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_runs; start, length, period and
    exponent_milli (1000 * length / period, rounded down) of the run with the
    greatest length / period (ties: smallest start, then period; null without
    runs); digests of all runs and of the words that are in no run, or among
    the first ``period`` words of each run they are in.  ``change(id, words)``
    may replace a text's words.

    Null and empty texts have no words and no runs: both digests are those of
    the empty string.  Repeated rows and ids are each a document of their own.
    An empty table gives no rows; other columns are ignored.
    """
    read = read_documents(docs, id_col, text_col, change)
    runs = materialize(runs_of(read), "runs")
    # A document has fewer runs than words, so its list is bounded by its text.
    lists = runs.groupBy("rid").agg(F.collect_list(F.struct("start", "period", "length")).alias("runs"))
    kind = docs.schema[id_col].dataType.simpleString()
    # Texts with boundaries grow with the input: their join is a shuffle at any size.
    some = read.filter("g is null and text is not null").select("rid", "id", "text").hint("merge").join(lists, "rid", "left").select("id", "text", "runs")
    some = some.mapInArrow(_sum_up, f"id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
    null = F.lit(None).cast("long")
    none = read.filter("g is null and plain is not null").select(
        "id", F.lit(0).cast("long").alias("n_runs"), *[null.alias(c) for c in NAMES[2:6]], F.sha2(F.lit(""), 256).alias("runs_sha256"), F.col("plain").alias("collapsed_sha256"))
    return some.unionByName(none)
