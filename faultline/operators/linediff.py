"""Ordered line diff of consecutive revisions (C-7).

Added and deleted lines are those of a shortest edit script, so a moved line
counts on both sides.  A script's length follows from the longest common
subsequence of the lines: ``deleted = n - lcs`` and ``added = m - lcs``.  It
is computed bit-parallel, one machine word for 64 lines, with one row of bits
as state: memory is linear in the file, and a pair never needs a table of all
line pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines that stand more often than this keep their bit mask; others build it from their places.
MASKED = 64
#: Pairs in an Arrow batch: a batch holds whole files.
PAIRS = 200


def lines_of(text: str) -> list[str]:
    """Lines with their line feed: a last line without one differs from one with it."""
    parts = text.split("\n")
    return [line + "\n" for line in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence."""
    if len(a) > len(b):
        a, b = b, a
    places: dict = {}
    for i, line in enumerate(a):
        places.setdefault(line, []).append(i)

    def mask(at: list[int]) -> int:
        out = 0
        for i in at:
            out |= 1 << i
        return out

    often = {line: mask(at) for line, at in places.items() if len(at) > MASKED}
    full = (1 << len(a)) - 1
    row = full
    for line in b:
        if line in places:
            hit = row & (often[line] if line in often else mask(places[line]))
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def edit_counts(old: str, new: str) -> tuple[int, int]:
    """(added, deleted) lines of a shortest edit script."""
    a, b = lines_of(old), lines_of(new)
    n, m = len(a), len(b)
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    a, b = a[head:n - tail], b[head:m - tail]
    both = set(a) & set(b)  # a line of one side only is in no common subsequence
    same = head + tail + common_length([x for x in a if x in both], [x for x in b if x in both])
    return m - same, n - same


def line_diff(revisions: DataFrame, path: str = "path", rev: str = "rev", content: str = "content") -> DataFrame:
    """(path, rev, added, deleted) of each revision against the one before it.
    A file's first revision has no row, nor has a pair of which one content is
    null.  Revisions are put in order by exact positions, and each meets its
    predecessor in a join on (path, position), so a file with very many
    revisions is spread over tasks."""
    import pyarrow as pa

    from .sampling import row_positions

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS):
                part = batch.slice(at, PAIRS)
                found = [edit_counts(a, b) for a, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([f[0] for f in found], pa.int64()),
                                                  pa.array([f[1] for f in found], pa.int64())], names=[path, rev, "added", "deleted"])

    pos = row_positions(revisions.select(path, rev, content), [path], [rev], broadcast_offsets=False)
    before = pos.select(path, (F.col("_pos") + 1).alias("_pos"), F.col(content).alias("_old"))
    pair = pos.join(before, [path, "_pos"]).filter(F.col("_old").isNotNull() & F.col(content).isNotNull()).select(path, rev, "_old", content)
    kinds = dict(revisions.dtypes)
    return pair.mapInArrow(work, f"`{path}` {kinds[path]}, `{rev}` {kinds[rev]}, added long, deleted long")
