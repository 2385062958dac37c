"""Rule violations → methods (S-8, J-8, A-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hints import broadcast_if_small
from ..functions.paths import class_of


def match_violations(violations: DataFrame, releases: DataFrame, methods: DataFrame,
                     match: str = "first") -> DataFrame:
    """J-8: each violation to one method of the release's snapshot.

    ``violations``: project, release_name, class, method[, beginline];
    ``methods``: project, release_id, path, method_ord, simple_name[, begin_line].
    The report of a release is found by release name (unknown name = missing
    report: no smells).  The class is the file name without ``.java``; the
    first file of that class (by path) and, in it, the first method of that
    name (by ordinal) take the violation.  ``match="signature_line"`` picks the
    method whose ``begin_line`` equals the violation's ``beginline`` instead.

    "First" is an aggregate (min) per (release, class, name) on the method
    table, so a hot class is pre-aggregated map-side; violations then join
    by equality.
    """
    rel = releases.select("project", F.col("name").alias("release_name"), "release_id")
    v = violations.join(broadcast_if_small(rel), ["project", "release_name"])
    m = methods.withColumn("class", class_of("path"))
    cls = ["project", "release_id", "class"]
    if match == "first":
        # One row per name, then one per class: the method table is read once and not joined to itself.
        cand = m.groupBy(*cls, "simple_name").agg(F.min(F.struct("path", "method_ord")).alias("pick"))
        first = cand.groupBy(*cls).agg(F.min("pick.path").alias("_first"))
        cand = cand.join(first, cls).filter(F.col("pick.path") == F.col("_first"))
        v = v.select(*cls, F.col("method").alias("simple_name"))
        return v.join(cand, [*cls, "simple_name"]).select("project", "release_id", "pick.path", "pick.method_ord")
    first_file = m.groupBy(*cls).agg(F.min("path").alias("path"))
    m = m.join(first_file, [*cls, "path"])
    if match == "signature_line":
        v = v.select("project", "release_id", "class", F.col("method").alias("simple_name"),
                     F.col("beginline").alias("begin_line"))
        return v.join(m, ["project", "release_id", "class", "simple_name", "begin_line"]).select(
            "project", "release_id", "path", "method_ord")
    raise ValueError("match must be 'first' or 'signature_line'")


#: Lines in one bin of the containment join.
BIN_LINES = 64


def range_smell_counts(violations: DataFrame, releases: DataFrame, methods: DataFrame, bin_lines: int = BIN_LINES) -> DataFrame:
    """J-8 and A-5 by line range: violations per method, each violation given
    to the innermost method of its class whose lines hold its ``beginline``.

    ``methods``: project, release_id, path, method_ord, begin_line, end_line
    (inclusive).  The innermost method is the one with the fewest lines (ties:
    the later begin, then the smaller ordinal); as in ``match_violations``,
    the first file of a class takes them.  Violations outside every method, or
    without a line, count nowhere; methods without a line range take none.

    Violations are counted per (class, line) before the join, so a class with
    very many of them sends at most one row per line and task, and a class
    spreads over its line bins.  A method has one row per bin that it touches.
    """
    rel = releases.select("project", F.col("name").alias("release_name"), "release_id")
    cls = ["project", "release_id", "class"]
    v = violations.join(broadcast_if_small(rel), ["project", "release_name"])
    v = v.groupBy(*cls, F.col("beginline").cast("long").alias("line")).agg(F.count(F.lit(1)).alias("n"))
    v = v.withColumn("bin", F.floor(F.col("line") / bin_lines))
    m = methods.filter("begin_line <= end_line").withColumn("class", class_of("path"))
    m = m.join(methods.withColumn("class", class_of("path")).groupBy(*cls).agg(F.min("path").alias("path")), [*cls, "path"])
    bins = F.sequence(F.floor(F.col("begin_line") / bin_lines), F.floor(F.col("end_line") / bin_lines))
    m = m.select(*cls, "path", "method_ord", F.col("begin_line").cast("long"), F.col("end_line").cast("long"), F.explode(bins).alias("bin"))
    held = v.join(m, [*cls, "bin"]).filter("line BETWEEN begin_line AND end_line")
    inner = F.struct((F.col("end_line") - F.col("begin_line")).alias("lines"), (-F.col("begin_line")).alias("up"), "method_ord")
    owner = held.groupBy(*cls, "path", "line", "n").agg(F.min(inner).alias("pick"))
    return owner.groupBy("project", "release_id", "path", F.col("pick.method_ord").alias("method_ord")).agg(F.sum("n").alias("n_smells"))


def smell_counts(matched: DataFrame) -> DataFrame:
    """A-5: violations per method (methods without any are absent; left-join
    and ``coalesce(…, 0)`` where a full table is needed)."""
    return matched.groupBy("project", "release_id", "path", "method_ord").agg(
        F.count(F.lit(1)).alias("n_smells"))
