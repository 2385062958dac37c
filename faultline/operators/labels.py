"""Bug-introducing commits and release-by-release labels (J-6, J-7, U-1, A-10).

The reference expands every fixing commit into the list of all commits of the
injected releases (commit × commit).  Only the *releases* matter for labels,
so here a fixing commit is linked to injected releases, the bug-introducing
commit sets are counted, never listed, and labels come from distinct
(file, injected date, fixed date) intervals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hints import broadcast_if_small


def injected_links(fixing: DataFrame, tickets: DataFrame, link: str = "ticket") -> DataFrame:
    """(project, sha, fix_release_id, iv_release_id), distinct.

    ``link="ticket"``: the IV of the ticket the commit message names.
    ``link="release"``: the IVs of every ticket fixed in the commit's release
    (what the reference does).
    """
    fx = fixing.select("project", "sha", "ticket_key", F.col("release_id").alias("fix_release_id"))
    tk = tickets.select("project", F.upper("ticket_key").alias("ticket_key"), "iv_release_id", "fv_release_id") \
        .filter(F.col("iv_release_id").isNotNull())
    if link == "ticket":
        x = fx.join(tk, ["project", "ticket_key"])
    elif link == "release":
        per_release = tk.select("project", F.col("fv_release_id").alias("fix_release_id"), "iv_release_id").distinct()
        x = fx.join(per_release, ["project", "fix_release_id"])
    else:
        raise ValueError("link must be 'ticket' or 'release'")
    return x.select("project", "sha", "fix_release_id", "iv_release_id").distinct()


def bug_introducing_counts(links: DataFrame, commits_rel: DataFrame) -> DataFrame:
    """Per fixing commit: injected releases that have commits and the size of
    its bug-introducing commit set (the union of their commits, U-1)."""
    per_release = commits_rel.groupBy("project", "release_id").agg(F.count(F.lit(1)).alias("n"))
    x = links.join(broadcast_if_small(per_release.withColumnRenamed("release_id", "iv_release_id")),
                   ["project", "iv_release_id"])
    return x.groupBy("project", "sha", "fix_release_id").agg(
        F.count(F.lit(1)).alias("n_iv_releases"), F.sum("n").cast("bigint").alias("n_bug_introducing"))


def buggy_commits(links: DataFrame, commits_rel: DataFrame) -> DataFrame:
    """Commits flagged bug-introducing: those of any linked injected release
    (a semi join on the distinct release set, not a commit × commit list)."""
    ivs = links.select("project", F.col("iv_release_id").alias("release_id")).distinct()
    return commits_rel.join(ivs, ["project", "release_id"], "left_semi")


def buggy_intervals(links: DataFrame, fix_files: DataFrame, releases: DataFrame) -> DataFrame:
    """Distinct (project, path, iv_date, fv_date) from fixing commits with fix
    files and a linked injected release that has commits."""
    r = broadcast_if_small(releases.select("project", "release_id", "release_date"))
    x = (fix_files.join(links, ["project", "sha"])
         .join(r.withColumnRenamed("release_id", "iv_release_id").withColumnRenamed("release_date", "iv_date"),
               ["project", "iv_release_id"])
         .join(r.withColumnRenamed("release_id", "fix_release_id").withColumnRenamed("release_date", "fv_date"),
               ["project", "fix_release_id"]))
    return x.select("project", "path", "iv_date", "fv_date").distinct()


def merged(intervals: DataFrame) -> DataFrame:
    """Overlapping and touching intervals of a path as one: at most one per
    release, since intervals of one start are reduced to the longest first."""
    file = ["project", "path"]
    x = intervals.groupBy(*file, "iv_date").agg(F.max("fv_date").alias("fv_date")).filter("iv_date < fv_date")
    w = Window.partitionBy(*file).orderBy("iv_date")
    upto = F.max("fv_date").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("_new", F.when(F.col("iv_date") <= upto, 0).otherwise(1))
    x = x.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*file, "_run").agg(F.min("iv_date").alias("iv_date"), F.max("fv_date").alias("fv_date")).drop("_run")


def label_snapshots(snapshots: DataFrame, intervals: DataFrame) -> DataFrame:
    """J-7: a snapshot file is buggy when some interval of its path has
    iv_date ≤ snapshot date < fv_date.  Merged intervals are disjoint and at
    most one per release, so a snapshot meets at most one that holds its date."""
    hit = (snapshots.select("project", "release_id", "release_date", "path")
           .join(merged(intervals), ["project", "path"])
           .filter((F.col("iv_date") <= F.col("release_date")) & (F.col("release_date") < F.col("fv_date")))
           .select("project", "release_id", "path").distinct()
           .withColumn("buggy", F.lit(True)))
    return (snapshots.join(hit, ["project", "release_id", "path"], "left")
            .withColumn("buggy", F.coalesce("buggy", F.lit(False))))


def label_counters(fix_files: DataFrame, links: DataFrame, intervals: DataFrame,
                   labelled: DataFrame) -> DataFrame:
    """A-10: per project, fixing commits with fix files, fix files, intervals,
    buggy snapshot files (one ``agg`` per input, joined on project)."""
    ff = fix_files.join(links.select("project", "sha").distinct(), ["project", "sha"])
    a = ff.groupBy("project").agg(F.count_distinct("sha").alias("n_fix_commits"),
                                  F.count(F.lit(1)).alias("n_fix_files"))
    b = intervals.groupBy("project").agg(F.count(F.lit(1)).alias("n_intervals"))
    c = labelled.groupBy("project").agg(F.count(F.when(F.col("buggy"), 1)).alias("n_buggy_snapshots"),
                                        F.count(F.lit(1)).alias("n_snapshots"))
    return c.join(a, "project", "left").join(b, "project", "left").select(
        "project", F.coalesce("n_fix_commits", F.lit(0)).alias("n_fix_commits"),
        F.coalesce("n_fix_files", F.lit(0)).alias("n_fix_files"),
        F.coalesce("n_intervals", F.lit(0)).alias("n_intervals"), "n_buggy_snapshots", "n_snapshots")


def effective_links(links: DataFrame, commits_rel: DataFrame) -> DataFrame:
    """Links whose injected release has at least one commit (an empty release
    introduces nothing)."""
    rel = commits_rel.select("project", F.col("release_id").alias("iv_release_id")).distinct()
    return links.join(rel, ["project", "iv_release_id"], "left_semi")
