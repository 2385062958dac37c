"""Commit history per file: fixing commits, revisions, authors, churn (J-5, J-9, J-10, A-1…A-3, W-5, C-7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import fix_file, touched_file


def ticket_key_in_message(message: str = "message", project: str = "project") -> F.Column:
    """J-5: first ``<PROJECT>-<digits>`` in the message, any case, upper-cased.

    One literal pattern finds every ``word-digits`` in the message (so it is
    compiled once, whatever project a row has); the first whose word ends with
    the row's project is the key.
    """
    name = F.upper(F.col(project))
    found = F.regexp_extract_all(F.upper(F.col(message)), F.lit(r"\S*?-[0-9]+"), F.lit(0))
    own = F.filter(found, lambda c: F.endswith(F.regexp_replace(c, "-[0-9]+$", ""), name))
    return F.when(name != "", F.concat(name, F.lit("-"), F.substring_index(F.get(own, F.lit(0)), "-", -1)))


def fixing_commits(commits_rel: DataFrame, tickets: DataFrame) -> DataFrame:
    """Commits whose message names a ticket of the final list: (project, sha,
    ticket_key, release_id, release_date, ...).  Ticket keys are made unique
    first (a later duplicate would replace an earlier one in the reference)."""
    keys = tickets.select("project", F.upper("ticket_key").alias("ticket_key")).dropDuplicates()
    c = commits_rel.withColumn("ticket_key", ticket_key_in_message())
    return c.filter(F.col("ticket_key").isNotNull()).join(keys, ["project", "ticket_key"])


def fix_files(fixing: DataFrame, file_changes: DataFrame) -> DataFrame:
    """(project, sha, path) repaired by each fixing commit (P-5)."""
    fc = file_changes.filter(fix_file()).select("project", "sha", "path")
    return fc.join(fixing.select("project", "sha"), ["project", "sha"])


def touched(file_changes: DataFrame, commits_rel: DataFrame) -> DataFrame:
    """J-10: every (project, path, sha) a commit touched (P-6), with commit time,
    author, release ordinal and line counts."""
    fc = file_changes.filter(touched_file())
    keep = [c for c in ("project", "sha", "author", "committed_at", "release_id", "release_date", "ord")
            if c in commits_rel.columns]
    return fc.join(commits_rel.select(*keep), ["project", "sha"])


def file_history(touched_df: DataFrame) -> DataFrame:
    """A-1, A-2 over the whole history of each file (``history="all"``)."""
    return touched_df.groupBy("project", "path").agg(
        F.count_distinct("sha").alias("revisions"),
        F.count_distinct("author").alias("authors"),
        F.min(F.to_date("committed_at")).alias("first_day"),
        F.max(F.to_date("committed_at")).alias("last_day"))


def file_churn(touched_df: DataFrame, snapshots: DataFrame, history: str = "as_of_release",
               churn_of: str = "added") -> DataFrame:
    """Revisions, authors and churn of each snapshot file (A-1…A-3, W-5).

    Churn is measured between consecutive revisions of a file, so the oldest
    revision of a file contributes none; with line counts landed per change the
    pair (i-1, i) is the added/deleted count of revision i.  total = Σ(added +
    deleted); max and avg over ``added`` (``churn_of="added"``, as the
    reference) or over added + deleted.  0 when there is no pair.

    ``history="as_of_release"`` counts commits of releases up to the
    snapshot's; ``"all"`` counts the whole history (the reference's leakage).

    Plan: the oldest revision per file comes from an aggregate (partial
    aggregation, skew-safe); revisions are pre-aggregated to one row per
    (file, release) before the per-file running sums, so a hot file never
    puts more than (number of releases) rows into one window group.
    """
    t = touched_df
    first = t.groupBy("project", "path").agg(
        F.min(F.struct("committed_at", "sha")).alias("_first"))
    t = t.join(first, ["project", "path"])
    is_pair = ~((F.col("committed_at") == F.col("_first.committed_at")) & (F.col("sha") == F.col("_first.sha")))
    size = F.col("added") if churn_of == "added" else F.col("added") + F.col("deleted")
    t = t.withColumn("_pair", is_pair)
    # New authors: the release of each author's first touch of the file.
    auth = t.groupBy("project", "path", "author").agg(F.min("ord").alias("ord")) \
        .groupBy("project", "path", "ord").agg(F.count(F.lit(1)).alias("new_authors"))
    inc = t.groupBy("project", "path", "ord").agg(
        F.count(F.lit(1)).alias("revs"),  # a commit changes a path once
        F.sum(F.when(F.col("_pair"), F.col("added") + F.col("deleted")).otherwise(0)).alias("churn"),
        F.max(F.when(F.col("_pair"), size)).alias("max_size"),
        F.sum(F.when(F.col("_pair"), size).otherwise(0)).alias("sum_size"),
        F.count(F.when(F.col("_pair"), F.lit(1))).alias("pairs"))
    inc = inc.join(auth, ["project", "path", "ord"], "left")
    snaps = snapshots.select("project", "path", "release_id", "ord")
    if history == "all":
        tot = inc.groupBy("project", "path").agg(
            F.sum("revs").alias("revisions"), F.sum("new_authors").alias("authors"),
            F.sum("churn").alias("total"), F.max("max_size").alias("mx"),
            F.sum("sum_size").alias("ssum"), F.sum("pairs").alias("np"))
        x = snaps.join(tot, ["project", "path"], "left")
    elif history == "as_of_release":
        w = Window.partitionBy("project", "path").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
        u = (inc.select("project", "path", "ord", "revs", "new_authors", "churn", "max_size", "sum_size", "pairs",
                        F.lit(None).cast("string").alias("release_id"))
             .unionByName(snaps.select("project", "path", "ord", "release_id"), allowMissingColumns=True))
        x = (u.select("project", "path", "ord", "release_id",
                      F.sum("revs").over(w).alias("revisions"), F.sum("new_authors").over(w).alias("authors"),
                      F.sum("churn").over(w).alias("total"), F.max("max_size").over(w).alias("mx"),
                      F.sum("sum_size").over(w).alias("ssum"), F.sum("pairs").over(w).alias("np"))
             .filter(F.col("release_id").isNotNull()))
    else:
        raise ValueError("history must be 'as_of_release' or 'all'")
    zero = F.lit(0)
    return x.select(
        "project", "release_id", "path",
        F.coalesce(F.col("revisions"), zero).cast("bigint").alias("revisions"),
        F.coalesce(F.col("authors"), zero).cast("bigint").alias("authors"),
        F.coalesce(F.col("total"), zero).cast("bigint").alias("total_churn"),
        F.coalesce(F.col("mx"), zero).cast("bigint").alias("max_churn"),
        F.when(F.col("np") > 0, F.col("ssum") / F.col("np")).otherwise(F.lit(0.0)).alias("avg_churn"))


def release_snapshot_commit(commits_rel: DataFrame, snapshot: str = "newest") -> DataFrame:
    """J-9: the commit whose tree is a release's snapshot, per (project, release).

    ``"newest"``: latest commit of the release (the documented intent);
    ``"log_last"``: the oldest, which is what the reference's list order gives.
    An aggregate (max_by/min_by), so hot releases are pre-aggregated map-side.
    """
    order = F.struct("committed_at", "sha")
    pick = F.max_by("sha", order) if snapshot == "newest" else F.min_by("sha", order)
    day = F.max("committed_at") if snapshot == "newest" else F.min("committed_at")
    return (commits_rel.groupBy("project", "release_id")
            .agg(pick.alias("sha"), F.to_date(day).alias("commit_day"), F.count(F.lit(1)).alias("n_commits")))


def line_churn(revisions: DataFrame, path: str = "path", rev: str = "rev", content: str = "content") -> DataFrame:
    """C-7 re-aimed: lines added/deleted between consecutive revisions of a file
    as a difference of line multisets (a moved line counts 0, not 1 + 1 as in
    a diff).  Every revision but the first of its file gets one row.

    Each revision's line counts enter twice: +n for itself and −n for the
    revision that follows it; one ``groupBy(file, revision, line)`` then gives
    the per-line difference, so the work is a single shuffle of the lines.
    Consecutive revisions come from exact positions per file.
    """
    from .sampling import row_positions

    revs = revisions.select(path, rev, content)
    # Revision order per file from exact positions (no window over a whole
    # file's history); the next revision is the one at position + 1.
    pos = row_positions(revs.select(path, rev), [path], [rev], broadcast_offsets=False)
    nxt = pos.select(path, (F.col("_pos") - 1).alias("_pos"), F.col(rev).alias("_next"))
    order = (pos.join(nxt, [path, "_pos"], "left")
             .select(path, rev, F.when(F.col("_pos") > 1, F.lit(1)).alias("_prev"), "_next"))
    text = F.regexp_replace(F.col(content), r"(\r?\n)+$", "")
    lines = (revs.select(path, rev, F.explode(F.split(text, r"\r?\n")).alias("line"))
             .groupBy(path, rev, "line").agg(F.count(F.lit(1)).alias("n"))
             .join(order, [path, rev]))
    cur = lines.filter(F.col("_prev").isNotNull()).select(path, rev, "line", F.col("n").alias("delta"))
    old = lines.filter(F.col("_next").isNotNull()).select(path, F.col("_next").alias(rev), "line",
                                                          (-F.col("n")).alias("delta"))
    d = cur.unionByName(old).groupBy(path, rev, "line").agg(F.sum("delta").alias("d"))
    return d.groupBy(path, rev).agg(
        F.sum(F.greatest(F.col("d"), F.lit(0))).cast("bigint").alias("added"),
        F.sum(F.greatest(-F.col("d"), F.lit(0))).cast("bigint").alias("deleted"))
