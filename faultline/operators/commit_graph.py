"""Commit graph and tree state: first-parent order, commits a release holds, files at a release (S-4, S-7, J-9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def first_parent_order(parents: DataFrame) -> DataFrame:
    """(project, sha, root, depth): for each commit the first commit of its
    first-parent chain and the number of steps to it.

    ``parents`` has (project, sha, parent, parent_no), ``parent`` null for a
    commit without parents and ``parent_no`` 0 for the first one.  A parent
    that is not itself a commit of the table ends the chain (a shallow clone).
    List ranking by pointer doubling: every round doubles each pointer's reach,
    so a chain of n commits takes log2(n) joins.  Chains that reached their
    root leave the table; a join meets each node once, so neither long chains
    nor commits with very many children gather in a task.  A cycle is an error.
    """
    own = parents.filter("parent is null or parent_no = 0").groupBy("project", "sha").agg(F.min("parent").alias("parent"))
    # Commits go by numbers from here on: names are long, and every round shuffles them.
    own = materialize(own.withColumn("id", F.monotonically_increasing_id()), "commits")
    known = own.select("project", F.col("sha").alias("parent"), F.col("id").alias("at"))
    root = F.col("at").isNull()
    up = own.join(known, ["project", "parent"], "left").select("id", F.coalesce("at", "id").alias("at"), F.when(root, 0).otherwise(1).cast("long").alias("depth"), root.alias("done"))
    up = materialize(up, "first_parents")
    rounds = max(1, up.count()).bit_length() + 1
    # Finished rows are stored once and stay as targets of the others' pointers.
    finished, open_ = up.filter("done"), up.filter("NOT done")
    while not open_.isEmpty():
        if rounds == 0:
            raise ValueError("first parents form a cycle")
        rounds -= 1
        over = finished.unionByName(open_).select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("depth").alias("_depth"), F.col("done").alias("_done"))
        next_ = open_.drop("done").join(over, "at").select("id", F.col("_at").alias("at"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_done").alias("done"))
        up = materialize(next_, "first_parents")
        finished, open_ = finished.unionByName(up.filter("done")), up.filter("NOT done")
    roots = own.select(F.col("id").alias("at"), F.col("sha").alias("root"))
    return finished.join(roots, "at").join(own.select("project", "sha", "id"), "id").select("project", "sha", "root", "depth")


def _jumps(first: DataFrame, limit: int) -> list[DataFrame]:
    """Stored pointers (id, at) 1, 2, 4, … steps up the first-parent
    forest, until no commit has an ancestor that far.  ``limit`` rounds reach
    further than any chain, so pointers left after them follow a cycle."""
    out = [first]
    while len(out) <= limit:
        over = out[-1].select(F.col("id").alias("at"), F.col("at").alias("_at"))
        up = materialize(out[-1].join(over, "at").select("id", F.col("_at").alias("at")), "jumps")
        if up.isEmpty():
            return out
        out.append(up)
    raise ValueError("first parents form a cycle")


def first_releases(parents: DataFrame, tips: DataFrame) -> DataFrame:
    """(project, sha, ord): the first release that holds each commit, null where none does.

    ``parents`` is as for :func:`first_parent_order`; ``tips`` has (project, sha,
    ord), the commit each release was made from.  A release holds its commit and
    all ancestors of it, along first and merged parents.  Tips that are no commit
    of the table count for nothing; a commit with several tips takes the least.

    The least ordinal travels from tips to ancestors.  Along first parents it
    takes log2(length of the longest chain) joins by jump pointers; over merged
    parents one join, from those commits alone whose ordinal fell.  The two
    alternate until none falls: as often as a path to a commit leaves a
    first-parent chain.  Each join meets a commit once, and ordinals are reduced
    in the map tasks, so a commit with very many children gathers in no task.
    """
    key = ["project", "sha"]
    nodes = parents.groupBy(*key).agg(F.min(F.when(F.col("parent_no") == 0, F.col("parent"))).alias("first"))
    # Commits go by numbers from here on: names are long, and every join shuffles them.
    nodes = materialize(nodes.withColumn("id", F.monotonically_increasing_id()), "commits")
    ids = nodes.select(*key, "id")
    known = nodes.select("project", F.col("sha").alias("_sha"), F.col("id").alias("at"))
    first = nodes.select("project", "id", F.col("first").alias("_sha")).join(known, ["project", "_sha"]).select("id", "at")
    first = materialize(first, "first_parents")
    merged = parents.filter("parent_no > 0").select(*key, F.col("parent").alias("_sha")).distinct()
    merged = materialize(merged.join(known, ["project", "_sha"]).join(ids, key).select("id", "at"), "merged_parents")
    jumps = _jumps(first, max(1, nodes.count()).bit_length() + 1)

    def over(edges, found):
        return edges.join(found, "id").select(F.col("at").alias("id"), "ord")

    def least(x):
        return x.groupBy("id").agg(F.min("ord").alias("ord"))

    found = materialize(least(tips.filter("ord is not null").join(ids, key).select("id", "ord")), "tips")
    held = found.limit(0)
    while not found.isEmpty():
        for up in jumps:
            found = materialize(least(found.unionByName(over(up, found))), "held")
        before = held.select("id", F.col("ord").alias("_ord"))
        fell = materialize(found.join(before, "id", "left").filter("_ord is null or ord < _ord").select("id", "ord"), "fell")
        held = materialize(least(held.unionByName(fell)), "held")
        now = held.select("id", F.col("ord").alias("_ord"))
        found = materialize(least(over(merged, fell)).join(now, "id", "left").filter("_ord is null or ord < _ord").select("id", "ord"), "found")
    return nodes.select(*key, "id").join(held, "id", "left").select(*key, "ord")


def commits_not_in_release(parents: DataFrame, tips: DataFrame) -> DataFrame:
    """(project, sha): commits that no release holds (see :func:`first_releases`)."""
    return first_releases(parents, tips).filter("ord is null").select("project", "sha")


def path_events(changes: DataFrame) -> DataFrame:
    """(project, path, ord, at, present, sha): one row per path a change touches.
    A rename (``old_path`` of a RENAME) removes the old path and adds the new."""
    at = F.struct("committed_at", "sha").alias("at")
    kept = changes.select("project", "path", "ord", at, (F.upper("change_type") != "DELETE").alias("present"), "sha")
    if "old_path" not in changes.columns:
        return kept
    gone = changes.filter((F.upper("change_type") == "RENAME") & F.col("old_path").isNotNull() & (F.col("old_path") != F.col("path")))
    return kept.unionByName(gone.select("project", F.col("old_path").alias("path"), "ord", at, F.lit(False).alias("present"), "sha"))


def snapshot_tree(changes: DataFrame, releases: DataFrame) -> DataFrame:
    """(project, release_id, path, sha): the files that exist at each release,
    and the commit that last touched each.

    ``changes`` has (project, path, change_type, committed_at, sha, ord) and may
    have ``old_path``; ``ord`` is the ordinal of the release the commit belongs
    to, and ``releases`` has (project, release_id, ord, n_releases).  The last
    event of a path in a release (by commit time, then sha; of one commit, being
    there wins over being gone, so a path renamed onto itself stays) holds until
    the path's next event: an aggregate with map-side combining, then a window
    over at most one row per release and path.
    """
    last = path_events(changes).groupBy("project", "path", "ord").agg(F.max(F.struct("at", "present", "sha")).alias("e"))
    w = Window.partitionBy("project", "path").orderBy("ord")
    n = releases.select("project", "n_releases").distinct()  # one row a project
    spans = last.withColumn("_next", F.lead("ord").over(w)).filter("e.present").join(n, "project")
    until = F.coalesce(F.col("_next") - 1, F.col("n_releases"))
    rows = spans.select("project", "path", F.col("e.sha").alias("sha"), F.explode(F.sequence(F.col("ord"), until)).alias("ord"))
    return rows.join(releases.select("project", "release_id", "ord"), ["project", "ord"]).select("project", "release_id", "path", "sha")
