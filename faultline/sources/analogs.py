"""Engine tables derived from the landed test tables.

The reference mines issue trackers and git repositories; here those inputs are
landed tables.  On the shared test data they are *derived* by Spark from the
TPC-H-like tables so that every job's work grows with the data:

==============  ============================================================
commits         orders joined to customer; project = market segment
releases        per project and calendar quarter, the last commit day;
                the last two quarters of each project are left out so that
                commits after the last release exist
file_changes    lineitem rows of a commit, one row per (commit, path)
issues          orders with key divisible by 7 (the ticket side)
snapshots       per release, every path touched on or before the release
revisions       conversations: one file per conversation, one revision per turn
method_rows     lineitem as a method-level dataset with a planted label
text_methods    documents joined to labels as a second, small dataset
violations      events of type ``error``
==============  ============================================================

Every expression here has a twin in :mod:`faultline.plans.oracle` (DuckDB).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hints import broadcast_if_small
from ..session import materialize
from ..sources.tables import Tables


def commits(t: Tables) -> DataFrame:
    """commits(project, sha, author, committed_at, message)."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    c = t.customer.select("c_custkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey)
    project, key = F.col("c_mktsegment"), F.col("o_orderkey")
    message = (F.when(key % 7 == 0, F.concat(F.lit("fix "), F.lower(project), F.lit("-"), key.cast("string")))
               .when(key % 7 == 1, F.concat(F.lit("see "), project, F.lit("-"), (key - 1).cast("string")))
               .otherwise(F.lit("tidy")))
    return j.select(project.alias("project"), key.cast("string").alias("sha"),
                    F.concat(F.lit("dev"), (F.col("o_custkey") % 50).cast("string")).alias("author"),
                    F.col("o_orderdate").alias("committed_at"), message.alias("message"))


def releases(t: Tables, cm: DataFrame | None = None) -> DataFrame:
    """releases(project, release_id, name, release_date).

    Names are ``1.<ordinal>``; as strings ``1.10`` sorts before ``1.2``, which
    exercises the reference's string-ordered release cut.
    """
    cm = commits(t) if cm is None else cm
    q = (cm.select("project", (F.year("committed_at") * 10 + F.quarter("committed_at")).alias("qkey"),
                   F.to_date("committed_at").alias("d"))
         .groupBy("project", "qkey").agg(F.max("d").alias("release_date")))
    # The grouped table has one row per project and quarter: a small window.
    w = Window.partitionBy("project").orderBy("qkey")
    q = q.withColumn("ord", F.row_number().over(w)).withColumn(
        "n", F.count(F.lit(1)).over(Window.partitionBy("project")))
    return q.filter(F.col("ord") <= F.col("n") - 2).select(
        "project",
        F.concat_ws("-", "project", F.col("qkey").cast("string")).alias("release_id"),
        F.concat(F.lit("1."), (F.col("ord") - 1).cast("string")).alias("name"),
        "release_date")


def file_changes(t: Tables, cm: DataFrame | None = None) -> DataFrame:
    """file_changes(project, sha, path, change_type, added, deleted): one row per (sha, path)."""
    cm = commits(t) if cm is None else cm
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag")
    s = F.col("l_suppkey") % 10
    folder = F.when(s == 0, F.lit("test/")).when(s == 1, F.lit("main/test/")).otherwise(F.lit("main/"))
    ext = F.when(s == 2, F.lit(".kt")).otherwise(F.lit(".java"))
    path = F.concat(F.lit("core/src/"), folder, F.lit("F"), (F.col("l_partkey") % 200).cast("string"), ext)
    rows = li.select(F.col("l_orderkey").cast("string").alias("sha"), path.alias("path"),
                     "l_quantity", "l_discount", "l_returnflag")
    per_file = rows.groupBy("sha", "path").agg(
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("_r"),
        F.max((F.col("l_returnflag") == "A").cast("int")).alias("_a"),
        F.sum("l_quantity").cast("bigint").alias("added"),
        F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("deleted"))
    change = F.when(F.col("_r") == 1, "MODIFY").when(F.col("_a") == 1, "ADD").otherwise("DELETE")
    return per_file.join(cm.select("project", "sha"), "sha").select(
        "project", "sha", "path", change.alias("change_type"), "added", "deleted")


def issues(t: Tables, rel: DataFrame | None = None) -> DataFrame:
    """issues(project, ticket_key, created, resolved, affected_names array<string>).

    The landed form of the tracker's bug issues.  With k = orderkey div 7: the
    affected version is the release as of resolved + 120 days when k % 30 = 0
    (inconsistent on purpose), as of created - 150 days when k % 3 = 0, none
    otherwise; k % 50 = 7 is unresolved; k % 40 = 11 names an unknown version
    in front of the known one.
    """
    from ..operators.asof import asof_release

    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate").filter(F.col("o_orderkey") % 7 == 0)
    c = t.customer.select("c_custkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey)
    k = F.floor(F.col("o_orderkey") / 7)
    day = F.to_date("o_orderdate")
    base = j.select(F.col("c_mktsegment").alias("project"),
                    F.concat_ws("-", "c_mktsegment", F.col("o_orderkey").cast("string")).alias("ticket_key"),
                    F.date_sub(day, (F.col("o_orderkey") % 200).cast("int")).alias("created"),
                    F.when(k % 50 == 7, F.lit(None).cast("date")).otherwise(day).alias("resolved"),
                    day.alias("_day"), k.alias("_k"))
    probe = (F.when(F.col("_k") % 30 == 0, F.date_add("_day", 120))
             .when(F.col("_k") % 3 == 0, F.date_sub("created", 150)))
    rel = releases(t) if rel is None else rel
    x = asof_release(base.withColumn("_probe", probe), "_probe", rel, prefix="av_",
                     fallback=None, extra=("name",))
    known = F.when(F.col("av_name").isNull(), F.array().cast("array<string>")).otherwise(F.array("av_name"))
    names = F.when(F.col("_k") % 40 == 11, F.concat(F.array(F.lit("0.0-unknown")), known)).otherwise(known)
    return x.select("project", "ticket_key", "created", "resolved", names.alias("affected_names"))


#: Lines of development that the commits of a project are dealt to.
BRANCHES = 4


def commit_parents(t: Tables, cm: DataFrame | None = None) -> DataFrame:
    """commit_parents(project, sha, parent, parent_no): commits of one project
    and of orders with equal key modulo ``BRANCHES`` follow each other by date;
    every 16th commit also merges the order with the next key."""
    from ..operators.sampling import row_positions

    cm = commits(t) if cm is None else cm
    key = F.col("sha").cast("long")
    c = cm.select("project", "sha", "committed_at", (key % BRANCHES).alias("branch"))
    pos = row_positions(c, ["project", "branch"], ["committed_at", "sha"], broadcast_offsets=False)
    before = pos.select("project", "branch", (F.col("_pos") + 1).alias("_pos"), F.col("sha").alias("parent"))
    first = pos.join(before, ["project", "branch", "_pos"], "left").select("project", "sha", "parent", F.lit(0).alias("parent_no"))
    merged = c.filter(key % 16 == 0).select("project", "sha", (key + 1).cast("string").alias("parent"), F.lit(1).alias("parent_no"))
    return first.unionByName(merged)


def release_ordinals(rel: DataFrame) -> DataFrame:
    """releases + ``ord`` (1-based, by date then id) and ``n_releases`` per project.

    A window over the release list, which is small (releases per project).
    """
    w = Window.partitionBy("project").orderBy("release_date", "release_id")
    return (rel.withColumn("ord", F.row_number().over(w))
            .withColumn("n_releases", F.count(F.lit(1)).over(Window.partitionBy("project"))))


def snapshots(t: Tables, fc: DataFrame | None = None, cm: DataFrame | None = None,
              rel: DataFrame | None = None) -> DataFrame:
    """snapshots(project, release_id, release_date, ord, path): files present at each release.

    A file is present in every release from the one its first change falls in
    (as-of) to the last: the ordinal range is exploded and equi-joined back to
    the releases, so no project-wide range join is needed.
    """
    from ..operators.asof import asof_release

    cm = commits(t) if cm is None else cm
    fc = file_changes(t, cm) if fc is None else fc
    rel = releases(t, cm) if rel is None else rel
    ro = release_ordinals(rel)
    first = (fc.join(cm.select("project", "sha", F.to_date("committed_at").alias("d")), ["project", "sha"])
             .groupBy("project", "path").agg(F.min("d").alias("first_day")))
    x = asof_release(first, "first_day", ro, prefix="f_", fallback=None, extra=("ord", "n_releases"))
    x = x.filter(F.col("f_ord").isNotNull()).select(
        "project", "path", F.explode(F.sequence("f_ord", "f_n_releases")).alias("ord"))
    return x.join(ro.select("project", "ord", "release_id", "release_date"), ["project", "ord"]).select(
        "project", "release_id", "release_date", "ord", "path")


def revisions(t: Tables) -> DataFrame:
    """revisions(path, rev, content): one file per conversation, one revision per turn."""
    return t.conversations.select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("path"),
                                  F.col("turn").alias("rev"), F.col("text").alias("content"))


def word_revisions(t: Tables) -> DataFrame:
    """:func:`revisions` with one word a line, so that files have tens of lines."""
    return revisions(t).withColumn("content", F.translate("content", " ", "\n"))


def method_rows(t: Tables) -> DataFrame:
    """A method-level dataset on lineitem with a planted label.

    Columns: id, Project, Release, LOC, NestingDepth, ParameterCount, TotalChurn,
    ReturnFlag (no signal), Bugginess (yes/no), buggy (0/1).
    ``buggy = 0.02*LOC + 0.08*NestingDepth + u > 1.6`` with ``u`` uniform from
    md5 of the row.  (orderkey, linenumber) is not a key of lineitem, so the id
    also carries part, supplier and price in cents.
    """
    li = t.lineitem
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    rid = F.concat_ws("-", *[F.col(c).cast("string") for c in
                             ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], cents.cast("string"))
    seed = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.lit("42"))
    u = F.conv(F.substring(F.md5(seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    loc = F.col("l_quantity")
    nest = F.round(F.col("l_discount") * 100)
    buggy = (F.lit(0.02) * loc + F.lit(0.08) * nest + u) > 1.6
    return li.select(rid.alias("id"), F.concat(F.lit("p"), (F.col("l_suppkey") % 5).cast("string")).alias("Project"),
                     F.concat(F.lit("1."), F.year("l_shipdate").cast("string")).alias("Release"),
                     loc.alias("LOC"), nest.alias("NestingDepth"),
                     F.round(F.col("l_tax") * 100).alias("ParameterCount"),
                     F.col("l_extendedprice").alias("TotalChurn"),
                     F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("ReturnFlag"),
                     F.when(buggy, "yes").otherwise("no").alias("Bugginess"),
                     buggy.cast("int").alias("buggy"))


METHOD_FEATURES = ("LOC", "NestingDepth", "ParameterCount", "TotalChurn", "ReturnFlag")

TEXT_FEATURES = ("n_chars", "n_words", "non_letter_share", "distinct_word_share", "distinct_line_share")


def text_methods(t: Tables) -> DataFrame:
    """documents ⋈ labels as a small second dataset: whole-text features of
    each labelled document and ``buggy`` = (quality = 0)."""
    d = t.documents.select("doc_id", "text")
    lab = t.labels.select("doc_id", "quality")
    words = F.split(F.col("text"), r"\s+")
    lines = F.split(F.col("text"), r"\n")
    n = F.length("text")
    x = d.join(lab, "doc_id").select(
        F.col("doc_id").cast("string").alias("id"),
        n.cast("double").alias("n_chars"),
        F.size(words).cast("double").alias("n_words"),
        F.when(n > 0, F.length(F.regexp_replace("text", r"\p{L}", "")) / n).otherwise(0.0).alias("non_letter_share"),
        (F.size(F.array_distinct(words)) / F.size(words)).alias("distinct_word_share"),
        (F.size(F.array_distinct(lines)) / F.size(lines)).alias("distinct_line_share"),
        (F.col("quality") == 0).cast("int").alias("buggy"))
    return x


def violations(t: Tables) -> DataFrame:
    """violations(project, release_name, class, method, rule, beginline) from ``events``.

    One report row per ``error`` event: project ``user % 5``, report of release
    ``1.<event % 26>`` (names a project lacks stand for a missing report),
    class ``F<user % 200>``, method ``m<k>`` with k from the JSON props.
    """
    ev = t.events.filter(F.col("event_type") == "error")
    return ev.select(
        F.element_at(F.array(*[F.lit(p) for p in PROJECTS]), (F.col("user_id") % 5 + 1).cast("int")).alias("project"),
        F.concat(F.lit("1."), (F.col("event_id") % 26).cast("string")).alias("release_name"),
        F.concat(F.lit("F"), (F.col("user_id") % 200).cast("string")).alias("class"),
        F.concat(F.lit("m"), F.get_json_object("props", "$.k")).alias("method"),
        F.concat(F.lit("R"), (F.col("event_id") % 4).cast("string")).alias("rule"),
        (F.col("event_id") % 100).cast("int").alias("beginline"))


def page_methods(t: Tables) -> DataFrame:
    """Methods from ``pages``: page p is method ``m<p % 100>`` of class ``F<p % 200>``."""
    p = t.pages.select("page_id")
    name = F.concat(F.lit("m"), (F.col("page_id") % 100).cast("string"))
    return p.select(F.col("page_id").alias("method_ord"),
                    F.concat(F.lit("F"), (F.col("page_id") % 200).cast("string")).alias("class"),
                    name.alias("simple_name"),
                    F.concat(name, F.lit("("), F.col("page_id").cast("string"), F.lit(")")).alias("signature"))


def snapshot_methods(java_snapshots: DataFrame, pm: DataFrame) -> DataFrame:
    """methods(project, release_id, path, method_ord, simple_name, signature):
    every method of the class a snapshot file declares.  The files are dealt to
    all tasks first: there are few classes, and each file brings many methods."""
    from ..functions.paths import class_of

    spark = java_snapshots.sparkSession
    files = java_snapshots.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "project", "release_id", "path")
    s = files.select("project", "release_id", "path", class_of("path").alias("class"))
    return s.join(broadcast_if_small(materialize(pm, "page_methods")), "class").select("project", "release_id", "path", "method_ord", "simple_name", "signature")


def method_lines(t: Tables) -> DataFrame:
    """Line ranges of page methods: from line ``page % 100``, one line more per 500 characters."""
    begin = F.col("page_id") % 100
    size = F.floor(F.length(F.coalesce("html", F.lit(""))) / 500)
    return t.pages.select(F.col("page_id").alias("method_ord"), begin.alias("begin_line"), (begin + size).alias("end_line"))


# The market segments of the test data, which act as projects.
PROJECTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
