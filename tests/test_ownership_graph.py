import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import commit_graph, ownership


def by_stack(events):
    """(file, seq) -> methods around it, by an explicit stack."""
    out, stacks = {}, {}
    for file, seq, kind, phase in sorted(events):
        stack = stacks.setdefault(file, [])
        if kind == "m" and phase == "enter":
            stack.append(seq)
        out[file, seq] = list(stack)
        if kind == "m" and phase == "exit" and stack:
            stack.pop()
    return out


def random_events(seed, n):
    r = random.Random(seed)
    return [(f"f{r.randrange(3)}", i, r.choice("mmx"), r.choice(["enter", "exit"])) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_owner_is_the_innermost_open_method(spark, seed):
    events = random_events(seed, 400)  # with exits that close nothing, and methods that are never closed
    df = spark.createDataFrame(events, "file string, seq int, kind string, phase string").repartition(3)
    want = by_stack(events)
    own = ownership.owners(df, ["file"], F.col("kind") == "m").collect()
    assert {(r.file, r.seq): (r.owner, r.level) for r in own} == {k: (s[-1], len(s)) for k, s in want.items() if s}
    every = ownership.owners(df, ["file"], F.col("kind") == "m", count="all").collect()
    assert sorted((r.file, r.seq, r.owner, r.level) for r in every) == sorted((*k, o, i) for k, s in want.items() for i, o in enumerate(s, 1))
    assert ownership.owners(df.limit(0), ["file"], F.col("kind") == "m").count() == 0


def test_depth_along_first_parents(spark):
    r = random.Random(4)
    parent = {i: (None if i < 3 else r.randrange(i - 1, i) if i < 200 else r.randrange(i)) for i in range(400)}
    rows = [("p", str(i), None if p is None else str(p), 0) for i, p in parent.items()] + [("p", str(i), "0", 1) for i in range(10, 400, 7)]
    rows += [("q", "0", "not there", 0), ("q", "1", "0", 0)]
    got = {(x.project, x.sha): (x.root, x.depth) for x in commit_graph.first_parent_order(
        spark.createDataFrame(rows, "project string, sha string, parent string, parent_no int")).collect()}
    for i, p in parent.items():
        assert got["p", str(i)] == ((str(i), 0) if p is None else (got["p", str(p)][0], got["p", str(p)][1] + 1))
    assert got["q", "0"] == ("0", 0) and got["q", "1"] == ("0", 1) and len(got) == 402


def test_cycles_are_refused(spark):
    rows = [("p", "a", "b", 0), ("p", "b", "a", 0)]
    with pytest.raises(ValueError, match="cycle"):
        commit_graph.first_parent_order(spark.createDataFrame(rows, "project string, sha string, parent string, parent_no int"))


def test_first_release_that_holds_a_commit(spark):
    r = random.Random(5)
    parents = {i: sorted({r.randrange(max(0, i - r.choice([1, 1, 1, 40])), i) for _ in range(r.choice([1, 1, 2, 3]))}, key=lambda _: r.random()) for i in range(3, 90)}
    rows = [("p", str(i), None, 0) for i in range(3)] + [("p", str(i), str(p), no) for i, ps in parents.items() for no, p in enumerate(ps)]
    rows += [("q", "1", "not there", 0), ("q", "1", "nor there", 1), ("q", "2", "1", 0), ("q", "3", "0", 0), ("q", "0", None, None)]
    tips = [(str(r.randrange(90)), o) for o in range(1, 9)] + [("17", 30), ("17", 20), ("no commit", 1), ("4", None)]
    want = {("p", str(i)): None for i in range(90)} | {("q", "0"): None, ("q", "1"): 2, ("q", "2"): 2, ("q", "3"): None}
    for sha, o in tips:
        reach, seen = [int(sha)] if sha.isdigit() and o else [], set()
        while reach:
            if (at := reach.pop()) not in seen:
                seen.add(at)
                reach += parents.get(at, [])
        for at in seen:
            want["p", str(at)] = min(want["p", str(at)] or o, o)
    graph = spark.createDataFrame(rows, "project string, sha string, parent string, parent_no int")
    at = spark.createDataFrame([("p", *t) for t in tips] + [("q", "2", 2)], "project string, sha string, ord int")
    assert {(x.project, x.sha): x.ord for x in commit_graph.first_releases(graph, at).collect()} == want
    assert {tuple(x) for x in commit_graph.commits_not_in_release(graph, at).collect()} == {k for k, v in want.items() if v is None}
    assert commit_graph.commits_not_in_release(graph, at.limit(0)).count() == len(want)
    assert commit_graph.first_releases(graph.limit(0), at).count() == 0


def test_cycles_below_a_tip_are_refused(spark):
    graph = spark.createDataFrame([("p", "a", "b", 0), ("p", "b", "a", 0)], "project string, sha string, parent string, parent_no int")
    with pytest.raises(ValueError, match="cycle"):
        commit_graph.first_releases(graph, spark.createDataFrame([("p", "a", 1)], "project string, sha string, ord int"))


def test_deleted_and_renamed_files_leave_the_tree(spark):
    rows = [("p", "a", None, "ADD", 1, "1", 1), ("p", "b", None, "ADD", 1, "1", 1), ("p", "a", None, "DELETE", 2, "2", 2),
            ("p", "c", "b", "RENAME", 3, "3", 3), ("p", "a", None, "ADD", 4, "4", 4), ("p", "d", "c", "RENAME", 5, "5", 4), ("p", "e", None, "ADD", 2, "2", 2),
            ("p", "e", None, "DELETE", 2, "21", 2), ("p", "z", "z", "RENAME", 1, "1", 1)]
    changes = spark.createDataFrame(rows, "project string, path string, old_path string, change_type string, committed_at int, sha string, ord int")
    releases = spark.createDataFrame([("p", f"r{i}", i, 4) for i in range(1, 5)], "project string, release_id string, ord int, n_releases int")
    got = {(x.release_id, x.path, x.sha) for x in commit_graph.snapshot_tree(changes, releases).collect()}
    assert got == {("r1", "a", "1"), ("r1", "b", "1"), ("r2", "b", "1"), ("r3", "c", "3"), ("r4", "a", "4"), ("r4", "d", "5"), *((f"r{i}", "z", "1") for i in range(1, 5))}
