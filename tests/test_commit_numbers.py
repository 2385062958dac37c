import pytest

from faultline.operators import commit_graph

SCHEMA = "project string, sha string, parent string, parent_no int"
LONG = "x" * 40
#: Two projects share names; c and d merge; e's parent is no commit; one commit has no name.
ROWS = [(p, LONG + s, LONG + q if q else None, n) for p, s, q, n in (
    ("p", "a", None, 0), ("p", "b", "a", 0), ("p", "c", "b", 0), ("p", "d", "a", 0), ("p", "d", "c", 1), ("p", "e", "gone", 0),
    ("q", "a", None, 0), ("q", "b", "a", 0))] + [("p", None, LONG + "b", 0)]


def stored(monkeypatch):
    """The columns of every stored stage."""
    seen, plain = [], commit_graph.materialize
    monkeypatch.setattr(commit_graph, "materialize", lambda df, name: (seen.append((name, df.columns)), plain(df, name))[1])
    return seen


def test_first_parents_travel_as_numbers(spark, monkeypatch):
    seen = stored(monkeypatch)
    got = {(r.project, r.sha and r.sha[40:]): (r.root[40:], r.depth) for r in commit_graph.first_parent_order(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got == {("p", "a"): ("a", 0), ("p", "b"): ("a", 1), ("p", "c"): ("a", 2), ("p", "d"): ("a", 1), ("p", "e"): ("e", 0),
                   ("q", "a"): ("a", 0), ("q", "b"): ("a", 1), ("p", None): ("a", 2)}
    assert all("sha" not in columns for name, columns in seen if name != "commits")


def test_ordinals_travel_as_numbers(spark, monkeypatch):
    seen = stored(monkeypatch)
    tips = spark.createDataFrame([("p", LONG + "d", 2), ("p", LONG + "b", 1), ("p", LONG + "b", 3), ("q", LONG + "a", 5), ("q", "none", 1), ("p", None, 1)], "project string, sha string, ord int")
    got = {(r.project, r.sha and r.sha[40:]): r.ord for r in commit_graph.first_releases(spark.createDataFrame(ROWS, SCHEMA), tips).collect()}
    assert got == {("p", "a"): 1, ("p", "b"): 1, ("p", "c"): 2, ("p", "d"): 2, ("p", "e"): None, ("q", "a"): 5, ("q", "b"): None, ("p", None): None}
    assert all("sha" not in columns for name, columns in seen if name != "commits")


def test_a_cycle_is_an_error(spark):
    x = spark.createDataFrame([("p", "a", "b", 0), ("p", "b", "a", 0)], SCHEMA)
    with pytest.raises(ValueError):
        commit_graph.first_parent_order(x)
