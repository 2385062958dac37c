"""Structural metrics against golden rows re-derived from the reference's checked-in metrics."""

import pytest

from faultline.operators import structure

SCHEMA = ("unit string, seq int, kind string, phase string, in_if_condition boolean, operator string, "
          "parent_operator string, call_name string, unit_name string")


def node(unit, seq, kind, *, cond=False, op=None, parent=None, call=None):
    return [(unit, seq, kind, "enter", cond, op, parent, call, unit),
            (unit, seq + 1000, kind, "exit", cond, op, parent, call, unit)]


def events(spark):
    rows = []
    # closeConnection: if (c != null) { try { c.close(); } catch (SQLException e) { throw ... } }
    u = "closeConnection"
    rows += [(u, 1, "if", "enter", False, None, None, None, u), (u, 2, "binary", "enter", True, "!=", None, None, u),
             (u, 3, "binary", "exit", True, "!=", None, None, u), (u, 4, "try", "enter", False, None, None, None, u),
             (u, 5, "call", "enter", False, None, None, "close", u), (u, 6, "call", "exit", False, None, None, "close", u),
             (u, 7, "catch", "enter", False, None, None, None, u), (u, 8, "catch", "exit", False, None, None, None, u),
             (u, 9, "try", "exit", False, None, None, None, u), (u, 10, "if", "exit", False, None, None, None, u)]
    # isRunning: return bookie.isRunning() && factory.isRunning() && running;
    u = "isRunning"
    rows += [(u, 1, "and", "enter", False, "&&", None, None, u), (u, 2, "and", "enter", False, "&&", "&&", None, u),
             (u, 3, "call", "enter", False, None, None, u, u), (u, 4, "call", "exit", False, None, None, u, u),
             (u, 5, "call", "enter", False, None, None, u, u), (u, 6, "call", "exit", False, None, None, u, u),
             (u, 7, "and", "exit", False, "&&", "&&", None, u), (u, 8, "and", "exit", False, "&&", None, None, u)]
    # isAutoRecoveryRunning: return this.m != null && this.m.isAutoRecoveryRunning();
    u = "isAutoRecoveryRunning"
    rows += [(u, 1, "and", "enter", False, "&&", None, None, u), (u, 2, "binary", "enter", False, "!=", "&&", None, u),
             (u, 3, "binary", "exit", False, "!=", "&&", None, u), (u, 4, "call", "enter", False, None, None, u, u),
             (u, 5, "call", "exit", False, None, None, u, u), (u, 6, "and", "exit", False, "&&", None, None, u)]
    # mapColumn-like: if (x) { s = "a" + b + c; }  (a chain of + counts once)
    u = "mapColumn"
    rows += [(u, 1, "if", "enter", False, None, None, None, u), (u, 2, "binary", "enter", False, "+", None, None, u),
             (u, 3, "binary", "enter", False, "+", "+", None, u), (u, 4, "binary", "exit", False, "+", "+", None, u),
             (u, 5, "binary", "exit", False, "+", None, None, u), (u, 6, "if", "exit", False, None, None, None, u)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("mode,expected", [
    ("reference", {"closeConnection": (3, 2, 3), "isRunning": (3, 4, 0), "isAutoRecoveryRunning": (2, 3, 0),
                   "mapColumn": (2, 2, 1)}),
    ("intent", {"closeConnection": (3, 2, 3), "isRunning": (3, 4, 0), "isAutoRecoveryRunning": (2, 2, 0),
                "mapColumn": (2, 1, 1)}),
])
def test_golden_methods(spark, mode, expected):
    m = structure.structural_metrics(events(spark), structure.rules_frame(spark), ["unit"], mode=mode)
    got = {r["unit"]: (r["cyclomatic"], r["cognitive"], r["nesting"]) for r in m.collect()}
    assert got == expected


def test_html_events_nesting(spark):
    pages = spark.createDataFrame([(1, "<div><ul><li>a</li><li>b</li></ul></div><div></div>")], "page_id long, html string")
    ev = structure.html_events(pages)
    m = structure.structural_metrics(ev, structure.rules_frame(spark), ["page_id"]).first()
    # div (if) > ul (for) nests 2; li has no rule; cyclomatic 1 + div + ul + div.
    assert m["nesting"] == 2 and m["cyclomatic"] == 4
    # cognitive: div 1 + ul (1 + level 1) + div 1
    assert m["cognitive"] == 4


def test_line_count_java_split(spark):
    df = spark.createDataFrame([("a\nb",), ("a\n\n",), ("",), ("\n\n",), ("a\r\nb\r\n",), (None,)], "t string")
    assert [r[0] for r in df.select(structure.line_count("t")).collect()] == [2, 1, 1, 0, 2, 0]


def test_else_if_continues_the_chain(spark):
    schema = "unit string, seq int, kind string, phase string, is_else_if boolean"
    plain = [("u", 1, "if", "enter", False), ("u", 2, "if", "enter", True), ("u", 7, "if", "exit", True), ("u", 8, "if", "exit", False)]
    inner = plain + [("u", 3, "if", "enter", False), ("u", 4, "if", "exit", False)]
    for rows, want in ((plain, 2), (inner, 4)):  # the inner if stands one level deep: 1 + 1
        m = structure.structural_metrics(spark.createDataFrame(rows, schema), structure.rules_frame(spark), ["unit"])
        assert m.first()["cognitive"] == want
