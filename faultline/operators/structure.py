"""Structural metrics over a table of syntax events (C-1…C-6, A-4, C-2).

Parsing source code is a per-file library job and is not built; its output is
a table.  Input here is an *event* table, one row per node entry and exit in
document order::

    events(<unit columns>, seq, kind, phase ['enter'|'exit'],
           [in_if_condition, in_else_if, is_else_if, operator,
            parent_operator, call_name, unit_name, extra_cyclo])

and a small fixed **rules** table (kind → weights).  Everything is computed by
one running sum per unit (a window partitioned by the unit, e.g. one method,
ordered by ``seq``) and one aggregate:

* nesting (C-5): max running count of open ``opens_depth`` nodes;
* cyclomatic (C-4): 1 + Σ ``cyclo`` (+ ``extra_cyclo``, e.g. switch entries − 1);
* cognitive (C-6): Σ ``cog_flat`` + ``cog_nested`` × level, where level is the
  running count of open ``opens_level`` nodes above the node.

``rules="intent"`` counts logical operators only and visits if-conditions and
else-if branches (an ``if`` that continues a chain, ``is_else_if``, costs 1
without nesting and opens no level of its own); ``rules="reference"`` reproduces the three confirmed quirks:
if-conditions are not visited, every binary expression counts unless it is an
arithmetic one under the same operator, and else-if branches are not visited.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Weights per node kind.
# (kind, cyclo, opens_depth, opens_level, cog_flat, cog_nested)
JAVA_RULES = [
    ("if", 1, 1, 1, 1, 1),
    ("for", 1, 1, 1, 1, 1),
    ("foreach", 1, 1, 1, 1, 1),
    ("while", 1, 1, 1, 1, 1),
    ("do", 0, 1, 1, 1, 1),
    ("switch", 0, 1, 1, 1, 1),
    ("try", 0, 1, 0, 0, 0),
    ("catch", 1, 1, 1, 1, 0),
    ("lambda", 0, 1, 0, 0, 0),
    ("else", 0, 0, 1, 1, 0),
    ("case", 0, 0, 0, 1, 0),
    ("labelled_break", 0, 0, 0, 1, 0),
    ("labelled_continue", 0, 0, 0, 1, 0),
    ("and", 1, 0, 0, 1, 0),
    ("or", 1, 0, 0, 1, 0),
    ("binary", 0, 0, 0, 0, 0),
    ("call", 0, 0, 0, 0, 0),
    ("param", 0, 0, 0, 0, 0),
]

# HTML tags read as Java node kinds, so that the same job can
# run on the ``pages`` table.
HTML_TAG_KINDS = [
    ("div", "if"), ("ul", "for"), ("ol", "foreach"), ("table", "while"), ("form", "do"),
    ("select", "switch"), ("option", "case"), ("section", "try"), ("aside", "catch"),
    ("nav", "lambda"), ("span", "else"), ("b", "and"), ("strong", "and"), ("i", "or"),
    ("em", "or"), ("a", "call"), ("meta", "param"),
]

RULE_COLS = ("cyclo", "opens_depth", "opens_level", "cog_flat", "cog_nested")


def rules_frame(spark: SparkSession, rules=JAVA_RULES) -> DataFrame:
    return spark.createDataFrame(rules, "kind string, cyclo int, opens_depth int, opens_level int, "
                                        "cog_flat int, cog_nested int")


def _opt(df: DataFrame, name: str, default) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


def structural_metrics(events: DataFrame, rules: DataFrame, unit: list[str],
                       mode: str = "intent") -> DataFrame:
    """Per unit: n_nodes, params (C-3), cyclomatic (C-4), nesting (C-5), cognitive (C-6)."""
    if mode not in ("intent", "reference"):
        raise ValueError("mode must be 'intent' or 'reference'")
    # The rules table is a fixed literal list (tens of rows): broadcast.
    e = events.join(F.broadcast(rules), "kind", "left").fillna(0, subset=list(RULE_COLS))
    enter = F.col("phase") == "enter"
    sign = F.when(enter, 1).otherwise(-1)
    in_cond = _opt(events, "in_if_condition", False).cast("boolean")
    in_else_if = _opt(events, "in_else_if", False).cast("boolean")
    op = _opt(events, "operator", None).cast("string")
    parent_op = _opt(events, "parent_operator", None).cast("string")
    recursive = (_opt(events, "call_name", None).cast("string") == _opt(events, "unit_name", None).cast("string"))
    visited = F.lit(True)
    if mode == "reference":
        visited = ~F.coalesce(in_cond, F.lit(False)) & ~F.coalesce(in_else_if, F.lit(False))
        # Every binary expression counts unless arithmetic under the same operator.
        binary_extra = F.when((F.col("kind") == "binary") & ~F.coalesce(parent_op == op, F.lit(False)), 1).otherwise(0)
        else_if = F.lit(False)
    else:
        binary_extra = F.lit(0)
        # An else-if continues the chain: +1 without nesting, and no level of its own.
        else_if = (F.col("kind") == "if") & F.coalesce(_opt(events, "is_else_if", False).cast("boolean"), F.lit(False))
    call_extra = F.when((F.col("kind") == "call") & F.coalesce(recursive, F.lit(False)), 1).otherwise(0)
    w = Window.partitionBy(*unit).orderBy("seq", F.when(enter, 1).otherwise(0)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    e = (e.withColumn("_d", sign * F.col("opens_depth"))
         .withColumn("_l", sign * F.col("opens_level") * F.when(visited & ~else_if, 1).otherwise(0))
         .withColumn("depth", F.sum("_d").over(w))
         .withColumn("level_after", F.sum("_l").over(w)))
    level = F.col("level_after") - F.col("_l")  # level of the node itself, before it opens one
    nested = F.when(else_if, 1).otherwise(F.col("cog_flat") + F.col("cog_nested") * level)
    cog = F.when(enter & visited, nested + binary_extra + call_extra)
    cyc = F.when(enter, F.col("cyclo") + _opt(events, "extra_cyclo", 0))
    return e.groupBy(*unit).agg(
        F.count(F.when(enter, 1)).alias("n_nodes"),
        F.count(F.when(enter & (F.col("kind") == "param"), 1)).alias("params"),
        (F.lit(1) + F.coalesce(F.sum(cyc), F.lit(0))).cast("bigint").alias("cyclomatic"),
        F.greatest(F.coalesce(F.max("depth"), F.lit(0)), F.lit(0)).cast("bigint").alias("nesting"),
        F.coalesce(F.sum(cog), F.lit(0)).cast("bigint").alias("cognitive"))


TAG_PATTERN = r"</?[a-zA-Z][a-zA-Z0-9]*[^>]*>"


def html_events(pages: DataFrame, unit: str = "page_id", html: str = "html") -> DataFrame:
    """Open/close tags of each page as syntax events (kind from HTML_TAG_KINDS)."""
    tags = pages.select(unit, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(TAG_PATTERN), 0))
                        .alias("seq", "tag"))
    name = F.lower(F.regexp_extract("tag", r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    kinds = F.create_map(*[x for pair in HTML_TAG_KINDS for x in (F.lit(pair[0]), F.lit(pair[1]))])
    return tags.select(unit, "seq", F.coalesce(kinds[name], name).alias("kind"),
                       F.when(F.col("tag").startswith("</"), "exit").otherwise("enter").alias("phase"))


def line_count(text: str | Column) -> Column:
    """A-4 / C-2: lines split on ``\\r?\\n`` with trailing empty lines dropped
    (Java ``split`` semantics: "" has 1 line, a text of only newlines 0)."""
    c = F.col(text) if isinstance(text, str) else text
    stripped = F.regexp_replace(c, r"(\r?\n)+$", "")
    return (F.when(c.isNull(), 0).when(c == "", 1).when(stripped == "", 0)
            .otherwise(F.size(F.split(stripped, r"\r?\n"))).cast("bigint"))
