"""Owner of each syntax event: the innermost open method (C-1).

A method's body may hold further methods (nested and anonymous classes).  Their
nesting level is a running count of open methods, and an event on level l
belongs to the last method opened on that level: a stack, kept as running
values over ``seq``.  Running values are taken in two phases, inside range
partitions and from one partition to the next, so a very long file is spread
over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hints import broadcast_if_small
from ..session import materialize

#: How two running values of a kind combine, and the aggregate of each.
COMBINE = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": (F.max, F.greatest), "min": (F.min, F.least)}


def running(df: DataFrame, group: list[str], order: str, name: str, kind: str, value: str) -> DataFrame:
    """``df`` with ``name``, the running ``kind`` of ``value`` in each group up to
    and with the row.  One offset per (group, partition); groups may grow with
    the data, so the offsets are broadcast only if they are small."""
    agg, combine = COMBINE[kind]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Stored: both phases must see the same range bounds.
    h = materialize(df.repartitionByRange(n, *group, order).withColumn("_pid", F.spark_partition_id()), "running")
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = h.groupBy(*group, "_pid").agg(agg(value).alias("_t")).select(*group, "_pid", agg("_t").over(before).alias("_off"))
    upto = Window.partitionBy(*group, "_pid").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = h.withColumn("_run", agg(value).over(upto))
    x = local.join(broadcast_if_small(materialize(off, "running_offsets")), [*group, "_pid"])
    return x.withColumn(name, combine(F.col("_off"), F.col("_run"))).drop("_pid", "_off", "_run", *([value] if value.startswith("_") else []))


def method_levels(events: DataFrame, file: list[str], is_method: Column) -> DataFrame:
    """``events`` with ``level``: how many methods are open around the event, the
    one it opens or closes included.  An exit without an open method closes
    nothing and is on level 0."""
    enter = F.col("phase") == "enter"
    step = F.when(is_method & enter, 1).when(is_method, -1).otherwise(0)
    x = running(events.withColumn("_method", is_method).withColumn("_step", step), file, "seq", "_cum", "sum", "_step")
    opens = F.col("_method") & enter
    x = x.withColumn("_was", F.col("_cum") - F.when(opens, 1).when(F.col("_method"), -1).otherwise(0))
    x = running(x.withColumn("_before", F.col("_was")), file, "seq", "_low", "min", "_before")
    return x.withColumn("level", (F.col("_was") - F.col("_low") + F.when(opens, 1).otherwise(0)).cast("int")).drop("_cum", "_was", "_low")


def owners(events: DataFrame, file: list[str], is_method: Column, count: str = "own") -> DataFrame:
    """``events`` with ``owner``, the ``seq`` that opened its method, and ``level``.

    ``count="own"`` gives each event to the innermost method only; ``"all"``
    gives it to every method around it, one row each, as a visitor that walks
    a method's whole body counts.  Events outside methods are left out.
    ``events`` has ``file`` columns, ``seq`` (unique in a file) and ``phase``.
    """
    if count not in ("own", "all"):
        raise ValueError("count must be 'own' or 'all'")
    x = method_levels(events, file, is_method).filter("level > 0")
    opened = F.when(F.col("_method") & (F.col("phase") == "enter"), F.col("seq"))
    if count == "all":
        x = x.withColumn("_at", F.explode(F.sequence(F.lit(1), F.col("level"))))
        x = x.withColumn("_open", F.when(F.col("_at") == F.col("level"), opened)).withColumn("level", F.col("_at")).drop("_at")
    else:
        x = x.withColumn("_open", opened)
    return running(x, [*file, "level"], "seq", "owner", "max", "_open").drop("_method")
