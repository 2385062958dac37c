"""Proportion: estimating injected versions of tickets that lack one (A-6…A-8, R-1…R-3).

P of a ticket with known IV is (FV − IV) / (FV − OV) in days; it is not
computable when FV − OV ≤ 0 and dropped when negative.  A project with at least
``threshold`` tickets of known IV uses the mean of its P (−1 when none is
computable); otherwise a cold-start value: the median P of the *other*
projects (``cold_start="others"``) or, as the reference does, of the project
itself (``"self"``); 0.5 when there is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_release

# Fixed values of the reference heuristic.
COLD_START_THRESHOLD = 5
COLD_START_DEFAULT = 0.5
NOT_COMPUTABLE = -1.0


def ticket_p() -> F.Column:
    """P of one ticket; null when IV unknown or FV − OV ≤ 0, negative values kept."""
    den = F.datediff("fv_release_date", "ov_release_date")
    num = F.datediff("fv_release_date", "iv_release_date")
    return F.when(F.col("iv_release_date").isNotNull() & (den > 0), num.cast("double") / den)


def project_proportion(valid: DataFrame, cold_start: str = "others",
                       threshold: int = COLD_START_THRESHOLD) -> DataFrame:
    """Per project: n_known, n_computable, p_mean, p_cold, p_used, method."""
    p = ticket_p()
    per = valid.groupBy("project").agg(
        F.count("iv_release_id").alias("n_known"),
        F.count(F.when(p >= 0, p)).alias("n_computable"),
        F.avg(F.when(p >= 0, p)).alias("_mean"))
    per = per.withColumn("p_mean", F.coalesce("_mean", F.lit(NOT_COMPUTABLE))).drop("_mean")
    if cold_start == "self":
        cold = F.when(F.col("p_mean") >= 0, F.col("p_mean")).otherwise(F.lit(COLD_START_DEFAULT))
        per = per.withColumn("p_cold", cold)
    elif cold_start == "others":
        per = _median_of_others(per)
    else:
        raise ValueError("cold_start must be 'others' or 'self'")
    use_mean = F.col("n_known") >= threshold
    return (per.withColumn("p_used", F.when(use_mean, F.col("p_mean")).otherwise(F.col("p_cold")))
            .withColumn("method", F.when(use_mean, "mean").otherwise("cold_start")))


def _median_of_others(per: DataFrame) -> DataFrame:
    """``p_cold`` = median of the computable ``p_mean`` of all *other* projects.

    No project pairs are formed: with the contributing values ranked once, the
    median of "all but me" needs at most two ranks, found by equi-joins on rank.
    The ranking is over the per-project table (one row per project).
    """
    contrib = per.filter(F.col("p_mean") >= 0).select("project", "p_mean")
    ranked = contrib.withColumn("rn", F.row_number().over(Window.orderBy("p_mean", "project")))
    n = contrib.count()  # number of contributing projects: a scalar
    x = per.join(ranked.select("project", F.col("rn").alias("my_rn")), "project", "left")
    m = F.lit(n) - F.when(F.col("my_rn").isNotNull(), 1).otherwise(0)
    x = x.withColumn("_m", m)
    lo_j = F.floor((F.col("_m") + 1) / 2)       # 1-based index into the others' sorted list
    hi_j = F.floor(F.col("_m") / 2) + 1
    to_s = lambda j: F.when(F.col("my_rn").isNotNull() & (j >= F.col("my_rn")), j + 1).otherwise(j)
    x = x.withColumn("_a", to_s(lo_j)).withColumn("_b", to_s(hi_j))
    va = ranked.select(F.col("rn").alias("_a"), F.col("p_mean").alias("_va"))
    vb = ranked.select(F.col("rn").alias("_b"), F.col("p_mean").alias("_vb"))
    x = x.join(va, "_a", "left").join(vb, "_b", "left")
    cold = F.when(F.col("_m") <= 0, F.lit(COLD_START_DEFAULT)).otherwise((F.col("_va") + F.col("_vb")) / 2)
    return x.withColumn("p_cold", cold).select(*per.columns, "p_cold")


def estimate_injected(versions: DataFrame, releases: DataFrame, proportion: DataFrame) -> DataFrame:
    """R-1, J-3, P-4, R-2 over valid tickets.

    Tickets without IV get ``iv_date = FV − trunc((FV − OV)·P)`` mapped to a
    release (J-3, last release past the end).  Kept: IV known and IV ≤ FV.
    ``n_affected`` = releases in [IV, FV) for estimated tickets (R-2), the
    landed affected count otherwise.  ``releases`` must carry ``ord``.
    """
    v = versions.join(proportion.select("project", "p_used"), "project", "left")
    days = F.datediff("fv_release_date", "ov_release_date")
    est_day = F.date_sub("fv_release_date", (days * F.col("p_used")).cast("int"))
    todo = v.filter(F.col("iv_release_id").isNull()).withColumn("_est_day", est_day)
    done = v.filter(F.col("iv_release_id").isNotNull())
    todo = asof_release(todo, "_est_day", releases, prefix="e_", fallback="last", extra=("ord",))
    todo = (todo.withColumn("iv_release_id", F.col("e_release_id"))
            .withColumn("iv_release_date", F.col("e_release_date"))
            .withColumn("iv_ord", F.col("e_ord"))
            .withColumn("estimated", F.lit(True))
            .withColumn("n_affected", (F.col("fv_ord") - F.col("e_ord")).cast("bigint")))
    done = done.withColumn("estimated", F.lit(False)).withColumn("n_affected", F.col("n_av"))
    cols = ["project", "ticket_key", "created", "resolved", "ov_release_id", "fv_release_id", "fv_release_date",
            "iv_release_id", "iv_release_date", "estimated", "n_affected"]
    out = todo.select(*cols).unionByName(done.select(*cols))
    return out.filter(F.col("iv_release_id").isNotNull() & (F.col("iv_release_date") <= F.col("fv_release_date")))


def incremental_proportion(valid: DataFrame, threshold: int = COLD_START_THRESHOLD,
                           cold: DataFrame | None = None) -> DataFrame:
    """R-3 ``mode="incremental"``: each ticket's P is the mean computable P of the
    tickets of its project resolved *before* it (ties by key), when at least
    ``threshold`` of those had a known IV; otherwise the project's cold-start
    value (``cold``: project, p_cold; default 0.5).

    The "before me" sums are two-phase running sums over (resolved, key)
    within the project (range partitions + offsets), minus the ticket's own
    contribution, so a project holding most tickets is still spread over
    many tasks.
    """
    from .stats import running_sums

    p = ticket_p()
    x = valid.select("project", "ticket_key", "resolved",
                     F.when(F.col("iv_release_id").isNotNull(), 1).otherwise(0).alias("_k"),
                     F.when(p >= 0, 1).otherwise(0).alias("_c"),
                     F.when(p >= 0, p).otherwise(F.lit(0.0)).alias("_s"))
    r = running_sums(x, ["project"], ["resolved", "ticket_key"], ["_k", "_c", "_s"])
    known = F.col("cum__k") - F.col("_k")
    cnt = F.col("cum__c") - F.col("_c")
    mean = F.when(cnt > 0, (F.col("cum__s") - F.col("_s")) / cnt).otherwise(F.lit(NOT_COMPUTABLE))
    r = r.withColumn("known_before", known.cast("bigint")).withColumn("_mean", mean)
    if cold is not None:
        r = r.join(F.broadcast(cold.select("project", "p_cold")), "project", "left")  # one row per project
    else:
        r = r.withColumn("p_cold", F.lit(COLD_START_DEFAULT))
    return r.select("project", "ticket_key", "resolved", "known_before",
                    F.when(F.col("known_before") >= threshold, F.col("_mean"))
                    .otherwise(F.coalesce("p_cold", F.lit(COLD_START_DEFAULT))).alias("p_used"))
