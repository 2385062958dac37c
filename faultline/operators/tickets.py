"""Issue → ticket: versions, affected versions and consistency (S-3, J-2, J-4, P-2, P-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import asof_release

KEY = ["project", "ticket_key"]

# Reasons a resolved issue is not kept as a ticket, in the order
# the consistency rule checks them.
REJECT_REASONS = ("no_opening_version", "no_fixed_version", "opening_after_fixed",
                  "opening_before_first_affected", "fixed_not_after_last_affected")


def affected_versions(issues: DataFrame, releases: DataFrame) -> DataFrame:
    """J-4: version names → releases of the same project; unknown names are
    dropped; result sorted by date: (project, ticket_key, affected
    array<struct<release_date, release_id>>).  Only tickets with at least one
    known name appear."""
    e = issues.select(*KEY, F.explode("affected_names").alias("name"))
    r = releases.select("project", "name", "release_date", "release_id")
    return (e.join(r, ["project", "name"])
            .groupBy(*KEY)
            .agg(F.array_sort(F.collect_list(F.struct("release_date", "release_id"))).alias("affected")))


def resolved_only(issues: DataFrame, resolved: str = "resolved") -> DataFrame:
    """P-2: keep issues with a resolution date (null, or blank text when landed raw)."""
    c = F.col(resolved)
    if dict(issues.dtypes)[resolved] == "string":
        return issues.filter(c.isNotNull() & (F.length(F.trim(c)) > 0))
    return issues.filter(c.isNotNull())


def ticket_versions(issues: DataFrame, releases: DataFrame) -> DataFrame:
    """OV, FV (J-2, null past the last release), affected versions, IV = first
    affected version, and ``reject_reason`` (null = valid, P-3).

    ``releases`` may carry ``ord`` (release ordinal); it is then returned as
    ``ov_ord`` / ``fv_ord`` / ``iv_ord``.
    """
    extra = ("ord",) if "ord" in releases.columns else ()
    x = resolved_only(issues)
    x = asof_release(x, "created", releases, prefix="ov_", fallback=None, extra=extra)
    x = asof_release(x, "resolved", releases, prefix="fv_", fallback=None, extra=extra)
    av = affected_versions(issues, releases)
    x = x.join(av, KEY, "left").withColumn("n_av", F.coalesce(F.size("affected"), F.lit(0)).cast("bigint"))
    first_av = F.element_at("affected", 1)
    last_av = F.element_at("affected", -1)
    has_av = F.col("n_av") > 0
    reason = (F.when(F.col("ov_release_id").isNull(), REJECT_REASONS[0])
              .when(F.col("fv_release_id").isNull(), REJECT_REASONS[1])
              .when(F.col("ov_release_date") > F.col("fv_release_date"), REJECT_REASONS[2])
              .when(has_av & (F.col("ov_release_date") < first_av["release_date"]), REJECT_REASONS[3])
              .when(has_av & (F.col("fv_release_date") <= last_av["release_date"]), REJECT_REASONS[4]))
    x = x.withColumn("reject_reason", reason)
    x = x.withColumn("iv_release_id", F.when(has_av, first_av["release_id"])) \
         .withColumn("iv_release_date", F.when(has_av, first_av["release_date"]))
    if extra:
        ords = releases.select("project", F.col("release_id").alias("iv_release_id"),
                               F.col("ord").alias("iv_ord"))
        x = x.join(ords, ["project", "iv_release_id"], "left")
    return x


def valid_tickets(versions: DataFrame) -> DataFrame:
    return versions.filter(F.col("reject_reason").isNull())


def reject_counts(issues: DataFrame, releases: DataFrame) -> DataFrame:
    """Audit of P-2/P-3: (project, reason, n_tickets); ``valid`` and ``unresolved`` included."""
    v = ticket_versions(issues, releases).select("project", F.coalesce("reject_reason", F.lit("valid")).alias("reason"))
    unresolved = issues.filter(F.col("resolved").isNull()).select("project", F.lit("unresolved").alias("reason"))
    return v.unionByName(unresolved).groupBy("project", "reason").agg(F.count(F.lit(1)).alias("n_tickets"))
