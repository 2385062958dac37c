"""As-of lookups of dates against per-project release dates (J-1, J-2, J-3).

All comparisons in the reference are on calendar days: an event dated ``d``
belongs to the first release whose date is on or after ``d``.  Because the key
is a day, the range join becomes an **equi-join on (project, day)** against a
release calendar that has one row per project and day between the first and
last release.  The calendar grows with the time span covered, not with the
number of events, and the join key has high cardinality, so Spark (AQE) may
broadcast it when its measured size is small or shuffle-hash it otherwise; a
hot day is split by AQE skew handling.  Days before the first release clamp to
the first release; days after the last release get the last release
(``fallback="last"``) or null (``fallback=None``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BASE = ("release_id", "release_date")

# Calendars up to this many rows (project × day) are broadcast.
CALENDAR_BROADCAST_ROWS = 2_000_000


def release_calendar(releases: DataFrame, project: str = "project",
                     extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per (project, cal_day) for every day owned by a release.

    Release ``i`` owns ``(date[i-1], date[i]]``; the first owns its own date
    (earlier days are clamped to it by :func:`asof_release`).  Two releases on
    one date: the first in (date, id) order owns the day.
    """
    w = Window.partitionBy(project).orderBy("release_date", "release_id")
    r = releases.select(project, *_BASE, *extra).withColumn("_prev", F.lag("release_date").over(w))
    start = F.coalesce(F.date_add("_prev", 1), F.col("release_date"))
    return (r.filter(start <= F.col("release_date"))
            .select(project, *_BASE, *extra,
                    F.explode(F.sequence(start, F.col("release_date"))).alias("cal_day")))


def last_release(releases: DataFrame, project: str = "project", extra: tuple[str, ...] = ()) -> DataFrame:
    """Per project the last release in (date, id) order: one row per project."""
    cols = (*_BASE, *extra)
    best = F.max_by(F.struct(*cols), F.struct("release_date", "release_id"))
    return (releases.groupBy(project).agg(best.alias("_l"),
                                          F.min("release_date").alias("_first_date"))
            .select(project, "_first_date", F.col("_l.release_date").alias("_last_date"),
                    *[F.col(f"_l.{c}").alias(f"_l_{c}") for c in cols]))


def asof_release(df: DataFrame, day, releases: DataFrame, prefix: str = "",
                 fallback: str | None = "last", project: str = "project",
                 extra: tuple[str, ...] = ()) -> DataFrame:
    """Attach ``{prefix}release_id`` / ``{prefix}release_date`` (+ ``extra``) to ``df``.

    ``day`` is a date column or column name; ``releases`` has
    ``project, release_id, release_date`` (+ ``extra``).  Rows of ``df`` whose
    project has no release, or whose day is null, get nulls.
    """
    day = F.col(day) if isinstance(day, str) else day
    cols = (*_BASE, *extra)
    bounds = last_release(releases, project, extra)
    cal = release_calendar(releases, project, extra).select(
        F.col(project).alias("_cp"), "cal_day", *[F.col(c).alias(f"_c_{c}") for c in cols])
    # One row per project: a size bounded by the project list, broadcast.
    x = df.withColumn("_day", day.cast("date")).join(F.broadcast(bounds), project, "left")
    x = x.withColumn("_key", F.when(F.col("_day") < F.col("_first_date"), F.col("_first_date"))
                     .otherwise(F.col("_day")))
    x = x.join(_calendar_hint(cal, bounds), (x[project] == cal["_cp"]) & (x["_key"] == cal["cal_day"]), "left")
    if fallback == "last":
        past = F.col("_day") > F.col("_last_date")
        out = [F.when(past, F.col(f"_l_{c}")).otherwise(F.col(f"_c_{c}")).alias(prefix + c) for c in cols]
    elif fallback is None:
        out = [F.col(f"_c_{c}").alias(prefix + c) for c in cols]
    else:
        raise ValueError(f"fallback must be 'last' or None, not {fallback!r}")
    return x.select(*[x[c] for c in df.columns], *out)


_CALENDAR_ROWS: dict[int, int] = {}


def calendar_rows(bounds: DataFrame) -> int:
    """Exact row count of the release calendar: Σ over projects of
    (last − first + 1) days, from the per-project bounds (one row each).
    Remembered per bounds plan, so repeated as-of joins against the same
    releases run the (small) job once."""
    key = bounds.semanticHash()
    if key not in _CALENDAR_ROWS:
        n = bounds.agg(F.sum(F.datediff("_last_date", "_first_date") + 1)).first()[0]
        _CALENDAR_ROWS[key] = int(n or 0)
    return _CALENDAR_ROWS[key]


def _calendar_hint(cal: DataFrame, bounds: DataFrame) -> DataFrame:
    """Spark's size estimate for ``explode`` ignores how many rows it makes, so
    the calendar's real size is computed and the join strategy fixed: a
    broadcast below ``CALENDAR_BROADCAST_ROWS``, a shuffle-hash join on
    (project, day) — an evenly spread key — above it."""
    return F.broadcast(cal) if calendar_rows(bounds) <= CALENDAR_BROADCAST_ROWS else cal.hint("shuffle_hash")
