"""Commits and tickets mapped onto releases (J-1, J-2, J-4, A-9, A-2, P-8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import asof_release


def commits_with_release(commits: DataFrame, releases: DataFrame) -> DataFrame:
    """J-1: each commit gets the first release on or after its (UTC) day; commits
    after the last release go to the last release."""
    return asof_release(commits, F.to_date("committed_at"), releases, fallback="last")


def release_activity(commits: DataFrame, releases: DataFrame, approx_authors: bool = False) -> DataFrame:
    """Per project and release: number of commits and distinct authors.

    Releases without commits do not appear (P-8).  ``approx_authors`` swaps the
    exact distinct count for HyperLogLog++ (A-2 option).
    """
    x = commits_with_release(commits.select("project", "author", "committed_at"), releases)
    authors = F.approx_count_distinct("author") if approx_authors else F.count_distinct("author")
    return (x.groupBy("project", "release_id", "release_date")
            .agg(F.count(F.lit(1)).alias("n_commits"), authors.alias("n_authors")))


def releases_with_commits(releases: DataFrame, commits_rel: DataFrame) -> DataFrame:
    """P-8: releases that received at least one commit (semi join)."""
    return releases.join(commits_rel.select("project", "release_id"), ["project", "release_id"], "left_semi")


def keep_releases(df: DataFrame, releases: DataFrame, on: list[str]) -> DataFrame:
    """P-9: rows of a set of releases (semi join; the release list is small)."""
    return df.join(releases.select(*on).distinct(), on, "left_semi")
