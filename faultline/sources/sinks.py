"""File outputs (K-3, K-4, K-7, K-8, K-9).

Small reports (rankings, summaries: one row per feature or dataset) are
written as a single CSV file; row-level outputs keep their partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean_columns


def _csv(df: DataFrame, path: str, single: bool = False) -> None:
    out = df.coalesce(1) if single else df
    out.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_feature_ranking(ranking: DataFrame, path: str) -> None:
    """K-3: Rank, Feature, SpearmanRho, Actionable (one row per feature)."""
    _csv(ranking.orderBy("rank").select(F.col("rank").alias("Rank"), F.col("feature").alias("Feature"),
                                        F.col("spearman_rho").alias("SpearmanRho"),
                                        F.col("actionable").alias("Actionable")), path, single=True)


def write_method_ranking(rows: DataFrame, path: str) -> None:
    """K-4: Rank, Feature, FeatureValue, SpearmanRho for one method."""
    _csv(rows.orderBy("rank").select(F.col("rank").alias("Rank"), F.col("feature").alias("Feature"),
                                     F.col("feature_value").alias("FeatureValue"),
                                     F.col("spearman_rho").alias("SpearmanRho")), path, single=True)


def write_whatif_datasets(tagged: DataFrame, path: str) -> None:
    """K-7: the B+, B and C datasets, header names cleaned, one folder each
    (``dataset=`` partitions of one write)."""
    clean_columns(tagged.filter(F.col("dataset").isin("B+", "B", "C"))).write.mode("overwrite") \
        .partitionBy("dataset").option("header", True).csv(path)


def prediction_report(scored: DataFrame, name: str = "MethodName") -> tuple[DataFrame, DataFrame]:
    """K-9 / A-14: per-method lines (name, label, P(yes)) and one totals row
    (scored, predicted buggy, percentage, highest P(yes))."""
    lines = scored.select(name, F.when(F.col("pred") == 1, "yes").otherwise("no").alias("predicted"),
                          F.round("score", 4).alias("p_yes"))
    totals = scored.agg(F.count(F.lit(1)).alias("n_scored"), F.sum("pred").alias("n_predicted_buggy"),
                        F.round(F.avg("pred") * 100, 1).alias("pct_predicted_buggy"),
                        F.round(F.max("score"), 4).alias("max_p_yes"))
    return lines, totals
