"""The method-level dataset: assembly, release cut, typing and profile (P-9…P-13, A-16, K-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hints import broadcast_if_small
from ..session import materialize

# Column order of the dataset file.
DATASET_COLUMNS = ("ProjectName", "Release", "MethodName", "LOC", "ParameterCount", "CycloComplexity",
                   "CognitiveComplexity", "NestingDepth", "Revisions", "Authors", "TotalChurn", "MaxChurn",
                   "AvgChurn", "NumberOfCodeSmells", "Bugginess")
NON_FEATURES = ("ProjectName", "Release", "MethodName")
LABEL = "Bugginess"

DATASET_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in NON_FEATURES]
    + [T.StructField(c, T.LongType()) for c in DATASET_COLUMNS[3:12]]
    + [T.StructField("AvgChurn", T.DoubleType()), T.StructField("NumberOfCodeSmells", T.LongType()),
       T.StructField(LABEL, T.StringType())])


def assemble(methods: DataFrame, metrics: DataFrame, churn: DataFrame, labelled: DataFrame,
             smells: DataFrame, releases: DataFrame, metric_key: str = "method_ord") -> DataFrame:
    """One row per (project, release, method) with the 15 dataset columns.

    ``methods``: project, release_id, path, method_ord, signature;
    ``metrics``: metric_key, loc, params, cyclomatic, cognitive, nesting;
    ``churn``/``labelled``: per (project, release_id, path);
    ``smells``: per (project, release_id, path, method_ord).
    All joins are equi-joins on the method's or the file's key.  Churn and
    labels meet first, one row per file and release, and are stored as the
    smells are: where the stored tables are small, the methods (files × methods
    of a file, by far the largest table) are joined without a shuffle.
    """
    k_file = ["project", "release_id", "path"]
    files = materialize(churn.join(labelled.select(*k_file, "buggy"), k_file, "full"), "file_facts")
    x = (methods.join(broadcast_if_small(metrics), metric_key, "left")
         .join(broadcast_if_small(files), k_file, "left")
         .join(broadcast_if_small(materialize(smells, "method_smells")), [*k_file, "method_ord"], "left")
         .join(broadcast_if_small(releases.select("project", "release_id", F.col("name").alias("Release"))),
               ["project", "release_id"]))
    z = F.lit(0)
    return x.select(
        F.col("project").alias("ProjectName"), "Release",
        F.concat_ws("/", "path", "signature").alias("MethodName"),
        F.coalesce("loc", z).cast("bigint").alias("LOC"),
        F.coalesce("params", z).cast("bigint").alias("ParameterCount"),
        F.coalesce("cyclomatic", z).cast("bigint").alias("CycloComplexity"),
        F.coalesce("cognitive", z).cast("bigint").alias("CognitiveComplexity"),
        F.coalesce("nesting", z).cast("bigint").alias("NestingDepth"),
        F.coalesce("revisions", z).cast("bigint").alias("Revisions"),
        F.coalesce("authors", z).cast("bigint").alias("Authors"),
        F.coalesce("total_churn", z).cast("bigint").alias("TotalChurn"),
        F.coalesce("max_churn", z).cast("bigint").alias("MaxChurn"),
        F.coalesce("avg_churn", F.lit(0.0)).alias("AvgChurn"),
        F.coalesce("n_smells", z).cast("bigint").alias("NumberOfCodeSmells"),
        F.when(F.coalesce("buggy", F.lit(False)), "yes").otherwise("no").alias(LABEL))


def release_cut(df: DataFrame, cut: float = 0.34, order: str = "date", release: str = "Release",
                releases: DataFrame | None = None, project: str | None = None) -> DataFrame:
    """P-10, P-9, A-16: keep the rows of the first ``round(n·cut)`` releases
    (at least 1, at most n).

    ``order="name"`` sorts the distinct release names as strings, as the
    reference does (``1.10`` before ``1.2``); ``order="date"`` (default) sorts
    by ``releases.release_date`` (``releases``: project, name, release_date).  Ranking runs on the distinct-release table,
    one row per release; rows are kept with a semi join against it.
    With ``project`` set the cut is made per project.
    """
    keys = [project] if project else []
    rel = df.select(*keys, release).distinct()
    if order == "date":
        if releases is None:
            raise ValueError("order='date' needs the releases table")
        r = releases.select(*([F.col("project").alias(project)] if project else []),
                            F.col("name").alias(release), "release_date")
        if not project:
            r = r.groupBy(release).agg(F.min("release_date").alias("release_date"))
        rel = rel.join(r, [*keys, release], "left")
        sort = [F.col("release_date"), F.col(release)]
    elif order == "name":
        sort = [F.col(release)]
    else:
        raise ValueError("order must be 'date' or 'name'")
    w = Window.partitionBy(*keys).orderBy(*sort) if keys else Window.orderBy(*sort)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys)) if keys else F.count(F.lit(1)).over(Window.partitionBy())
    rel = rel.withColumn("_rn", F.row_number().over(w)).withColumn("_n", n)
    keep_n = F.least(F.greatest(F.floor(F.col("_n") * F.lit(cut) + F.lit(0.5)), F.lit(1)), F.col("_n"))
    kept = rel.filter(F.col("_rn") <= keep_n).select(*keys, release)
    return df.join(kept, [*keys, release], "left_semi")


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """P-12: a cell that does not parse as a number becomes 0.0."""
    return df.select(*[(F.coalesce(F.expr(f"try_cast(`{c}` as double)"), F.lit(0.0)).alias(c) if c in cols
                        else F.col(c)) for c in df.columns])


def column_profile(df: DataFrame, max_nominal: int = 49) -> DataFrame:
    """P-13: for every string column, distinct non-null values and whether it is
    nominal (1…``max_nominal`` distinct values) or free text.  Each column is
    reduced to its distinct values on its own, so a stored table is read by
    columns and a column of few values shuffles next to nothing."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strings:
        return df.sparkSession.createDataFrame([], "column_name string, n_distinct bigint, kind string")
    out = None
    for c in strings:
        one = df.select(F.col(f"`{c}`").alias("v")).distinct().agg(F.count("v").alias("n_distinct"))
        one = one.select(F.lit(c).alias("column_name"), "n_distinct")
        out = one if out is None else out.unionByName(one)
    kind = F.when((F.col("n_distinct") >= 1) & (F.col("n_distinct") <= max_nominal), "nominal").otherwise("text")
    return out.select("column_name", F.col("n_distinct").cast("bigint").alias("n_distinct"), kind.alias("kind"))


def write_dataset_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K-1/K-2: header, fixed column order, RFC-4180 quoting, AvgChurn as %.2f."""
    cols = [F.format_string("%.2f", F.col(c)).alias(c) if c == "AvgChurn" else F.col(c) for c in DATASET_COLUMNS]
    (df.select(*cols).write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .csv(path))


def write_dataset_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Canonical copy of the dataset, partitioned by project and release."""
    df.write.mode(mode).partitionBy("ProjectName", "Release").parquet(path)


def read_dataset_csv(spark: SparkSession, path: str) -> DataFrame:
    """S-9: typed read (never inferred): release names stay strings (4.10 ≠ 4.1).
    A file without the ``Release`` column is refused."""
    head = spark.read.option("header", True).csv(path).columns
    if "Release" not in head:
        raise ValueError(f"{path}: no 'Release' column")
    return spark.read.option("header", True).schema(DATASET_SCHEMA).csv(path)
