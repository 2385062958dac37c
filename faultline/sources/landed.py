"""Readers for the landed files of the reference's inputs and outputs (S-1…S-12).

Every reader declares its schema (nothing is inferred), reads all files of a
folder in one job, and turns malformed records into a side output instead of
failing the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dataset import DATASET_COLUMNS, DATASET_SCHEMA
from ..session import materialize

RELEASES_SCHEMA = T.StructType([T.StructField("versions", T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("releaseDate", T.StringType())])))])

ISSUE_PAGE_SCHEMA = T.StructType([
    T.StructField("total", T.IntegerType()),
    T.StructField("issues", T.ArrayType(T.StructType([
        T.StructField("key", T.StringType()),
        T.StructField("fields", T.StructType([
            T.StructField("created", T.StringType()),
            T.StructField("resolutiondate", T.StringType()),
            T.StructField("versions", T.ArrayType(T.StructType([T.StructField("name", T.StringType())])))]))]))),
    T.StructField("_corrupt_record", T.StringType())])

RESULT_FIELDS = ("avgPrecision", "avgRecall", "avgF1", "avgAuc", "avgKappa", "avgAccuracy", "avgNpofb20",
                 "precision", "recall", "f1", "auc", "kappa", "accuracy", "npofb20")
RESULTS_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("project", "classifierName", "featureSelection",
                                                "evaluationType", "modelFilePath")]
    + [T.StructField(c, T.DoubleType()) for c in RESULT_FIELDS]
    + [T.StructField("numberOfRuns", T.IntegerType()), T.StructField("_corrupt_record", T.StringType())])


def _file_stem() -> F.Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)


def _parent_dir() -> F.Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)


def read_releases(spark: SparkSession, path: str) -> DataFrame:
    """S-1 / P-1: one JSON document per project (file stem = project, in upper
    case everywhere, as issue keys have it); entries
    lacking id, name or date are dropped; (project, release_id, name,
    release_date).  Sorting happens only inside windows downstream."""
    raw = spark.read.schema(RELEASES_SCHEMA).option("multiLine", True).json(path)
    x = raw.select(F.upper(_file_stem()).alias("project"), F.explode("versions").alias("v"))
    x = x.select("project", F.col("v.id").alias("release_id"), F.col("v.name").alias("name"),
                 F.try_to_date(F.col("v.releaseDate")).alias("release_date"))
    return x.dropna(subset=["release_id", "name", "release_date"])


def read_issue_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S-2 / S-3: every result page of every project (files ``<PROJECT>*.json``
    or folders named by project) at once.  Returns (issues, corrupt): issues
    as (project, ticket_key, created, resolved, affected_names); pages that do
    not parse go to ``corrupt``.  An issue without a ``versions`` array is
    skipped (the reference fails on it); an empty array is kept.  Keys seen on
    several pages are kept once."""
    raw = (spark.read.schema(ISSUE_PAGE_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
           .withColumn("_file", F.col("_metadata.file_name"))
           )
    # Spark refuses queries that read only the corrupt-record column of raw
    # files, so the parsed pages are stored.
    raw = materialize(raw, "issue_pages")
    corrupt = raw.filter(F.col("_corrupt_record").isNotNull()).select("_file", "_corrupt_record")
    ok = raw.filter(F.col("_corrupt_record").isNull())
    x = ok.select(F.explode("issues").alias("i"))
    day = lambda c: F.try_to_date(F.substring(c, 1, 10))
    x = x.filter(F.col("i.fields.versions").isNotNull() & F.col("i.key").isNotNull())
    x = x.select(F.upper(F.regexp_extract(F.col("i.key"), r"^(.*)-[0-9]+$", 1)).alias("project"),
                 F.col("i.key").alias("ticket_key"), day(F.col("i.fields.created")).alias("created"),
                 F.when(F.length(F.trim(F.col("i.fields.resolutiondate"))) > 0,
                        day(F.col("i.fields.resolutiondate"))).alias("resolved"),
                 F.transform("i.fields.versions", lambda v: v["name"]).alias("affected_names"))
    return x.dropDuplicates(["project", "ticket_key"]), corrupt


def read_violations(spark: SparkSession, path: str) -> DataFrame:
    """S-8: rule-violation XML reports, one per release (``<project>/<release
    name>.xml``); attributes arrive as ``_class``, ``_method``, ``_rule``,
    ``_beginline``.  A release without a report simply has no rows."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("_class", "_method", "_rule", "_beginline")])
    raw = spark.read.format("xml").option("rowTag", "violation").schema(schema).load(path)
    return raw.select(F.upper(_parent_dir()).alias("project"), _file_stem().alias("release_name"),
                      F.col("_class").alias("class"), F.col("_method").alias("method"), F.col("_rule").alias("rule"),
                      F.col("_beginline").cast("int").alias("beginline"))


def read_refactored_csv(spark: SparkSession, path: str) -> DataFrame:
    """S-10: headerless 15-column method rows; rows with fewer than 14 fields
    are skipped; the six actionable metrics are kept by position."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(DATASET_COLUMNS))])
    raw = spark.read.option("header", False).option("mode", "PERMISSIVE").schema(schema).csv(path)
    keep = {"LOC": 3, "ParameterCount": 4, "CycloComplexity": 5, "CognitiveComplexity": 6, "NestingDepth": 7,
            "NumberOfCodeSmells": 13}
    return raw.filter(F.col("c13").isNotNull()).select(
        F.col("c2").alias("MethodName"), *[F.col(f"c{i}").cast("double").alias(n) for n, i in keep.items()])


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S-11: stored classifier results (a JSON array per file); unknown keys are
    ignored; unreadable files go to the second (corrupt) frame."""
    raw = (spark.read.schema(RESULTS_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
           .withColumn("_file", F.col("_metadata.file_name")))
    raw = materialize(raw, "results")
    corrupt = raw.filter(F.col("_corrupt_record").isNotNull()).select("_file", "_corrupt_record")
    return raw.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record"), corrupt


def read_fold_results(spark: SparkSession, path: str) -> DataFrame:
    """S-12: per-fold results CSV; column names trimmed."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    df = raw.toDF(*[c.strip() for c in raw.columns])
    return df.select(*[F.col(c).cast("double").alias(c) if c != "Model" else F.col(c) for c in df.columns])


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """S-13: the project list (a JSON object name → repository URL) as rows."""
    raw = spark.read.option("multiLine", True).json(path)
    cols = [c for c in raw.columns if c != "_corrupt_record"]
    if not cols:
        return spark.createDataFrame([], "project string, url string")
    stack = "stack({}, {}) as (project, url)".format(len(cols), ", ".join(f"'{c}', `{c}`" for c in cols))
    return raw.selectExpr(stack)


def read_snapshot_files(spark: SparkSession, root: str, releases: DataFrame | None = None) -> DataFrame:
    """S-7 / P-7: the source files of all release checkouts under ``root``
    (``<root>/<project>/<release name>/<repository path>``), one row per file
    (whole text), test folders left out: (project, release_name, path,
    content); with ``releases`` also release_id.

    Paths are relative to the repository and decoded, as file changes name
    them; the test filter sees only that part.
    """
    from ..functions.paths import snapshot_file
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(root)
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri().getPath().rstrip("/")
    full = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    parts = F.split(F.substring(full, F.instr(full, base + "/") + len(base) + 1, F.length(full)), "/", 3)
    x = raw.select(F.upper(parts[0]).alias("project"), parts[1].alias("release_name"), parts[2].alias("path"),
                   F.col("value").alias("content"))
    x = x.filter(snapshot_file(F.concat(F.lit("/"), "path")))  # a test folder may stand at the root
    if releases is None:
        return x
    names = releases.select("project", "release_id", F.col("name").alias("release_name"))
    return x.join(names, ["project", "release_name"])


#: One line per commit, and one per file that a commit changed, in tab-separated files named by project.
COMMIT_FIELDS = ("sha", "author", "committed_at", "message")
CHANGE_FIELDS = ("sha", "change_type", "path", "added", "deleted")
# Change types of a version-control log and their one-letter forms.
CHANGE_TYPES = {"A": "ADD", "M": "MODIFY", "D": "DELETE", "R": "RENAME", "C": "COPY"}


def _log_lines(spark: SparkSession, path: str, fields: tuple[str, ...]) -> DataFrame:
    """Tab-separated lines as (project, fields); the last field takes the rest of the line."""
    raw = spark.read.text(path).select(F.upper(_file_stem()).alias("project"), F.split("value", "\t", len(fields)).alias("v"))
    return raw.filter(F.size("v") == len(fields)).select("project", *[F.col("v")[i].alias(f) for i, f in enumerate(fields)])


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """S-4: commit logs, one file per project (``<project>.tsv``), each line sha,
    author, ISO time, message: (project, sha, author, committed_at, message).
    Lines with another number of fields or an unreadable time are left out; a
    commit on several branches counts once."""
    x = _log_lines(spark, path, COMMIT_FIELDS).withColumn("committed_at", F.try_to_timestamp("committed_at"))
    return x.filter(F.col("committed_at").isNotNull()).dropDuplicates(["project", "sha"])


def read_file_changes(spark: SparkSession, path: str) -> DataFrame:
    """S-5 / S-6: changed files, one file per project, each line sha, change type
    (word or letter), path, added and deleted lines: (project, sha,
    change_type, path, added, deleted).  Binary files (``-``) count 0 lines."""
    kinds = F.create_map(*[F.lit(x) for kv in CHANGE_TYPES.items() for x in kv])
    x = _log_lines(spark, path, CHANGE_FIELDS)
    number = lambda c: F.coalesce(F.col(c).try_cast("long"), F.lit(0)).alias(c)
    kind = F.upper("change_type")
    return x.select("project", "sha", F.coalesce(kinds[F.substring(kind, 1, 1)], kind).alias("change_type"), "path",
                    number("added"), number("deleted")).dropDuplicates(["project", "sha", "path"])


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """S-9 (see :func:`faultline.operators.dataset.read_dataset_csv`)."""
    from ..operators.dataset import read_dataset_csv
    return read_dataset_csv(spark, path)


__all__ = ["read_projects", "read_commits", "read_file_changes", "read_snapshot_files", "read_releases", "read_issue_pages", "read_violations", "read_refactored_csv", "read_results",
           "read_fold_results", "read_dataset", "DATASET_SCHEMA"]
