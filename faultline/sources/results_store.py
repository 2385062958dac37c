"""Classifier results store (K-5, K-6, U-2, K-10).

The reference keeps one JSON file per project and appends, or replaces, a
classifier's record.  Here the store is a Parquet table partitioned by
project; an upsert is a union with the new records and a ``row_number`` per
(project, classifier) by run time, and only the touched project partitions
are overwritten (dynamic partition overwrite).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ["project", "classifier"]


def upsert(existing: DataFrame, new: DataFrame, key: list[str] = KEY, ts: str = "run_ts") -> DataFrame:
    """U-2: existing ∪ new, keeping per key the latest record (new wins a tie).
    Groups hold the versions of one classifier of one project: bounded."""
    a = existing.withColumn("_src", F.lit(0))
    b = new.withColumn("_src", F.lit(1))
    u = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.col(ts).desc(), F.col("_src").desc())
    return u.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_src")


def save(df: DataFrame, path: str) -> None:
    """K-5: write the store, replacing only the projects present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is there, asked of the file system that Spark will use."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append(spark: SparkSession, path: str, new: DataFrame, key: list[str] = KEY, ts: str = "run_ts") -> DataFrame:
    """K-5 append-replacing-same-classifier: read the touched projects, upsert,
    materialise (the source and target are the same table), write back."""
    if exists(spark, path):
        projects = new.select("project").distinct()
        old = load(spark, path).join(projects, "project", "left_semi")
        merged = upsert(old, new, key, ts).checkpoint(eager=True)
    else:
        merged = new
    save(merged, path)
    return merged


def save_model(model, schema_json: str, path: str) -> None:
    """K-10: the fitted model, its kind and the training schema beside it."""
    if hasattr(model, "write"):
        model.write().overwrite().save(f"{path}/model")
    else:
        model.save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    for name, text in (("kind", type(model).__name__), ("schema", schema_json)):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def load_model(spark: SparkSession, path: str):
    """K-10: (fitted model of any kind, feature names) as :func:`save_model` left them."""
    import json

    from pyspark.ml import PipelineModel

    from ..operators.models import Forest, Neighbours, Prior

    schema = spark.read.text(f"{path}/schema").first()[0]
    kind = spark.read.text(f"{path}/kind").first()[0]
    features = [f["name"] for f in json.loads(schema)["fields"]]
    own = {c.__name__: c for c in (Forest, Neighbours, Prior)}
    return own[kind].load(spark, f"{path}/model") if kind in own else PipelineModel.load(f"{path}/model"), features
