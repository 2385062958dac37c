"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))


def row_key(df: DataFrame, first: list[str]) -> Column:
    """A struct that orders rows by ``first`` and then by a hash of all
    columns, so that ties fall the same way in every run.  Maps cannot be
    hashed; they are left out."""
    rest = [F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t]
    return F.struct(*[F.col(f"`{c}`") for c in first], F.xxhash64(*rest).alias("_tie"))


#: Rows in an Arrow batch of whole texts; Spark's default of 10,000 holds too many long ones.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ``BATCH_ROWS``, so that a Python
    worker holds a few hundred texts at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def release() -> None:
    """Give memory that a task has freed back to the system.  Workers live on
    idle after a task; without this they keep its peak while later stages run."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc


def map_texts(df: DataFrame, columns: list[Column], fn, schema: str) -> DataFrame:
    """Apply ``fn(values) -> columns`` to Arrow batches of ``columns``: one list
    per input column in, one list per column of ``schema`` out.  Rows stay in
    their partition, so a lost executor costs its own tasks only, and memory
    is bounded by one batch."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        try:
            for batch in batches:
                if batch.num_rows:
                    out = fn(*[c.to_pylist() for c in batch.columns])
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, arrow, strict=True)], schema=arrow)
        finally:
            batch = out = None
            release()

    return df.select(*[c.alias(f"_{i}") for i, c in enumerate(columns)]).mapInArrow(run, schema)
