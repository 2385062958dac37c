"""Column-level helpers for datasets (P-11, P-14, P-15, P-16, P-19, U-3)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_name(name: str) -> str:
    """P-15: a column name without quotes and surrounding blanks."""
    return name.replace('"', "").replace("'", "").strip()


def clean_columns(df: DataFrame) -> DataFrame:
    """P-15: rename every column with :func:`clean_name`."""
    return df.toDF(*[clean_name(c) for c in df.columns])


def find_column(df: DataFrame, name: str) -> str:
    """P-15 tolerant lookup: match after cleaning, ignoring case and non-alphanumerics."""
    key = re.sub(r"[^a-z0-9]", "", clean_name(name).lower())
    for c in df.columns:
        if re.sub(r"[^a-z0-9]", "", clean_name(c).lower()) == key:
            return c
    raise KeyError(name)


def features_and_label(df: DataFrame, label: str = "Bugginess",
                       non_features: tuple[str, ...] = ("ProjectName", "Release", "MethodName")) -> DataFrame:
    """P-11: drop identifiers and move the label last."""
    keep = [c for c in df.columns if c not in non_features and c != label]
    return df.select(*keep, label)


def drop_string_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """P-16: drop every string column except ``keep`` (e.g. the label)."""
    return df.select(*[f.name for f in df.schema.fields
                       if not isinstance(f.dataType, T.StringType) or f.name in keep])


def drop_named(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """P-16: drop a named list (history metrics, release) when present."""
    return df.drop(*[c for c in names if c in df.columns])


def label_to_int(col: str | Column = "Bugginess") -> Column:
    """P-19: yes/true (any case, as a substring) → 1, anything else → 0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.lower(c).rlike("yes|true"), 1).otherwise(0)


def distinct_rows(df: DataFrame, key: list[str] | None = None) -> DataFrame:
    """U-3: add without duplicates."""
    return df.dropDuplicates(key) if key else df.dropDuplicates()


def truncate(col: str | Column, width: int = 30) -> Column:
    """Report helper: cut at ``width`` characters with "..."."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 3), F.lit("..."))).otherwise(c)
