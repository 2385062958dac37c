"""Path predicates and splits over file-path columns (P-5, P-6, P-7, P-21)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reference's file filters.
JAVA_SUFFIX = ".java"
TEST_DIR = "/src/test/"
ANY_TEST_DIR = "/test/"
FIX_CHANGE_TYPES = ("ADD", "MODIFY")


def source_file(path: str | Column = "path", excludes: tuple[str, ...] = (TEST_DIR,),
                suffix: str = JAVA_SUFFIX) -> Column:
    """Ends with ``suffix`` and contains none of ``excludes``."""
    p = F.col(path) if isinstance(path, str) else path
    cond = p.endswith(suffix)
    for e in excludes:
        cond = cond & ~p.contains(e)
    return cond


def fix_file(path: str = "path", change_type: str = "change_type") -> Column:
    """P-5: a file a fixing commit repaired: ADD or MODIFY, ``.java``, no test folder."""
    return F.col(change_type).isin(*FIX_CHANGE_TYPES) & source_file(path, (ANY_TEST_DIR, TEST_DIR))


def touched_file(path: str = "path") -> Column:
    """P-6: a file a commit touched (any change type): ``.java`` outside ``/src/test/``."""
    return source_file(path, (TEST_DIR,))


def snapshot_file(path: str | Column = "path") -> Column:
    """P-7: a file of a release snapshot: ``.java`` outside ``/src/test/``."""
    return source_file(path, (TEST_DIR,))


def package_of(path: str = "path") -> Column:
    """P-21: text before the last ``/`` (empty for a file in the root)."""
    p = F.col(path)
    return F.when(p.contains("/"), F.regexp_extract(p, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def file_name_of(path: str = "path") -> Column:
    """P-21: text after the last ``/``."""
    return F.substring_index(F.col(path), "/", -1)


def class_of(path: str = "path") -> Column:
    """File name without the ``.java`` suffix (the class a violation names, J-8)."""
    return F.regexp_replace(file_name_of(path), r"\.java$", "")
