import datetime
import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size string, `key` string, _row int, _id int, fp double, h date"
WORDS = "the a of and river stone house über garçon niño light seven green paper walk 42 Time's".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (f"{r.randrange(900)}" if r.random() < 0.5 else "") for _ in range(n))


def awkward_rows():
    """Nulls in every column, empty and long texts, copies, repeated rows, and
    extra columns whose names operators might use."""
    long = prose(1, 9000)
    texts = [None, "", " \n\t ", "one", "One two", "!!! 123 ???", prose(2, 3), prose(2, 3), long, long, long + " end", "x" * 3000]
    texts += [prose(s, 60) for s in range(20)] + [prose(3, 60)] * 5 + [None]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, "s10", "Ä"][i % 5], 1, i, "7", "k", i, None, 0.5, datetime.date(2020, 1, 1))
            for i, t in enumerate(texts)]
    rows += [rows[5], rows[25], rows[25], (None, "no id", None, None, *[None] * 8), (None, None, None, None, *[None] * 8)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small_docs(sf):
    import pyarrow.parquet as pq

    return pq.read_table(f"{sf}/documents.parquet").to_pylist()


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: tuple((x is not None, x) for x in r))
