import duckdb
import pytest

import __spark_entry__ as entry
from faultline.llm.queries import QUERIES


def test_one_query_per_operator():
    assert sorted(int(k.split("_")[0][2:]) for k in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", [k for k in QUERIES if k in entry.oracle_sql()])
def test_against_duckdb(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    found = con.execute(entry.oracle_sql()[name])
    columns = sorted(c[0] for c in found.description)
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    want = [tuple(map(value, r)) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()]
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == columns
    assert sorted((tuple(map(value, r)) for r in got.select(*columns).collect()), key=str) == sorted(want, key=str)
