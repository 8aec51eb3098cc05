"""Every registered query of the engine against its SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

FOLDER = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


def names():
    from collatura import queries

    return sorted(queries.QUERIES)


def plain(v):
    return ("nan" if math.isnan(v) else float(f"{v:.10g}")) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect(config={"threads": 2})
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    from collatura import queries

    df = queries.QUERIES[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in queries.ORACLE:
        return
    found = duck.execute(queries.ORACLE[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == columns
    assert rows == sorted((tuple(plain(r[at.index(c)]) for c in columns) for r in found.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["lang", "reason", "n"] and df.count() > 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
