"""Registered queries against DuckDB on the smallest tables, and the driver's entry points."""

import math
import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def names():
    from jobloom.plans.registry import QUERIES

    return list(QUERIES)


@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    from jobloom.plans.registry import ORACLE_SQL, QUERIES

    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in ORACLE_SQL:
        res = duck.execute(ORACLE_SQL[name])
        got = [d[0] for d in res.description]
        assert sorted(got) == cols
        assert rows == sorted((tuple(norm(r[got.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    else:
        assert len(set(df.columns)) == len(df.columns)


def test_enrich_join_takes_the_first_of_equal_lines(spark, tmp_path):
    """Lines that are equal in order and number, in several row groups and tasks, and null keys; DuckDB on one thread reads the table in its order."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from jobloom.plans.registry import ORACLE_SQL, QUERIES

    n = 6000
    lines = pa.table(
        {
            "l_orderkey": pa.array([None if i % 7 == 0 else i % 3 for i in range(n)], pa.int64()),
            "l_partkey": pa.array([i * 37 % 200 for i in range(n)], pa.int64()),
            "l_linenumber": pa.array([None if i % 11 == 0 else i % 2 for i in range(n)], pa.int32()),
            "l_returnflag": ["ANR"[i * i % 97 % 3] for i in range(n)],
            "l_linestatus": ["OF"[i * i % 89 % 2] for i in range(n)],
        }
    )
    parts = pa.table({"p_partkey": pa.array(range(210), pa.int64()), "p_name": ["ring"] * 210, "p_brand": ["b"] * 210, "p_type": ["t"] * 210, "p_size": pa.array([1] * 210, pa.int32())})
    pq.write_table(lines, tmp_path / "lineitem.parquet", row_group_size=500)
    pq.write_table(parts, tmp_path / "part.parquet")
    con = duckdb.connect(config={"threads": 1})
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path if t in ('lineitem', 'part') else SF}/{t}.parquet')")
    res = con.execute(ORACLE_SQL["enrich_join"])
    cols = [d[0] for d in res.description]
    want = sorted(res.fetchall())
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    try:
        for part in ("4k", "64m"):
            spark.conf.set(size, part)
            assert sorted(tuple(r[c] for c in cols) for r in QUERIES["enrich_join"](spark, f"file://{tmp_path}").collect()) == want
    finally:
        spark.conf.set(size, before)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 25
    assert set(e.oracle_sql()) <= set(e.queries())
