"""Runs with many branches: regions whose customers outnumber the default budget of steps."""

import time

import pytest

CUSTOMERS = 20_000


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    import duckdb

    where, db = tmp_path_factory.mktemp("wide"), duckdb.connect()
    db.execute("CREATE TABLE region AS SELECT 0 AS r_regionkey, 'NORTH' AS r_name")
    db.execute("CREATE TABLE nation AS SELECT 0 AS n_nationkey, 'A' AS n_name, 0 AS n_regionkey UNION ALL SELECT 1, 'B', 0")
    # All of nation 1's customers and none of nation 0's are in debt.
    db.execute(f"CREATE TABLE customer AS SELECT i AS c_custkey, CAST(i % 10 = 9 AS INTEGER) AS c_nationkey, CASE WHEN i % 10 = 9 THEN -990.0 ELSE 12.5 END::DOUBLE AS c_acctbal FROM range({CUSTOMERS}) t(i)")
    for t in ("region", "nation", "customer"):
        db.execute(f"COPY {t} TO '{where}/{t}.parquet' (FORMAT parquet)")
    return str(where), db


def same(spark, tables, name):
    """The query's rows are its SQL's; gives the seconds it took."""
    from braidwork.queries import QUERIES, SQL

    begun = time.perf_counter()
    frame = QUERIES[name](spark, tables[0])
    columns = sorted(frame.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in frame.collect())
    seconds = time.perf_counter() - begun
    result = tables[1].execute(SQL[name])
    names = [c[0] for c in result.description]
    assert got == sorted(tuple(str(row[names.index(c)]) for c in columns) for row in result.fetchall())
    return seconds


def test_more_customers_than_the_default_steps(spark, tables):
    same(spark, tables, "join_nested")


def test_children_are_numbered_in_linear_time(spark, tables):
    # 18,000 children in one group; the square of it took minutes.
    assert same(spark, tables, "id_allocation") < 60


def test_a_group_with_many_failures(spark, tables):
    # 2,000 of a group's tasks fail beside 18,000 others.
    assert same(spark, tables, "fail_group_nested") < 60
