"""Every registered query against its SQL, over the whole small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, SQL = contract.queries(), contract.oracle_sql()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def database(small):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return connection


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        return None if isinstance(x, float) and math.isnan(x) else x

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, database, name):
    result = QUERIES[name](spark, small)
    rows = [tuple(r) for r in result.collect()]
    assert rows
    if name in SQL:
        expected = database.sql(SQL[name])
        assert sorted(result.columns) == sorted(expected.columns)
        kinds = dict(zip(expected.columns, map(str, expected.types)))
        assert {c: TYPES[t] for c, t in result.dtypes} == kinds
        assert comparable(rows, result.columns) == comparable(expected.fetchall(), expected.columns)


def test_contract(spark):
    assert set(SQL) <= set(QUERIES)
    flagship = contract.entry(spark)
    assert flagship.columns == ["task", "n", "accuracy", "prompt_chars"] and flagship.count() > 0


def test_constrained_choice_offers_every_label(spark, tmp_path):
    rows = [(i, [float(i % 20 == j) + 0.01 * ((i * 7 + j) % 5) for j in range(24)], i % 20) for i in range(120)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    result = QUERIES["constrained_choice"](spark, str(tmp_path))
    expected = connection.sql(SQL["constrained_choice"])
    got = comparable([tuple(r) for r in result.collect()], result.columns)
    assert got == comparable(expected.fetchall(), expected.columns)
    assert len({r[0] for r in got}) == 20
