import duckdb
import pytest

import __spark_entry__
from driftmark.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert {"rows_modified", "column_renamed", "row_count_decreased"} <= {r.kind for r in rows}


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_against_its_sql(spark, name):
    connection = duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "conversations"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = catalogue.queries()[name](spark, SF).toPandas()
    expected = connection.sql(catalogue.oracle_sql()[name]).df()
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns

    def plain(frame):
        return sorted(str([None if v != v or v is None else round(v, 5) if isinstance(v, float) else v for v in row]) for row in frame[columns].astype(object).values.tolist())

    assert plain(got) == plain(expected)
