import pytest

from tests.conftest import rows
from tessera.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf, duck):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_merged_ranks_equals_sql_beyond_a_million_events(spark, tmp_path):
    import duckdb

    ids = [0, 1, 2, 3, 999_998, 999_999, 1_000_000, 1_000_001, 1_000_003, 2_000_002, 3_999_999, 4_000_000, 5_999_999]
    spark.createDataFrame([(e, u) for k, e in enumerate(ids) for u in (k, k % 3)], "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert rows(QUERIES["merged_ranks"](spark, str(tmp_path)).toPandas()) == rows(con.sql(ORACLES["merged_ranks"]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
