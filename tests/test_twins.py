import duckdb
import pytest

import oracle_check
from wayspan.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in oracle_check.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_twin(spark, con, name):
    ok, said = oracle_check.compare(spark, con, name, SF)
    assert ok, said


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_a_twin_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_whole_tables_take_part(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    n = events.count()
    assert catalog.QUERIES["asof_join_all"](spark, SF).select("event_id").distinct().count() == n
    assert catalog.QUERIES["pressure_merge_all"](spark, SF).select("event_id").distinct().count() == n
    assert catalog.QUERIES["voltage_position_all"](spark, SF).count() == n
    assert catalog.QUERIES["time_windows_all"](spark, SF).filter("TagID % 3 <> 0").count() > 0
