"""Every registered query with SQL, compared on the smallest tables."""

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as entry_points
from compare import TABLES, canonical

SQL = entry_points.oracle_sql()
# These assert facts of the larger tables, or repeat a run another query covers.
SKIP = {
    "datetime_summary", "dataset_profile", "role_inference", "type_distribution", "target_selection", "cleaning_lineage",
    "comprehensive_report", "export_report", "cleaning_report", "split_identifiers",
}


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", [n for n in SQL if n not in SKIP])
def test_query(spark, db, name):
    df = entry_points.queries()[name](spark, SMALL)
    mine = canonical([tuple(r) for r in df.collect()], df.columns)
    found = db.execute(SQL[name])
    assert mine == canonical(found.fetchall(), [d[0] for d in found.description])


def test_entry(spark):
    assert entry_points.entry(spark).count() == 6
