"""A sample of the registered queries against their SQL on the smallest driver tables."""
import glob
import os

import duckdb
import pytest

from checks.compare import _rows
from checks.oracle import ORACLE
from checks.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


@pytest.mark.parametrize("name", ["coinjoin_like", "address_features", "best_window", "resolve_duplicates", "clusters", "predictions"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, FOLDER)
    result = con.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(columns, result.fetchall())


def test_every_query_but_the_forest_has_sql():
    assert set(QUERIES) - set(ORACLE) == {"anomaly_scores"} and set(ORACLE) <= set(QUERIES)
