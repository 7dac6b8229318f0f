"""The driver contract, and a sample of registered queries beside their SQL."""
import os

import pytest

import __spark_entry__ as contract
from compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
SAMPLE = ["path_templates", "url_decoding", "rule_severity", "rate_state", "window_counts_hot",
          "training_pools", "latency_summary", "traffic_series", "threshold_sweep", "roc_auc",
          "baseline_join", "decision_cascade", "standardise"]


def test_every_sql_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(SAMPLE) <= set(contract.oracle_sql())


@needs_data
def test_entry_runs(spark):
    df = contract.entry(spark)
    assert set(df.columns) == {"client", "requests", "burst_blocks", "window_blocks"}
    df.count()


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = contract.queries()[name](spark, SF)
    cur = db.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())
