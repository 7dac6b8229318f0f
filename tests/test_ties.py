"""Queries beside their SQL over values that lie on ties and at the ends of bins."""
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from compare import rows_of

TIED = [10 + 20 * k for k in range(1000)]  # n_chars whose share of 20,000 lies between two steps


def beside_sql(spark, tmp_path, name, **tables):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for table, df in tables.items():
        path = f"{tmp_path}/{table}.parquet"
        df.coalesce(1).write.mode("overwrite").parquet(path)
        db.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    out = contract.queries()[name](spark, str(tmp_path))
    cur = db.execute(contract.oracle_sql()[name])
    assert rows_of(out.columns, out.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", ["threshold_sweep", "unscored_threshold"])
def test_scores_between_two_steps(spark, tmp_path, name):
    docs = spark.createDataFrame([(i, "text", "en", "s", n) for i, n in enumerate(TIED)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    beside_sql(spark, tmp_path, name, documents=docs, labels=labels)


def test_events_at_the_end_of_a_bin(spark, tmp_path):
    events = spark.range(6).select(
        F.col("id").alias("event_id"),
        F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 300_000_000 + 299_999_600).cast("timestamp_ntz").alias("ts"),
        F.col("id").alias("user_id"), F.lit("view").alias("event_type"), F.lit(3.0).alias("value"), F.lit("{}").alias("props"))
    beside_sql(spark, tmp_path, "traffic_series", events=events)


def test_model_swap_batches_of_many_files(spark, tmp_path, monkeypatch):
    from registry import streams
    monkeypatch.setattr(streams, "SWAP_ROWS", 60)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").filter("event_id < 300")
    beside_sql(spark, tmp_path, "stream_model_swap", events=events)
    (root,) = {f.rsplit("/in/", 1)[0] for f in _written(spark)}
    assert len([f for f in _written(spark) if f.startswith(root)]) > 2


def _written(spark):
    import glob
    return glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/swap-*/in/*.parquet")
