"""Feature invariants."""
import math

import pytest
from pyspark.sql import functions as F

from reqlens.functions import features, text
from reqlens.operators import baseline as bl
from reqlens.operators import requests
from reqlens.schemas import ENDPOINT_BASELINE, FEATURE_NAMES

COLUMNS = ("method string, path string, query string, body string, body_size bigint, "
           "content_type string, window_distinct int, n_flags int")


def extract(spark, rows, endpoints=()):
    base = bl.Baseline(spark.createDataFrame(list(endpoints), ENDPOINT_BASELINE),
                       n_samples=len(endpoints), ready=bool(endpoints))
    df = spark.createDataFrame(rows, COLUMNS).withColumn("i", F.monotonically_increasing_id())
    df = bl.with_endpoint_stats(requests.to_request(df), base)
    return features.with_features(text.with_payload(df)).orderBy("i").collect()


def row(path="/api/products", query="", body="", size=0, method="GET", ct="", distinct=2, flags=0):
    return (method, path, query, body, size, ct, distinct, flags)


def test_hostile_input_is_finite_and_stable(spark):
    rows = [row("/" + "\x00" * 9), row("/" + "%" * 200), row(body="\u202e\u200f\U0001f4a9" * 50),
            row(query="a=" + "{" * 5000), row(size=10 ** 9), row("", "", "", 0, "", ""), row(query="=&=&=&")]
    first, second = extract(spark, rows), extract(spark, rows)
    for a, b in zip(first, second):
        assert all(math.isfinite(a[n]) and a[n] == b[n] for n in FEATURE_NAMES)


def test_same_shape_on_two_backends(spark):
    a, b = extract(spark, [row("/api/products/42"), row("/shop/artikels/42")])
    for n in ("path_depth", "path_numeric_seg_ratio", "path_special_ratio", "path_dot_count", "body_entropy",
              "q_param_count", "m_get", "win_distinct_paths"):
        assert a[n] == b[n]


def test_entropy_orders_payloads(spark):
    got = extract(spark, [row(body="a" * 64), row(body='{"id": 1, "qty": 2}'), row(body="q8Zk3#vT!x9LmP0^wR7&")])
    assert got[0].body_entropy < got[1].body_entropy < got[2].body_entropy


def test_baseline_relative_features(spark):
    known = [("/api/products", 1000.0, 100.0, 10)]
    near, far, other = extract(spark, [row(size=1050), row(size=90_000), row("/else", size=5)], known)
    assert near.body_size_z == 0.5 and far.body_size_z == 10.0
    assert (near.path_known, other.path_known, other.body_size_z) == (1.0, 0.0, 0.0)
    assert extract(spark, [row("/else")])[0].path_known == 1.0


def test_methods_and_counts(spark):
    put, odd = extract(spark, [row(method="put", ct="application/JSON", flags=2), row(method="TRACE", distinct=0)])
    assert (put.m_put, put.is_write, put.m_other, put.ct_json, put.n_flags) == (1, 1, 0, 1, 2)
    assert (odd.m_other, odd.is_write, odd.win_distinct_paths) == (1, 0, 0)


def test_contract_has_no_identity_or_rate():
    banned = {"template", "header_count", "ua_len", "ua_entropy", "has_ua", "has_referer", "has_auth",
              "win_log_count", "burst_log_count", "rate_z"}
    assert len(FEATURE_NAMES) == len(set(FEATURE_NAMES)) == 34 and not banned & set(FEATURE_NAMES)


def test_vector_round_trips_through_the_log(spark):
    df = spark.createDataFrame([({"path_len": 3.0},)], "features map<string,double>")
    r = features.from_map(df).select(features.assemble().alias("v")).first()
    assert len(r.v) == 34 and r.v[FEATURE_NAMES.index("path_len")] == 3.0 and sum(r.v) == 3.0


@pytest.mark.parametrize("cap,want", [(4, "éé"), (3, "é"), (5, "ééz"), (6, "éézz"), (100, "éézz")])
def test_truncation_keeps_whole_characters(spark, cap, want):
    from reqlens.config import DEFAULTS
    df = spark.createDataFrame([("éézz",)], "body string")
    assert requests.truncate_body(df, DEFAULTS.but(inspect_bytes=cap)).first().body == want


def test_page_features_send_bodies_to_python_once(spark):
    """Only the entropy reads whole bodies in Python, and as Arrow values."""
    import __spark_entry__ as contract
    plan = contract.queries()["feature_vector_pages"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "payload(" not in plan and "bits(" in plan


def test_entropy_of_arrow_values(spark):
    df = spark.createDataFrame([(None,), ("",), ("aa",), ("ab",), ("\u00e9\U0001F600",)], "t string")
    assert [r.e for r in df.select(text.shannon_entropy("t").alias("e")).collect()] == [0.0, 0.0, 0.0, 1.0, 1.0]
    from reqlens.functions.register import register
    register(spark)
    assert spark.sql("SELECT text_entropy('abcd') AS e").first().e == 2.0


def test_rows_of_one_template_are_dealt_over_tasks(spark):
    df = spark.range(4_000).select(F.col("id").alias("event_id"), F.lit("/a").alias("template"), F.lit(4).alias("body_size"))
    endpoints = spark.createDataFrame([("/a", 3.0, 1.0, 9)], "template string, body_mean double, body_std double, n long")
    out = bl.join_endpoints(df.repartition(4), endpoints.hint("shuffle_hash"))
    assert out.filter("body_mean = 3 AND _known").count() == 4_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = out.select(F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.p for r in tasks}) > 1
