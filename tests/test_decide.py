"""The cascade: order of layers, enforcement, failing closed, privacy."""
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reqlens.config import DEFAULTS, Settings
from reqlens.models.autoencoder import Network
from reqlens.models.bundle import ModelSet
from reqlens.models.forest import Forest, grow_tree
from reqlens.models.meta import Meta
from reqlens.operators import baseline as bl
from reqlens.operators import decide, requests
from reqlens.plans import scoring
from reqlens.schemas import FEATURE_NAMES

COLUMNS = ("event_id bigint, path string, query string, body string, status int, window_count int, "
           "burst_count int, window_distinct int, rate_limited boolean, rate_reason string")


def requests_of(spark, *rows):
    full = [(i, p, q, b, 200, 2, 1, 1, lim, reason) for i, (p, q, b, lim, reason) in enumerate(rows)]
    return requests.to_request(spark.createDataFrame(full, COLUMNS)).withColumns(
        {"client": F.lit("203.0.113.9"), "ts": F.timestamp_seconds(F.lit(1_700_000_000)),
         "label": F.lit("normal")})


@pytest.fixture(scope="module")
def models(spark):
    import pandas as pd
    X = np.random.default_rng(0).normal(size=(64, len(FEATURE_NAMES)))
    nodes = pd.DataFrame(grow_tree(X, np.random.default_rng(1)),
                         columns=["node", "feature", "threshold", "left", "right", "size"])
    nodes.insert(0, "tree", 0)
    return ModelSet({n: (0.0, 1.0) for n in FEATURE_NAMES}, Forest(nodes, 64),
                    Network.initial(len(FEATURE_NAMES), 8, 4, 0),
                    Meta(-2.0, {"rate": 1.0, "isolation_forest": 1.0, "autoencoder": 5.0}),
                    bl.empty_baseline(spark), {"if": (-0.5, 0.5), "ae": (0.0, 1e5)}, 0.5,
                    FEATURE_NAMES, {})


PLAIN = ("/api/products", "", "", False, "")
ATTACK = ("/api/x", "q=' union select a from b --", "", True, "burst limit exceeded: 41")
LIMITED = ("/api/products", "", "", True, "burst limit exceeded: 41")
FLAGGED = ("/wp-admin", "", "", False, "")


def test_cascade_without_models(spark):
    got = scoring.inspect(requests_of(spark, PLAIN, ATTACK, LIMITED, FLAGGED)).orderBy("event_id").collect()
    assert [r.layer for r in got] == ["L1-only", "L1-rules", "L1-rate", "L1-only"]
    assert [r.action for r in got] == ["allow", "block", "block", "allow"]
    assert [r.degraded for r in got] == [True, False, False, True]
    assert got[1].reason.startswith("sqli.union: ") and got[1].scores == {"rule": 1.0}
    assert got[2].reason == LIMITED[4] and got[2].scores == {"rate": 1.0} and got[2].categories == ["rate"]
    assert got[3].rule_hits == ["scan.admin_panels"] and got[3].n_flags == 1
    assert [r.status for r in got] == [200, 403, 403, 200]


def test_models_decide_survivors_only(spark, models):
    got = scoring.inspect(requests_of(spark, PLAIN, ATTACK, LIMITED, FLAGGED), models).orderBy("event_id").collect()
    assert got[0].layer in ("", "L4-meta") and not got[0].degraded
    assert set(got[0].scores) == {"rate", "isolation_forest", "autoencoder", "meta_lr"}
    assert got[0].probability == pytest.approx(got[0].scores["meta_lr"], abs=1e-4)
    assert got[1].layer == "L1-rules" and got[1].if_raw is None and got[1].probability == 1.0
    assert got[3].n_flags == 1


def test_threshold_and_reason(spark, models):
    from dataclasses import replace
    strict = replace(models, threshold=0.0)
    r = scoring.inspect(requests_of(spark, PLAIN), strict, DEFAULTS.but(mode="enforce")).first()
    assert (r.action, r.layer, r.enforced, r.status) == ("block", "L4-meta", True, 403)
    assert r.reason == f"ensemble anomaly probability {r.p:.3f} >= threshold 0.000"
    soft = scoring.inspect(requests_of(spark, PLAIN), strict, DEFAULTS).first()
    assert (soft.enforced, soft.would_block, soft.status) == (False, "L4-meta", 200)


@pytest.mark.parametrize("closed,action,probability", [(True, "block", 1.0), (False, "allow", 0.0)])
def test_scoring_failure(spark, models, closed, action, probability):
    broken = requests_of(spark, PLAIN, PLAIN, LIMITED).withColumn(
        "body_size", F.when(F.col("event_id") == 0, F.lit(-1)).otherwise(F.col("body_size")))
    df = scoring.inspect(broken, None).drop("action", "layer", "reason", "probability", "scores", "degraded")
    df = df.withColumn("path_decode_delta", F.when(F.col("event_id") != 1, float("nan")).otherwise(0.0))
    got = decide.decide(df, models, DEFAULTS.but(fail_closed=closed)).orderBy("event_id").collect()
    assert (got[0].layer, got[0].action, got[0].probability, got[0].degraded) == (
        "L-error", action, probability, True)
    assert got[0].reason == f"inference failure, failing {'closed' if closed else 'open'}: ValueError"
    assert got[1].layer in ("", "L4-meta") and got[2].layer == "L1-rate"


def test_one_bad_row_does_not_spoil_its_batch(spark, models):
    class Fragile(Network):
        def errors(self, X):
            if (X[:, FEATURE_NAMES.index("path_len")] > 100).any():
                raise OverflowError
            return super().errors(X)
    from dataclasses import replace
    bad = replace(models, network=Fragile(models.network.layers))
    rows = [("/" + "a" * (200 if i == 5 else 3), "", "", False, "") for i in range(20)]
    got = scoring.inspect(requests_of(spark, *rows).coalesce(1), bad).orderBy("event_id").collect()
    assert [r.error for r in got] == [None] * 5 + ["OverflowError"] + [None] * 14
    assert got[5].layer == "L-error" and got[4].layer != "L-error"


def test_hostile_input_is_decided(spark, models):
    rows = [("/" + "\x00" * 20, "", "", False, ""), ("/" + "%" * 300, "", "", False, ""),
            ("/", "", "\U0001f4a9" * 500, False, ""), ("/" + "a" * 4000, "", "{" * 2000, False, ""),
            ("/", "", "\\x00\\xff" * 200, False, "")]
    for r in scoring.inspect(requests_of(spark, *rows), models).collect():
        assert r.action in ("allow", "block") and 0.0 <= r.probability <= 1.0


def test_log_record_hides_request_text(spark, models):
    secret = ("/api/login", "token=s3cr3t", '{"password": "s3cr3t"}', False, "")
    log = decide.to_event_log(scoring.inspect(requests_of(spark, secret), models))
    row = log.first()
    assert "s3cr3t" not in str(row.asDict()) and len(row.client) == 16 and row.label is None
    assert set(row.features) == set(FEATURE_NAMES)
    lab = decide.to_event_log(scoring.inspect(requests_of(spark, secret), models), DEFAULTS.but(trust_label=True))
    assert lab.first().label == "normal"


def test_oversize_is_refused_before_counting(spark):
    df = requests_of(spark, PLAIN, PLAIN).withColumn(
        "body_size", F.when(F.col("event_id") == 0, 1_048_577).otherwise(1_048_576))
    ok, refused = requests.split_oversize(df)
    assert [r.event_id for r in ok.collect()] == [1]
    assert [(r.event_id, r.status) for r in refused.collect()] == [(0, 413)]


def test_unknown_mode_is_refused():
    with pytest.raises(ValueError):
        Settings(mode="loud")


def test_no_text_reaches_a_shuffle(spark):
    df = requests_of(spark, PLAIN, ATTACK, FLAGGED).drop(
        "window_count", "burst_count", "window_distinct", "rate_limited", "rate_reason")
    assert not set(scoring.TEXT) & set(scoring.shape(scoring.accept(df)[0]).columns)

    def nodes(node):
        yield node
        for i in range(node.children().size()):
            yield from nodes(node.children().apply(i))
    plan = scoring.score_requests(df)._jdf.queryExecution().optimizedPlan()
    shuffled = [n.output().mkString(" ") for n in nodes(plan) if n.nodeName() in ("Window", "Aggregate", "Join")]
    assert shuffled and not [o for o in shuffled if re.search(r"\b(path|query|body|canon_path|canon_body)#", o)]


def test_missing_layers_and_sizes_in_bytes(spark):
    row = spark.sql("SELECT 'block' AS action, CAST(NULL AS STRING) AS layer, 'é' AS body")
    assert row.select(decide.enforced(DEFAULTS)).first()[0] is True
    assert requests.to_request(row).first().body_size == 2
    assert requests.privacy_projection(spark.sql("SELECT 'c' AS client, 'x' AS html, 1 AS status")).columns == ["status", "client"]
