"""Models by tolerance, artefacts, and the training plans end to end."""
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from reqlens.config import DEFAULTS
from reqlens.functions import scalars
from reqlens.models import autoencoder, forest, meta, scaler
from reqlens.operators import baseline as bl
from reqlens.operators import eventlog, metrics
from reqlens.plans import calibrate, train
from reqlens.schemas import EVENT_LOG, FEATURE_NAMES, RATE_BASELINE
from reqlens.session import cut
from reqlens.sources import artefacts, logs

COLS = [f"x{i}" for i in range(6)]


@pytest.fixture(scope="module")
def points(spark):
    """Correlated inliers and a few planted outliers."""
    rng = np.random.default_rng(0)
    z = rng.normal(size=(1500, 2))
    X = np.c_[z, z[:, :1] + z[:, 1:], z @ np.array([[1.0], [-2.0]]), z[:, :1] * 2, np.full((1500, 1), 3.0)]
    X[:30] += rng.normal(scale=6.0, size=(30, 6))
    rows = [(i, int(i < 30), *map(float, x)) for i, x in enumerate(X)]
    return cut(spark.createDataFrame(rows, "id bigint, y int, " + ", ".join(f"{c} double" for c in COLS)))


def vector(points):
    params = scaler.parameters(scaler.fit_scaler(points.filter("y = 0"), COLS), COLS)
    return params, scaler.scaled_vector(params)


def test_constant_column_keeps_its_deviation(points):
    params, _ = vector(points)
    assert params["x5"] == (3.0, 1.0)
    off = points.filter("y = 1").select(F.abs(scaler.scaled(params)["x5"]).alias("d"))
    assert off.agg(F.max("d")).first()[0] > 1


def test_forest_ranks_outliers(points):
    params, vec = vector(points)
    nodes, sample = forest.fit_forest(points.filter("y = 0"), vec, "id", trees=60, sample=128, seed=3)
    trees = forest.load_forest(nodes, sample)
    assert sample == 128 and len(trees.roots) == 60
    sizes = nodes.filter("node = 0").agg(F.min("size"), F.max("size")).first()
    assert tuple(sizes) == (128, 128)
    out = forest.score_forest(points, vec, trees)
    assert metrics.ranking_metrics(out, "if_raw").first().roc_auc > 0.9
    again, _ = forest.fit_forest(points.filter("y = 0"), vec, "id", trees=60, sample=128, seed=3)
    assert nodes.exceptAll(again).count() == 0


def test_forest_sampling_covers_large_inputs(spark):
    df = spark.range(200_000).select("id", F.col("id").cast("double").alias("x"))
    drawn = forest.tree_samples(df, F.array("x"), "id", 200_000, 8, 256, 1)
    got = drawn.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.avg(F.element_at("x", 1)).alias("m"))
    rows = got.collect()
    assert len(rows) == 8 and all(r.n == 256 and 80_000 < r.m < 120_000 for r in rows)


def test_copies_of_a_row_are_sampled_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(train, "COPIES", 128)  # of 1,000: eight parts, the last not full
    df = spark.range(3000).select(F.when(F.col("id") < 1000, -1.0).otherwise(F.col("id")).cast("double").alias("x"),
                                  F.lit(None).cast("string").alias("family"))
    rows = train.numbered(df.repartition(3))
    ids = sorted(map(tuple, rows.select("row_id", "x").collect()))
    assert len({i for i, _ in ids}) == 3000 and sum(x == -1 for _, x in ids) == 1000
    assert sorted(map(tuple, train.numbered(df.repartition(7)).select("row_id", "x").collect())) == ids
    drawn = forest.tree_samples(rows, F.array("x"), "row_id", 3000, 20, 300, 1)
    share = drawn.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.avg((F.element_at("x", 1) < 0).cast("int")).alias("m"))
    got = share.collect()
    assert len(got) == 20 and all(r.n == 300 and 0.2 < r.m < 0.47 for r in got)


@pytest.mark.parametrize("shards", [1, 3])
def test_autoencoder_learns(spark, points, shards):
    params, vec = vector(points)
    s = DEFAULTS.but(ae_epochs=12, ae_hidden=16, ae_bottleneck=3, ae_lr=5e-3, ae_batch=64)
    net, history = autoencoder.fit_autoencoder(points.filter("y = 0"), vec, "id", s, shards=shards)
    assert history[-1] < 0.5 * history[0]
    out = autoencoder.score_autoencoder(points, vec, net)
    assert metrics.ranking_metrics(out, "ae_raw").first().roc_auc > 0.9
    back = autoencoder.load_network(autoencoder.weights_table(spark, net))
    assert np.allclose(back.flat(), net.flat())


def test_gradient_matches_differences():
    rng = np.random.default_rng(2)
    net = autoencoder.Network.initial(5, 4, 3, 1)
    X, flat = rng.normal(size=(7, 5)), None
    flat = net.flat()
    g = net.gradient(X, X)

    def loss(f):
        out = net.with_flat(f).activations(X)[-1]
        return ((out - X) ** 2).sum() / len(X)
    for i in range(0, len(flat), 11):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        assert g[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-6, abs=1e-4)


def test_meta_matches_newton(spark):
    rng = np.random.default_rng(4)
    X = rng.random((800, 3))
    y = (X @ [2.0, 0.5, 3.0] + rng.normal(scale=0.5, size=800) > 3.4).astype(int)
    df = spark.createDataFrame([(*map(float, x), int(t)) for x, t in zip(X, y)],
                               "rate double, isolation_forest double, autoencoder double, y int")
    got = meta.fit_meta(df)
    A, w = np.c_[np.ones(800), X], np.where(y == 1, 800 / (2 * y.sum()), 800 / (2 * (800 - y.sum())))
    b, ridge = np.zeros(4), np.diag([0.0, 1, 1, 1])
    for _ in range(40):
        q = 1 / (1 + np.exp(-A @ b))
        b -= np.linalg.solve(A.T @ (A * (w * q * (1 - q))[:, None]) + ridge, A.T @ (w * (q - y)) + ridge @ b)
    assert [got.intercept, *got.coefficients.values()] == pytest.approx(list(b), abs=1e-4)
    with pytest.raises(ValueError):
        meta.fit_meta(df.filter("y = 0"))


# ── logs and artefacts ───────────────────────────────────────────────────────

def test_log_reader_skips_what_is_not_a_record(spark, tmp_path):
    good = {"ts": 5.0, "client": "a", "features": {"path_len": 3.0}, "rule_hits": ["sqli.union"],
            "label": "normal", "scores": {"rate": 0.5}}
    lines = [json.dumps(good).encode(), b"", b"{broken", b"   ", b'{"ts": 7.0, "client": "\xff\xfe"}', b"[1"]
    (tmp_path / "e.jsonl").write_bytes(b"\n".join(lines))
    df = logs.read_event_log(spark, str(tmp_path))
    assert sorted(r.ts for r in df.collect()) == [5.0, 7.0]
    assert eventlog.require_features(df).count() == 1 and eventlog.since(df, 60.0 + 6, 1).count() == 1
    assert eventlog.flatten_scores(df).filter("rate = 0.5 and meta_lr is null").count() == 1


def test_event_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(86_400.5,), (10.0,)], "ts double")
    full = spark.createDataFrame([], EVENT_LOG).unionByName(df.withColumn("client", F.lit("c")), True)
    logs.write_event_table(full, str(tmp_path / "t"))
    back = logs.read_event_table(spark, str(tmp_path / "t"))
    assert back.filter("dt = DATE'1970-01-02'").count() == 1 and back.count() == 2


def test_missing_baseline_is_not_ready(spark, tmp_path):
    store = artefacts.Store(str(tmp_path))
    assert artefacts.current_version(spark, store) is None
    for version in (None, "nope"):
        b = artefacts.load_baseline(spark, store, version)
        assert not b.ready and b.endpoints.count() == 0


def test_foreign_features_are_refused(spark, tmp_path):
    store = artefacts.Store(str(tmp_path))
    artefacts.save_decision(spark, store, "v1", {"feature_names": FEATURE_NAMES[:-3], "threshold": 0.5})
    artefacts.publish(spark, store, "v1")
    with pytest.raises(ValueError, match="contract"):
        artefacts.load_models(spark, store)


# ── plans ────────────────────────────────────────────────────────────────────

S = DEFAULTS.but(forest_trees=30, forest_samples=128, ae_epochs=6, ae_lr=5e-3,
                 calibration_min_samples=500, target_fpr=0.02)


@pytest.fixture(scope="module")
def log(spark):
    """Sessions of normal and attack traffic as stored feature vectors."""
    c = F.col
    df = spark.range(6_000).select(
        (c("id") % 300).alias("s"), "id").withColumns({
            "bad": (c("s") % 4 == 3), "u": F.rand(1), "v": F.randn(2), "w": F.randn(3)})
    family = F.element_at(F.array(*[F.lit(f) for f in ("sqli", "xss", "cmdi", "scan")]),
                          (F.floor(c("s") / 4) % 4 + 1).cast("int"))
    shift = F.when(c("bad"), 3.0).otherwise(0.0)
    feats = {n: F.lit(0.0) for n in FEATURE_NAMES} | {
        "body_log_size": 4 + c("v") + shift, "body_entropy": 3 + c("w") / 2 + shift, "path_len": 20 + 4 * c("w"),
        "path_special_ratio": 0.1 + c("u") / 10 + shift / 10, "q_param_count": F.floor(c("u") * 4),
        "path_depth": 2 + F.floor(c("u") * 3), "win_distinct_paths": F.log1p(F.floor(c("u") * 5))}
    hits = F.when(c("bad") & (c("id") % 9 == 0), F.array(F.lit("sqli.union"))).otherwise(F.array().cast("array<string>"))
    rows = df.select(
        (c("id") + 0.5).alias("ts"), F.concat(F.lit("c"), c("s").cast("string")).alias("client"),
        F.concat(F.lit("/t"), (c("id") % 6).cast("string")).alias("template"),
        F.floor(100 + 10 * c("v")).alias("body_size"), (c("id") % 40).cast("int").alias("window_count"),
        (c("id") % 6).cast("int").alias("burst_count"), hits.alias("rule_hits"), F.lit("").alias("layer"),
        F.create_map(*[x for n, e in feats.items() for x in (F.lit(n), e.cast("double"))]).alias("features"),
        F.when(c("bad"), F.concat(F.lit("attack:"), family)).otherwise("normal").alias("label"))
    return cut(spark.createDataFrame([], EVENT_LOG).unionByName(rows, True))


@pytest.fixture(scope="module")
def trained(log, tmp_path_factory):
    store = artefacts.Store(str(tmp_path_factory.mktemp("store")))
    return store, train.train(log, S, store=store)


def test_training_report(trained):
    _, report = trained
    d = report.decision
    assert d["test_roc_auc"] > 0.9 and 0.02 <= d["threshold"] < 0.99 and d["meta_inputs"][0] == "rate"
    assert report.frames["l1"].first().false_positives == 0
    families = {r.family: r for r in report.frames["families"].collect()}
    assert families and all(r.novel == (name == "cmdi") for name, r in families.items())
    dead = report.frames["variance"].filter("status = 'dead'").count()
    assert dead > 10
    val = report.fitted.pool("val")
    assert val.filter("family = 'cmdi'").count() == 0 and val.filter("family is null").count() > 0


def test_models_survive_the_store(spark, trained):
    from reqlens.models.bundle import score
    store, report = trained
    loaded = artefacts.load_models(spark, store)
    rows = report.fitted.patched.filter("pool = 'test'")
    a, b = (score(rows, m, S, window="win").select("row_id", F.round("p", 9).alias("p"))
            for m in (report.fitted.models, loaded))
    assert a.exceptAll(b).count() == 0
    assert loaded.threshold == report.decision["threshold"] and loaded.baseline.ready


def test_comparison_is_paired(trained):
    table, tests = train.compare(trained[1].fitted, S)
    assert {r.model for r in table.collect()} == set(train.DETECTORS)
    assert len({r.tp + r.tn + r.fp + r.fn for r in table.collect()}) == 1
    assert {r.pair for r in tests.collect()} == {"stack_vs_rate", "stack_vs_iforest", "stack_vs_autoencoder"}


def test_calibration_publishes_a_new_version(spark, log, trained):
    store, report = trained
    clean = log.filter("label = 'normal'")
    out = calibrate.calibrate(clean, store, S, force=True)
    assert out.version == artefacts.current_version(spark, store) != report.version
    loaded = artefacts.load_models(spark, store)
    assert loaded.threshold == out.threshold and loaded.decision["calibration_samples"] == clean.count()
    assert artefacts.load_decision(spark, store, report.version).first().threshold == report.decision["threshold"]
    assert artefacts.Reloader(store).get(spark).threshold == out.threshold


def test_calibration_gates_refuse(log, trained):
    store, _ = trained
    with pytest.raises(calibrate.GateFailed, match="samples"):
        calibrate.calibrate(log.limit(10), store, S)
    with pytest.raises(calibrate.GateFailed, match="contamination"):
        calibrate.calibrate(log, store, S.but(max_contamination=0.001))


def test_gates_table(spark):
    facts = spark.createDataFrame([(1999, 0.03, 0.1, 0.5, 0.5), (2000, 0.02, 0.8, 0.49, 0.5)],
                                  "n bigint, fraction double, threshold double, median double, previous double")
    rows = bl.calibration_gates(facts).collect()
    assert [r.passed for r in rows] == [False, False, False, False, True] + [True] * 5
    assert all(r.passed for r in bl.calibration_gates(facts, force=True).collect())


def test_small_pools_and_few_seeds_are_refused(log):
    with pytest.raises(train.PoolTooSmall):
        train.fit(log.limit(60), S)
    with pytest.raises(ValueError, match="runs"):
        train.validate(log.limit(60), seeds=(1, 2), settings=S)


def test_failed_seeds_are_rows_and_other_errors_are_raised(spark, log):
    runs = train.seed_runs(log.limit(60), (1, 2), S).collect()
    assert [(r.seed, r.f1) for r in runs] == [(1, None), (2, None)] and all("too small" in r.failure for r in runs)
    with pytest.raises(Exception, match="label|features|resolve"):
        train.seed_runs(log.drop("features", "label"), (1, 2), S)


def test_log_lines_are_counted_while_they_are_read(spark, tmp_path):
    from pyspark.sql import Observation

    from reqlens.sources import logs
    good = b'{"ts": 1.5, "method": "GET"}'
    (tmp_path / "a.log").write_bytes(b"\n".join([good, b"", b"   ", b"{broken", good[:-3] + b"\xff" + good[-3:], good]))
    seen = Observation()
    assert logs.read_event_log(spark, str(tmp_path), seen).count() == 3
    assert seen.get == {"lines": 6, "blank": 2, "malformed": 1, "repaired": 1}


def test_a_batch_run_again_replaces_its_rows(spark, tmp_path):
    from reqlens.streaming.scoring import batch_sink
    sink = batch_sink(str(tmp_path), "q")
    for batch, n in ((0, 5), (1, 7), (0, 5)):
        sink(spark.range(n), batch)
    assert spark.read.parquet(str(tmp_path)).groupBy("query", "batch").count().orderBy("batch").collect() == [("q", 0, 5), ("q", 1, 7)]


def test_drift_needs_old_spread(spark):
    def rate(mean, std):
        return spark.createDataFrame([(mean, std, 1)], RATE_BASELINE)
    assert bl.rate_drift(rate(10.0, 2.0), rate(17.0, 1.0)).first().large
    assert bl.rate_drift(rate(10.0, 0.0), rate(17.0, 1.0)).first().drift is None


def test_forest_walks_blocks_as_single_rows():
    import numpy as np
    import pandas as pd

    from reqlens.models import forest
    rng = np.random.default_rng(5)
    X = np.round(rng.normal(size=(forest.BLOCK + 700, 6)), 1)
    parts = [(t, *node) for t, k in enumerate((256, 1, 40))
             for node in forest.grow_tree(X[:k], np.random.default_rng(t))]
    nodes = pd.DataFrame(parts, columns=["tree", "node", "feature", "threshold", "left", "right", "size"])

    def walk(x, tree):
        at, depth = tree.loc[0], 0
        while at.feature >= 0:
            at, depth = tree.loc[int(at.left if x[int(at.feature)] <= at.threshold else at.right)], depth + 1
        return depth + float(forest.mean_path(at["size"]))
    got = forest.Forest(nodes, 256).score(X)
    trees = [t.set_index("node") for _, t in nodes.groupby("tree")]
    for i in (0, 17, forest.BLOCK - 1, forest.BLOCK, len(X) - 1):
        mean = sum(walk(X[i], t) for t in trees) / 3
        assert got[i] == 2.0 ** (-mean / float(forest.mean_path(256))) - 0.5
