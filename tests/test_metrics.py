"""Evaluation metrics against brute force and known values."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reqlens.operators import metrics, traffic
from reqlens.operators.running import cumulative_by_value, percentiles, running


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    # A third of all rows share one score.
    return [(i, 0.25 if i % 3 == 0 else round(rng.random() ** 2, 3), int(rng.random() < 0.3),
             rng.random()) for i in range(1500)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id bigint, score double, y int, v double")


def test_ranking_metrics(df, rows):
    y, s = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    pos, neg = s[y == 1][:, None], s[y == 0][None]
    auc = ((pos > neg).sum() + 0.5 * (pos == neg).sum()) / (pos.size * neg.size)
    ap, before = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        tp, fp = ((s >= t) & (y == 1)).sum(), ((s >= t) & (y == 0)).sum()
        ap += (tp / pos.size - before) * tp / (tp + fp)
        before = tp / pos.size
    got = metrics.ranking_metrics(df).first()
    assert got.roc_auc == pytest.approx(auc) and got.pr_auc == pytest.approx(ap)
    one = metrics.ranking_metrics(df.filter("y = 1")).first()
    assert np.isnan(one.roc_auc) and np.isnan(one.pr_auc)


def test_percentiles_interpolate(df, rows):
    v = np.array([r[3] for r in rows])
    got = percentiles(df, "v", {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.995, "e": 1.0}).first()
    assert list(got) == pytest.approx(list(np.percentile(v, [0, 1, 50, 99.5, 100])), abs=1e-12)
    assert percentiles(df.limit(1).select(F.lit(4.0).alias("v")), "v", {"m": 0.5}).first().m == 4.0


@pytest.mark.parametrize("budget", [None, 0.5, 0.05, 0.0])
def test_threshold_choice(df, rows, budget):
    y, s = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    best = (0.0, 0.5)
    for t in np.arange(0.02, 0.99, 0.005):
        p = s >= t
        tp, fp, fn = (p & (y == 1)).sum(), (p & (y == 0)).sum(), (~p & (y == 1)).sum()
        f1 = 2 * tp / (2 * tp + fp + fn)
        if (budget is None or fp / (y == 0).sum() <= budget) and f1 > best[0] + 1e-12:
            best = (f1, float(t))
    got = metrics.pick_threshold(df, budget).first()
    assert (got.threshold, got.f1) == (best[1], pytest.approx(best[0]))
    assert got.feasible == (best[0] > 0)


def test_sweep_equals_direct_counts(df, rows):
    y, s = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    got = {r.i: r for r in metrics.threshold_sweep(df).collect()}
    grid = np.arange(0.02, 0.99, 0.005)
    assert len(got) == len(grid) == metrics.GRID_SIZE
    for i, t in enumerate(grid):
        assert (got[i].threshold, got[i].tp, got[i].fp) == (
            t, ((s >= t) & (y == 1)).sum(), ((s >= t) & (y == 0)).sum())


def test_formulas_on_stored_counts(spark):
    df = spark.createDataFrame([(667, 1358, 27, 75), (0, 0, 0, 0)], "tp int, tn int, fp int, fn int")
    a, b = metrics.with_metrics(df).collect()
    assert [round(a[k], 4) for k in ("accuracy", "precision", "recall", "f1", "fpr", "fnr")] == [
        0.952, 0.9611, 0.8989, 0.929, 0.0195, 0.1011]
    assert all(b[k] == 0.0 for k in ("accuracy", "precision", "recall", "f1", "fpr", "fnr"))


def test_mcnemar_stored_values(spark):
    df = spark.createDataFrame([(429, 43), (492, 20), (88, 17), (3, 1), (0, 0)], "n01 int, n10 int")
    got = metrics.with_mcnemar(df).withColumn("v", metrics.verdict()).collect()
    want = [2.884188141240363e-70, 3.1354899287937788e-96, 8.414824849078409e-12, 0.625, 1.0]
    assert [r.p for r in got] == pytest.approx(want, rel=1e-9)
    assert [r.significant for r in got] == [True, True, True, False, False]
    assert got[3].method == "exact binomial" and got[0].v == "stack significantly better"


RUNS = [0.9456, 0.8731, 0.8223, 0.7182, 0.8013, 0.8569, 0.8248, 0.8785, 0.8767, 0.9377]


def test_bootstrap_and_summary(spark):
    df = spark.createDataFrame([(v, None if i else 0.5) for i, v in enumerate(RUNS)], "f1 double, recall double")
    got = metrics.bootstrap_ci(df, "f1", 4_000).first()
    assert (got.mean, got.n) == (pytest.approx(0.85351), 10)
    assert got.ci_low == pytest.approx(0.81232, abs=0.004) and got.ci_high == pytest.approx(0.891041, abs=0.004)
    assert np.isnan(metrics.bootstrap_ci(df, "recall").first().ci_low)
    summary = {r.metric: r for r in metrics.seed_summary(df, ["f1", "recall"]).collect()}
    assert (summary["f1"].min, summary["f1"].max, summary["recall"].n) == (0.7182, 0.9456, 1)


def test_bootstrap_of_many_and_of_equal_values(spark):
    """A third of the rows hold one value; bounds near the mean's normal ones."""
    df = spark.range(6_000).select(F.when(F.col("id") % 3 == 0, 0.5).otherwise(
        F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("v"))
    got = metrics.bootstrap_ci(df, "v", 1_000).first()
    error = 1.96 * df.agg(F.stddev("v")).first()[0] / 6_000 ** 0.5
    assert got.n == 6_000 and got.ci_low == pytest.approx(got.mean - error, abs=error * 0.15)
    assert got.ci_high == pytest.approx(got.mean + error, abs=error * 0.15)
    again = metrics.bootstrap_ci(df.repartition(7), "v", 1_000).first()
    assert (again.ci_low, again.ci_high) == (pytest.approx(got.ci_low, rel=1e-12), pytest.approx(got.ci_high, rel=1e-12))
    none = metrics.bootstrap_ci(df.filter("v > 9"), "v", 100).first()
    assert none.n == 0 and none.mean is None and np.isnan(none.ci_low) and np.isnan(none.ci_high)


def test_family_recall_joins_both_sides(spark):
    scored = spark.createDataFrame([("sqli", 1, 1), ("sqli", 1, 0), ("cmdi", 1, 1), (None, 0, 1)],
                                   "family string, y int, pred int")
    settled = spark.createDataFrame([("sqli", 1), ("scan", 1), (None, 0)], "family string, y int")
    got = {r.family: (r.ml_n, r.ml_recall, r.l1_caught, r.pipeline_recall, r.novel)
           for r in metrics.family_recall(scored, settled).collect()}
    assert got == {"sqli": (2, 0.5, 1, 2 / 3, False), "cmdi": (1, 1.0, 0, 1.0, True),
                   "scan": (0, None, 1, 1.0, False)}
    assert list(metrics.zero_day_recall(scored).first()) == [1.0, 0.5]


def test_running_matches_plain_window(spark):
    rng = random.Random(1)
    rows = [("ab"[rng.random() < 0.8], rng.randrange(5_000), i, rng.randrange(9)) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, at bigint, i bigint, n bigint")
    both = running(running(df, ["k"], "at", "n", "s", 100, ("i",)), ["k"], "at", "n", "m", 70, ("i",), "max")
    for k in "ab":
        total, top = 0, 0
        for r in both.filter(F.col("k") == k).orderBy("at", "i").collect():
            total, top = total + r.n, max(top, r.n)
            assert (r.s, r.m) == (total, top)


def test_cumulative_survives_one_value(spark):
    df = spark.range(500).select(F.lit(0.5).alias("v"))
    assert list(cumulative_by_value(df, "v", {"n": F.lit(1)}).first()) == [0.5, 500, 500]


def test_series_fills_gaps(spark):
    df = spark.sql("SELECT timestamp_seconds(s) AS time, a AS action FROM VALUES (3, 'allow'), (4, 'block'), "
                   "(7209, 'allow') t(s, a)")
    got = traffic.traffic_series(df).withColumn("s", F.unix_seconds("bin")).orderBy("s").collect()
    assert [r.s for r in got] == list(range(0, 7210, 5))
    assert (got[0].allowed, got[0].blocked, got[1].allowed, got[-1].allowed) == (1, 1, 0, 1)


@pytest.mark.parametrize("kind", ["even", "tied", "tails", "few"])
def test_percentiles_of_many_rows_are_exact(spark, kind):
    from reqlens.operators.running import percentiles_by
    rng = np.random.default_rng(8)
    v = {"even": rng.random(60_000), "tied": rng.integers(0, 5, 60_000).astype(float),
         "tails": np.exp(rng.normal(size=60_000) * 4), "few": rng.random(7)}[kind]
    df = spark.createDataFrame([(float(x), float(-x)) for x in v] + [(None, float("nan"))], "a double, b double").repartition(6)
    wanted = {"z": 0.0, "lo": 0.01, "m": 0.5, "hi": 0.995, "top": 0.9999, "one": 1.0}
    got = {r["column"]: r for r in percentiles_by(df, ["a", "b"], wanted).collect()}
    for name, p in wanted.items():
        assert got["a"][name] == pytest.approx(np.percentile(v, 100 * p), rel=1e-12)
        assert got["b"][name] == pytest.approx(np.percentile(-v, 100 * p), rel=1e-12)
