"""Detector evaluation: data checks, confusion and ranking metrics, statistics."""
from __future__ import annotations

from pyspark.sql import functions as F

from registry import query
from registry.inputs import (LABELLED_SQL, LOG_SQL, REQUESTS_SQL, SCORED_SQL, event_log, labelled,
                             r6, requests, scored, with_)
from registry.shapes import featured
from reqlens.functions import scalars
from reqlens.operators import eventlog, metrics
from reqlens.operators import baseline as bl

SC = with_(SCORED_SQL)


def _pool_sql(client: str, seed) -> str:
    return (f"CASE WHEN CAST(concat('0x', substr(sha256({client} || '|{seed}'), 1, 8)) AS UBIGINT) % 100 < 45 "
            f"THEN 'base' WHEN CAST(concat('0x', substr(sha256({client} || '|{seed}'), 1, 8)) AS UBIGINT) % 100 "
            f"< 70 THEN 'meta' WHEN CAST(concat('0x', substr(sha256({client} || '|{seed}'), 1, 8)) AS UBIGINT) "
            "% 100 < 85 THEN 'val' ELSE 'test' END")


_METRICS = ["tp", "tn", "fp", "fn", "accuracy", "precision", "recall", "f1", "fpr", "fnr"]
_RATIOS = _METRICS[4:]
_METRIC_SQL = """tp, tn, fp, fn, round((tp + tn) / greatest(1, tp + tn + fp + fn), 6) AS accuracy,
  round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
  round(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1,
  round(CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn) END, 6) AS fpr,
  round(CASE WHEN fn + tp = 0 THEN 0 ELSE fn / (fn + tp) END, 6) AS fnr"""


def _confusion_sql(p: str, y: str = "y = 1") -> str:
    return (f"count(*) FILTER ({p} AND {y}) AS tp, count(*) FILTER (NOT ({p}) AND NOT ({y})) AS tn, "
            f"count(*) FILTER ({p} AND NOT ({y})) AS fp, count(*) FILTER (NOT ({p}) AND {y}) AS fn")


def _rounded(df, columns=_RATIOS):
    return df.withColumns({c: r6(c) for c in columns})


def _predicted(spark, sf):
    return scored(spark, sf).withColumn("pred", (F.col("score") >= 0.05).cast("int"))


# ── splits and data checks ───────────────────────────────────────────────────

@query("pool_assignment", with_(REQUESTS_SQL) + f"""
SELECT event_id, {_pool_sql('client', 42)} AS pool FROM req""")
def pool_assignment(spark, sf):
    return requests(spark, sf).select("event_id", scalars.pool_of("client", 42).alias("pool"))


@query("pool_counts", with_(LABELLED_SQL) + f"""
SELECT {_pool_sql('client', 7)} AS pool, count(*) AS n, sum(y)::BIGINT AS attacks FROM lab GROUP BY 1""")
def pool_counts(spark, sf):
    return metrics.pool_counts(eventlog.with_pool(labelled(spark, sf), 7))


@query("duplication", """
SELECT distinct_vectors, n, round(distinct_vectors / n, 6) AS ratio,
  distinct_vectors < 0.2 * n AS warn
FROM (SELECT count(DISTINCT (event_type, round_even(value, 0), length(props))) AS distinct_vectors,
  count(*) AS n FROM events)""")
def duplication(spark, sf):
    df = requests(spark, sf).select(
        F.length("template").alias("a"), F.unix_millis("ts").alias("t"),
        F.when(F.col("template").contains("view"), 1).when(F.col("template").contains("click"), 2)
        .when(F.col("template").contains("signup"), 3).when(F.col("template").contains("error"), 4)
        .otherwise(5).alias("kind"),
        F.bround("latency_ms", 0).alias("v"), "body_size")
    return metrics.duplication(df, ["kind", "v", "body_size"]).withColumn("ratio", r6("ratio"))


@query("duplication_features")
def duplication_features(spark, sf):
    return metrics.duplication(featured(spark, sf)).withColumn("ratio", r6("ratio"))


@query("l1_partition", with_(LABELLED_SQL) + """
SELECT count(*) FILTER (l1) AS settled, count(*) FILTER (l1 AND y = 1) AS attacks,
  count(*) FILTER (l1 AND by_rule) AS by_rule, count(*) FILTER (NOT l1) AS reach_ml,
  count(*) FILTER (l1 AND y = 0) AS false_positives,
  count(*) FILTER (l1 AND NOT by_rule) AS by_rate FROM lab""")
def l1_partition(spark, sf):
    return metrics.l1_partition(labelled(spark, sf))


_MEASURES = {"body_size": "body_size", "latency_ms": "latency_ms", "steady": "1",
             "faint": "(event_id % 2) / 200", "status": "status"}


@query("feature_variance", with_(LOG_SQL) + " UNION ALL ".join(
    f"SELECT '{n}' AS feature, round(avg({e}), 6) AS mean, round(stddev_pop({e}), 6) AS std, "
    f"CASE WHEN stddev_pop({e}) < 1e-12 THEN 'dead' WHEN stddev_pop({e}) < 0.01 THEN 'near-constant' "
    "ELSE 'ok' END AS status FROM log" for n, e in _MEASURES.items()))
def feature_variance(spark, sf):
    df = event_log(spark, sf).withColumns({"steady": F.lit(1), "faint": F.expr("(event_id % 2) / 200")})
    return _rounded(metrics.feature_variance(df, list(_MEASURES)), ["mean", "std"])


@query("skew_check", with_(LABELLED_SQL) + """,
  z AS (SELECT greatest(-10, least(10, (win - m) / s)) AS rate_z, CASE WHEN bs > 1e-9 THEN
    greatest(-10, least(10, (body_size - bm) / bs)) ELSE 0 END AS body_size_z,
    CASE WHEN n >= 5 THEN 1 ELSE 0 END AS path_known
    FROM (SELECT * FROM lab, (SELECT avg(win) AS m, stddev_pop(win) AS s FROM lab WHERE y = 0)) w
    LEFT JOIN (SELECT template, avg(body_size) AS bm, stddev_pop(body_size) AS bs, count(*) AS n
      FROM lab WHERE y = 0 GROUP BY template HAVING count(*) >= 5) USING (template))
""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, "
    f"stddev_pop({c}) < 1e-9 AS constant FROM z" for c in ("rate_z", "body_size_z", "path_known")))
def skew_check(spark, sf):
    df = labelled(spark, sf)
    patched = bl.apply_baseline(df, bl.build_baseline(df.filter("y = 0")))
    return _rounded(metrics.skew_check(patched), ["mean", "std"])


# ── confusion and ranking ────────────────────────────────────────────────────

@query("confusion_metrics", SC + f"SELECT {_METRIC_SQL} FROM (SELECT "
       + _confusion_sql("score >= 0.05") + " FROM sc)")
def confusion_metrics(spark, sf):
    return _rounded(metrics.metrics(_predicted(spark, sf)))


@query("pipeline_metrics", SC + f"SELECT {_METRIC_SQL} FROM (SELECT "
       + _confusion_sql("(l1 OR score >= 0.05)") + " FROM sc)")
def pipeline_metrics(spark, sf):
    df = _predicted(spark, sf)
    return _rounded(metrics.pipeline_metrics(df.filter("NOT l1"), df.filter("l1")))


_RANK_SQL = """g AS (SELECT score, sum(y) AS p, count(*) - sum(y) AS q FROM sc GROUP BY score),
  k AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp FROM g WINDOW w AS (ORDER BY score DESC
    ROWS UNBOUNDED PRECEDING))"""


@query("roc_auc", with_(SCORED_SQL, _RANK_SQL) + """
SELECT round(sum(q * (tp - p / 2)) / (sum(p) * sum(q)), 6) AS roc_auc FROM k""")
def roc_auc(spark, sf):
    return _rounded(metrics.roc_auc(scored(spark, sf)), ["roc_auc"])


@query("average_precision", with_(SCORED_SQL, _RANK_SQL) + """
SELECT round(sum(p * tp / (tp + fp)) / sum(p), 6) AS pr_auc FROM k""")
def average_precision(spark, sf):
    return _rounded(metrics.average_precision(scored(spark, sf)), ["pr_auc"])


_SWEEP_SQL = f"""grid AS (SELECT i, 0.02::DOUBLE + i * ((0.02::DOUBLE + 0.005::DOUBLE) - 0.02::DOUBLE)
    AS threshold FROM range(194) t(i)),
  sweep AS (SELECT i, threshold, {_confusion_sql('s.score >= threshold', 's.y = 1')}
    FROM grid, sc s GROUP BY i, threshold)"""


@query("threshold_sweep", with_(SCORED_SQL, _SWEEP_SQL) + f"""
SELECT i, round(threshold, 6) AS threshold, {_METRIC_SQL} FROM sweep""")
def threshold_sweep(spark, sf):
    return _rounded(metrics.threshold_sweep(scored(spark, sf)), ["threshold", *_RATIOS])


def _pick_sql(budget: str) -> str:
    return with_(SCORED_SQL, _SWEEP_SQL) + f"""
SELECT coalesce(round(max(threshold), 6), 0.5) AS threshold, coalesce(round(max(f1), 6), 0) AS f1,
  count(*) > 0 AS feasible FROM (SELECT threshold, CASE WHEN tp = 0 THEN 0 ELSE
    2 * tp / (2 * tp + fp + fn) END AS f1 FROM sweep WHERE tp > 0 AND {budget}
  ORDER BY f1 DESC, i LIMIT 1)"""


@query("pick_threshold", _pick_sql("true"))
def pick_threshold(spark, sf):
    return _rounded(metrics.pick_threshold(scored(spark, sf)), ["threshold", "f1"])


@query("pick_threshold_budget", _pick_sql("fp / (fp + tn) <= 0.05"))
def pick_threshold_budget(spark, sf):
    return _rounded(metrics.pick_threshold(scored(spark, sf), 0.05), ["threshold", "f1"])


@query("pick_threshold_infeasible", """
SELECT 0.5 AS threshold, 0.0 AS f1, false AS feasible FROM labels HAVING count(*) > 0""")
def pick_threshold_infeasible(spark, sf):
    """Scores that invert the labels: nothing fits the budget."""
    df = scored(spark, sf).withColumn("score", 1.0 - F.col("y"))
    return metrics.pick_threshold(df, 0.01)


# ── percentiles and thresholds ───────────────────────────────────────────────

@query("score_range", SC + """
SELECT 'score' AS name, round(quantile_cont(score, 0.01), 6) AS lo,
  round(quantile_cont(score, 0.995), 6) AS hi FROM sc UNION ALL
SELECT 'score2', round(quantile_cont(score2, 0.01), 6), round(quantile_cont(score2, 0.995), 6)
FROM sc""")
def score_range(spark, sf):
    found = metrics.score_range(scored(spark, sf), {"score": "score", "score2": "score2"})
    rows = spark.createDataFrame([(k, *v) for k, v in found.items()], "name string, lo double, hi double")
    return _rounded(rows, ["lo", "hi"])


@query("calibrated_threshold", SC + """
SELECT round(t, 6) AS threshold, round((SELECT avg(CASE WHEN score2 >= t THEN 1 ELSE 0 END) FROM sc),
  6) AS would_block
FROM (SELECT greatest(0.05, least(0.999, quantile_cont(score2, 0.95))) AS t FROM sc)""")
def calibrated_threshold(spark, sf):
    return _rounded(metrics.calibrated_threshold(scored(spark, sf), 0.05, "score2"),
                    ["threshold", "would_block"])


@query("score_distribution", SC + """
SELECT round(quantile_cont(score2, 0.5), 6) AS p50, round(quantile_cont(score2, 0.95), 6) AS p95,
  round(quantile_cont(score2, 0.99), 6) AS p99, round(max(score2), 6) AS max FROM sc""")
def score_distribution(spark, sf):
    return _rounded(metrics.score_distribution(scored(spark, sf), "score2"),
                    ["p50", "p95", "p99", "max"])


@query("saturation", SC + """
SELECT round(avg(CASE WHEN score >= 0.999 THEN 1 ELSE 0 END), 6) AS ceiling,
  round(avg(CASE WHEN score2 >= 0.9 THEN 1 ELSE 0 END), 6) AS would_block,
  avg(CASE WHEN score2 >= 0.9 THEN 1 ELSE 0 END) > 0.02 AS unreachable FROM sc""")
def saturation(spark, sf):
    df = scored(spark, sf)
    blocked = df.agg(F.avg(F.when(F.col("score2") >= 0.9, 1.0).otherwise(0.0))).scalar()
    return _rounded(metrics.saturation(df, blocked, 0.01, "score"), ["ceiling", "would_block"])


# ── families and paired tests ────────────────────────────────────────────────

@query("family_recall", SC + """
SELECT family, count(*) FILTER (NOT l1) AS ml_n, round(avg(CASE WHEN score >= 0.05 THEN 1 ELSE 0 END)
    FILTER (NOT l1), 6) AS ml_recall, count(*) FILTER (l1) AS l1_caught,
  round(count(*) FILTER (l1 OR score >= 0.05) / count(*), 6) AS pipeline_recall,
  family IN ('cmdi', 'exfil', 'ssti') AS novel FROM sc WHERE y = 1 GROUP BY family""")
def family_recall(spark, sf):
    df = _predicted(spark, sf)
    return _rounded(metrics.family_recall(df.filter("NOT l1"), df.filter("l1")),
                    ["ml_recall", "pipeline_recall"])


@query("zero_day_recall", SC + """
SELECT round(avg(p) FILTER (y = 1 AND family = 'cmdi'), 6) AS zero_day_recall,
  round(avg(p) FILTER (y = 1 AND family <> 'cmdi'), 6) AS known_recall
FROM (SELECT *, CASE WHEN score >= 0.05 THEN 1 ELSE 0 END AS p FROM sc)""")
def zero_day_recall(spark, sf):
    return _rounded(metrics.zero_day_recall(_predicted(spark, sf)), ["zero_day_recall", "known_recall"])


def _pairs(spark, sf, *keys):
    return scored(spark, sf).select(
        *keys,
        ((F.col("score") >= 0.05).cast("int") == F.col("y")).alias("a"),
        ((F.col("score2") >= 0.5).cast("int") == F.col("y")).alias("b"))


_PAIR_SQL = """(SELECT count(*) FILTER (a AND NOT b) AS n01, count(*) FILTER (NOT a AND b) AS n10
  FROM (SELECT (score >= 0.05) = (y = 1) AS a, (score2 >= 0.5) = (y = 1) AS b FROM sc))"""


@query("paired_discordance", SC + f"SELECT * FROM {_PAIR_SQL}")
def paired_discordance(spark, sf):
    return metrics.paired_discordance(_pairs(spark, sf), "a", "b")


def _mcnemar_sql(pairs, keys=""):
    """McNemar's test of counts: the binomial tail, or the chi-square tail by the series of
    the error function with positive terms (beyond 30 it rounds to nothing)."""
    return f"""SELECT {keys} n01, n10, round(p, 6) AS p, CASE WHEN n = 0 THEN 'no discordant pairs'
    WHEN n < 25 THEN 'exact binomial' ELSE 'chi-square with continuity correction' END AS method,
  n > 0 AND p < 0.05 AS significant, CASE WHEN n > 0 AND p < 0.05 AND n01 > n10 THEN 'stack significantly better'
    WHEN n > 0 AND p < 0.05 THEN 'single detector significantly better'
    ELSE 'no significant difference' END AS verdict
FROM (SELECT *, CASE WHEN n = 0 THEN 1 WHEN n < 25 THEN least(1, 2 * list_sum([exp(lgamma(n + 1) - lgamma(k + 1)
      - lgamma(n - k + 1)) for k in range(least(n01, n10) + 1)]) / pow(2, n))
    WHEN x > 30 THEN 0 WHEN x = 0 THEN 1 ELSE 1 - 2 / sqrt(pi()) * exp(-x / 2) * list_sum([exp(k * ln(4)
      + (2 * k + 1) * ln(sqrt(x / 2)) + lgamma(k + 1) - lgamma(2 * k + 2)) for k in range(120)]) END AS p
  FROM (SELECT *, n01 + n10 AS n, CASE WHEN n01 + n10 > 0 THEN pow(abs(n01 - n10) - 1, 2) / (n01 + n10) END AS x
    FROM {pairs}))"""


def _tested(counts):
    tested = metrics.with_mcnemar(counts).withColumn("verdict", metrics.verdict())
    return tested.withColumn("p", r6("p"))


@query("mcnemar", SC + _mcnemar_sql(_PAIR_SQL))
def mcnemar(spark, sf):
    return _tested(metrics.paired_discordance(_pairs(spark, sf), "a", "b"))


@query("mcnemar_by_client", SC + _mcnemar_sql("""(SELECT client, count(*) FILTER (a AND NOT b) AS n01,
    count(*) FILTER (NOT a AND b) AS n10
  FROM (SELECT client, (score >= 0.05) = (y = 1) AS a, (score2 >= 0.5) = (y = 1) AS b FROM sc) GROUP BY client)""",
                                              "client,"))
def mcnemar_by_client(spark, sf):
    """Few pairs a client: the exact branch."""
    pairs = _pairs(spark, sf, "client")
    return _tested(metrics.paired_discordance(pairs, "a", "b", by=["client"]))


_MODELS_SQL = """m AS (SELECT 'rate' AS model, score >= 0.02 AS p, y FROM sc UNION ALL
  SELECT 'iforest', score2 >= 0.5, y FROM sc UNION ALL
  SELECT 'autoencoder', score2 >= 0.1, y FROM sc UNION ALL
  SELECT 'stack', score >= 0.05 AND score2 >= 0.1, y FROM sc),
  f AS (SELECT model, 2 * tp / (2 * tp + fp + fn) AS f1 FROM (SELECT model, count(*) FILTER (p AND y = 1)
    AS tp, count(*) FILTER (p AND y = 0) AS fp, count(*) FILTER (NOT p AND y = 1) AS fn
    FROM m GROUP BY model))"""


@query("best_single", with_(SCORED_SQL, _MODELS_SQL) + """
SELECT arg_max(model, f1) FILTER (model <> 'stack') AS best,
  round(max(f1) FILTER (model <> 'stack'), 6) AS best_f1,
  round(max(f1) FILTER (model = 'stack'), 6) AS stack_f1,
  max(f1) FILTER (model = 'stack') > max(f1) FILTER (model <> 'stack') AS stack_wins FROM f""")
def best_single(spark, sf):
    c = F.col
    preds = {"rate": c("score") >= 0.02, "iforest": c("score2") >= 0.5,
             "autoencoder": c("score2") >= 0.1, "stack": (c("score") >= 0.05) & (c("score2") >= 0.1)}
    long = scored(spark, sf).select("y", F.explode(F.array(*[
        F.struct(F.lit(n).alias("model"), p.cast("int").alias("pred"))
        for n, p in preds.items()])).alias("m")).select("y", "m.*")
    return _rounded(metrics.best_single(metrics.metrics(long, "model")), ["best_f1", "stack_f1"])


# ── seeds ────────────────────────────────────────────────────────────────────

SEEDS = tuple(range(1, 11))
_RUN_SQL = "runs AS (" + " UNION ALL ".join(
    f"SELECT {s} AS seed, {_METRIC_SQL} FROM (SELECT {_confusion_sql('score2 >= 0.3')} FROM "
    f"(SELECT * FROM sc WHERE {_pool_sql('client', s)} IN ('val', 'test')) HAVING count(*) > 0)"
    for s in SEEDS) + ")"


def _seed_runs(spark, sf):
    """Held-out metrics per split seed: each row joins the splits it is held out
    in, ten at most, as an expression and not as a join."""
    seeds = F.array_compact(F.array(*[
        F.when(scalars.pool_of("client", s).isin("val", "test"), F.lit(s)) for s in SEEDS]))
    rows = scored(spark, sf).select(
        F.explode(seeds).alias("seed"), "y", (F.col("score2") >= 0.3).cast("int").alias("pred"))
    return _rounded(metrics.metrics(rows, "seed"))


@query("seed_runs", with_(SCORED_SQL, _RUN_SQL) + "SELECT * FROM runs")
def seed_runs(spark, sf):
    return _seed_runs(spark, sf)


@query("seed_summary", with_(SCORED_SQL, _RUN_SQL) + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, min({m}) AS min, max({m}) AS max, "
    f"count({m}) AS n FROM runs" for m in ("f1", "recall", "precision", "fpr")))
def seed_summary(spark, sf):
    return _rounded(metrics.seed_summary(_seed_runs(spark, sf), ["f1", "recall", "precision", "fpr"]),
                    ["mean"])


@query("bootstrap_ci")
def bootstrap_ci(spark, sf):
    return metrics.bootstrap_ci(_seed_runs(spark, sf), "f1")
