"""Scaling, detectors, the decision cascade and the training plans."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from registry import query
from registry.inputs import (DAY, PAGES_SQL, REQUESTS_SQL, VECTOR, event_log, page_requests, r6, requests,
                             scored, vectors, with_, LOG_SQL, SCORED_SQL)
from registry.shapes import _BASE_SQL, _CHARS_SQL, _FEATURE_SQL, _HITS_SQL, _RULES_SQL, featured
from reqlens.config import DEFAULTS
from reqlens.functions import rules, scalars
from reqlens.models import autoencoder, forest, meta, scaler
from reqlens.models.bundle import ModelSet, score
from reqlens.operators import decide, eventlog
from reqlens.operators import baseline as bl
from reqlens.plans import train
from reqlens.schemas import FEATURE_NAMES, FOREST_NODES
from reqlens.session import cut

_AVERAGES = ", ".join(f"avg(e[{i + 1}]) AS m{i}, stddev_pop(e[{i + 1}]) AS s{i}" for i in range(64))
_UNROLLED = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


@query("standardise", with_(_UNROLLED, f"p AS (SELECT {_AVERAGES} FROM v WHERE label = 0)")
       + "SELECT vec_id, " + ", ".join(
    f"round((e[{i + 1}] - m{i}) / s{i}, 6) AS x{i}" for i in range(64)) + " FROM v, p")
def standardise(spark, sf):
    df = vectors(spark, sf)
    params = scaler.parameters(scaler.fit_scaler(df.filter("label = 0"), VECTOR), VECTOR)
    return df.select("vec_id", *[r6(c).alias(n) for n, c in scaler.scaled(params).items()])


@query("scaler_parameters", """
SELECT 'constant' AS feature, 3.0 AS mean, 1.0 AS scale FROM embeddings HAVING count(*) > 0
UNION ALL SELECT 'label', round(avg(label), 6), round(stddev_pop(label), 6) FROM embeddings""")
def scaler_parameters(spark, sf):
    """A constant column keeps scale 1."""
    df = vectors(spark, sf).withColumn("constant", F.lit(3.0))
    return scaler.fit_scaler(df, ["constant", "label"]).withColumns(
        {c: r6(c) for c in ("mean", "scale")})


@query("norm_score", with_(SCORED_SQL) + """
SELECT doc_id, round(greatest(0, least(1, (score - 0.01) / (0.2 - 0.01 + 1e-9))), 6) AS s FROM sc""")
def norm_score(spark, sf):
    return scored(spark, sf).select("doc_id", r6(scalars.norm_score("score", 0.01, 0.2)).alias("s"))


@query("meta_probability", with_(LOG_SQL) + """
SELECT event_id, round(1 / (1 + exp(-(-4.2 + 1.5 * s_rate + 2.5 * s_if + 6.1 * s_ae))), 6) AS p
FROM log WHERE modelled""")
def meta_probability(spark, sf):
    learner = meta.Meta(-4.2, {"rate": 1.5, "isolation_forest": 2.5, "autoencoder": 6.1})
    rows = eventlog.ml_decided(eventlog.flatten_scores(event_log(spark, sf)))
    return rows.select("event_id", r6(learner.probability()).alias("p"))


@query("meta_fit")
def meta_fit(spark, sf):
    rows = eventlog.with_label(eventlog.flatten_scores(event_log(spark, sf))).filter(
        "y IS NOT NULL AND rate IS NOT NULL")
    return meta.fit_meta(rows).table(spark)


def _vector_model(spark, sf):
    df = vectors(spark, sf)
    base = df.filter("label = 0")
    return df, base, scaler.scaled_vector(scaler.parameters(scaler.fit_scaler(base, VECTOR), VECTOR))


@query("iforest_scores")
def iforest_scores(spark, sf):
    df, base, vector = _vector_model(spark, sf)
    nodes, sample = forest.fit_forest(base, vector, "vec_id", DEFAULTS.forest_trees, DEFAULTS.forest_samples)
    scored_ = forest.score_forest(df, vector, forest.load_forest(nodes, sample))
    return scored_.select("vec_id", "label", r6("if_raw").alias("if_raw"))


@query("iforest_nodes")
def iforest_nodes(spark, sf):
    _, base, vector = _vector_model(spark, sf)
    nodes, _ = forest.fit_forest(base, vector, "vec_id", DEFAULTS.forest_trees, DEFAULTS.forest_samples)
    return nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("nodes"),
                                     F.max(F.when(F.col("node") == 0, F.col("size"))).alias("rows"))


@query("autoencoder_scores")
def autoencoder_scores(spark, sf):
    df, base, vector = _vector_model(spark, sf)
    net, _ = autoencoder.fit_autoencoder(base, vector, "vec_id", DEFAULTS)
    return autoencoder.score_autoencoder(df, vector, net).select(
        "vec_id", "label", r6("ae_raw").alias("ae_raw"))


# ── decisions ────────────────────────────────────────────────────────────────

def _decided(spark, sf, settings=DEFAULTS, models=None):
    """Whole pages with a payload, every tenth one over the rate limit."""
    df = page_requests(spark, sf).withColumns({
        "hits": rules.scan(), "rate_limited": F.col("page_id") % 10 == 3,
        "rate_reason": F.when(F.col("page_id") % 20 == 3, "burst limit exceeded").otherwise(""),
        "body_size": F.col("page_id") * 10_000, "status": F.lit(200)})
    return decide.decide(df, models, settings)


_CASCADE_SQL = """dec AS (SELECT page_id, ids, CASE WHEN blk THEN 'L1-rules' WHEN page_id % 10 = 3
    THEN 'L1-rate' ELSE 'L1-only' END AS layer, CASE WHEN blk OR page_id % 10 = 3 THEN 'block'
    ELSE 'allow' END AS action, CASE WHEN blk THEN reason WHEN page_id % 20 = 3
    THEN 'burst limit exceeded' WHEN page_id % 10 = 3 THEN 'rate limit exceeded'
    ELSE 'anomaly models not loaded' END AS reason, cats || CASE WHEN NOT blk AND page_id % 10 = 3
    THEN CASE WHEN cats = '' THEN 'rate' ELSE ',rate' END ELSE '' END AS categories, page_id
    * 10000 AS body_size FROM (
  SELECT page_id, any_value(ids) AS ids, coalesce(bool_or(severity = 'block'), false) AS blk,
    arg_min(id || ': ' || why, ordinal) FILTER (severity = 'block') AS reason,
    coalesce(string_agg(DISTINCT category, ',' ORDER BY category), '') AS cats
  FROM (SELECT page_id, ids, unnest(CASE WHEN ids = '' THEN [NULL] ELSE string_split(ids, ',') END)
    AS id FROM hit) LEFT JOIN rule USING (id) GROUP BY page_id))"""
_DECIDED = with_(PAGES_SQL, _HITS_SQL, _RULES_SQL, _CASCADE_SQL)


@query("decision_cascade", _DECIDED + """
SELECT page_id, action, layer, reason, ids AS rule_hits, categories, layer = 'L1-only' AS degraded,
  CASE WHEN action = 'block' THEN 1.0 ELSE 0.0 END AS probability,
  CASE layer WHEN 'L1-rules' THEN 'rule' WHEN 'L1-rate' THEN 'rate' ELSE '' END AS score FROM dec""")
def decision_cascade(spark, sf):
    df = _decided(spark, sf)
    return df.select(
        "page_id", "action", "layer", "reason", F.array_join("rule_hits", ",").alias("rule_hits"),
        F.array_join("categories", ",").alias("categories"), "degraded", "probability",
        F.array_join(F.map_keys("scores"), ",").alias("score"))


@query("enforcement_modes", with_(LOG_SQL) + """
SELECT event_id, action = 'block' AS enforce, enforced AS enforce_l1, false AS monitor,
  CASE WHEN action = 'block' AND NOT enforced THEN layer END AS would_block,
  CASE WHEN body_size > 9 THEN 413 WHEN enforced THEN 403 ELSE status END AS seen FROM log""")
def enforcement_modes(spark, sf):
    df = event_log(spark, sf)
    small = DEFAULTS.but(max_body_bytes=9)
    return df.select(
        "event_id", decide.enforced(DEFAULTS.but(mode="enforce")).alias("enforce"),
        decide.enforced(DEFAULTS).alias("enforce_l1"),
        decide.enforced(DEFAULTS.but(mode="monitor")).alias("monitor"),
        decide.would_block().alias("would_block"), decide.response_status(small).alias("seen"))


def _models(spark, sf):
    """Detectors fitted on all normal event requests."""
    df = cut(featured(spark, sf))
    base = df.filter("y = 0")
    params = scaler.parameters(scaler.fit_scaler(base, FEATURE_NAMES), FEATURE_NAMES)
    vector = scaler.scaled_vector(params)
    nodes, sample = forest.fit_forest(base, vector, "event_id", DEFAULTS.forest_trees, DEFAULTS.forest_samples)
    net, _ = autoencoder.fit_autoencoder(base, vector, "event_id", DEFAULTS)
    learner = meta.Meta(-3.0, {"rate": 2.0, "isolation_forest": 2.0, "autoencoder": 4.0})
    return df, ModelSet(params, forest.load_forest(nodes, sample), net, learner,
                        bl.empty_baseline(spark), {"if": (-0.1, 0.2), "ae": (0.0, 2.0)}, 0.5,
                        FEATURE_NAMES, {})


@query("decision_models")
def decision_models(spark, sf):
    """The full cascade with fitted models over event requests."""
    df, models = _models(spark, sf)
    df = df.withColumns({
        "window_count": F.col("event_id") % 9, "burst_count": F.col("event_id") % 4,
        "rate_limited": F.col("event_id") % 50 == 0, "rate_reason": F.lit("")})
    out = decide.decide(df.withColumn("hits", rules.scan()), models, DAY)
    return out.groupBy("layer", "action", "degraded").agg(
        F.count(F.lit(1)).alias("n"), F.min("probability").alias("low"),
        F.max("probability").alias("high"))


# A model written by hand, so that its results can be said in SQL. Two trees over three
# features, and a network that looks at two and answers with a multiple of its bottleneck.
_TREES = [(0, 0, "path_len", 8.1, 1, 2, 8), (0, 1, "", 0.0, -1, -1, 5), (0, 2, "q_total_len", 0.9, 3, 4, 3),
          (0, 3, "", 0.0, -1, -1, 2), (0, 4, "", 0.0, -1, -1, 1),
          (1, 0, "win_distinct_paths", 0.1, 1, 2, 8), (1, 1, "", 0.0, -1, -1, 7), (1, 2, "", 0.0, -1, -1, 1)]
_SAMPLE, _GAMMA = 8, 0.5772156649015329
_RANGES = {"if": (-0.15, 0.2), "ae": (1.5, 3.0)}
_LEARNER = meta.Meta(-3.0, {"rate": 1.5, "isolation_forest": 2.5, "autoencoder": 3.0})
_CUT = 0.6


def _hand_written(spark):
    at = {n: i for i, n in enumerate(FEATURE_NAMES)}
    nodes = spark.createDataFrame([(t, k, at[f] if f else -1, x, a, b, n) for t, k, f, x, a, b, n in _TREES], FOREST_NODES)
    width = len(FEATURE_NAMES)
    into = np.zeros((width, 2))
    into[at["path_entropy"], 0], into[at["q_total_len"], 1] = 1.0, 0.5
    back = np.array([[0.1 * (j % 3) for j in range(width)], [9.0] * width])
    network = autoencoder.Network([
        (into, np.array([0.25, -0.5])), (np.array([[1.0], [0.5]]), np.array([0.1])),
        (np.array([[1.0, -1.0]]), np.zeros(2)), (back, np.full(width, 0.05))])
    out = ModelSet({n: (1.0, 2.0) for n in FEATURE_NAMES}, forest.load_forest(nodes, _SAMPLE), network, _LEARNER,
                   bl.empty_baseline(spark), _RANGES, _CUT, FEATURE_NAMES, {})
    out.nodes, out.sample = nodes, _SAMPLE
    return out


def _judged(spark, sf):
    """Event requests with features; every seventh carries a value that is not finite."""
    broken = F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(0.0)
    return featured(spark, sf).withColumns({
        "path_decode_delta": F.col("path_decode_delta") + broken, "window_count": F.col("event_id") % 9,
        "burst_count": F.col("event_id") % 4, "rate_limited": F.col("event_id") % 50 == 0, "rate_reason": F.lit("")})


def _mean_path_sql(n):
    return "0" if n <= 1 else "1" if n == 2 else f"(2 * (ln({n} - 1) + {_GAMMA}) - 2 * ({n} - 1) / {n})"


def _path_sql(tree, node=0, depth=0):
    _, _, feature, x, left, right, size = next(t for t in _TREES if t[:2] == (tree, node))
    if left < 0:
        return f"({depth} + {_mean_path_sql(size)})"
    return (f"CASE WHEN z_{feature} <= {x} THEN {_path_sql(tree, left, depth + 1)} "
            f"ELSE {_path_sql(tree, right, depth + 1)} END")


def _norm_sql(raw, low, high):
    return f"greatest(0, least(1, ({raw} - ({low})) / ({high} - ({low}) + 1e-9)))"


_MODEL_SQL = ["vec AS (SELECT event_id, " + ", ".join(
    f"(CAST(CAST({_FEATURE_SQL[n]} AS DOUBLE) AS FLOAT)::DOUBLE - 1) / 2 AS z_{n}" for n in FEATURE_NAMES)
    + " FROM req JOIN be USING (event_id) JOIN pe USING (event_id) LEFT JOIN base b USING (template))",
    "deep AS (SELECT *, greatest(0, greatest(0, z_path_entropy + 0.25) + 0.5 * greatest(0, 0.5 * z_q_total_len - 0.5) "
    "+ 0.1) AS k FROM vec)",
    f"raw AS (SELECT event_id, pow(2, -({_path_sql(0)} + {_path_sql(1)}) / 2 / {_mean_path_sql(_SAMPLE)}) - 0.5 AS if_raw, ("
    + " + ".join(f"pow(z_{n} - ({0.1 * (j % 3)} * k + 0.05), 2)" for j, n in enumerate(FEATURE_NAMES))
    + f") / {len(FEATURE_NAMES)} AS ae_raw, least(1, greatest(event_id % 9 / {DAY.window_limit}, event_id % 4 / "
    f"{DAY.burst_limit})) AS rate FROM deep)",
    f"part AS (SELECT *, {_norm_sql('if_raw', *_RANGES['if'])} AS s_if, {_norm_sql('ae_raw', *_RANGES['ae'])} AS s_ae FROM raw)",
    "prob AS (SELECT *, 1 / (1 + exp(-(-3.0 + 1.5 * rate + 2.5 * s_if + 3.0 * s_ae))) AS p FROM part)"]
_MODEL = with_(REQUESTS_SQL, _BASE_SQL, _CHARS_SQL.format("b", "body"), _CHARS_SQL.format("p", "path"), *_MODEL_SQL)
# The cascade takes n_flags from the rules' hits; these requests have none.
_FLAG = f"(CAST(CAST({_FEATURE_SQL['n_flags']} AS DOUBLE) AS FLOAT)::DOUBLE - 1) / 2 AS z_n_flags"


@query("model_scores", _MODEL + """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'ValueError' END AS error,
  CASE WHEN event_id % 7 > 0 THEN round(if_raw, 6) END AS if_raw, CASE WHEN event_id % 7 > 0 THEN round(ae_raw, 4) END AS ae_raw,
  CASE WHEN event_id % 7 > 0 THEN round(s_if, 6) END AS s_if, CASE WHEN event_id % 7 > 0 THEN round(s_ae, 4) END AS s_ae,
  round(rate, 6) AS rate, CASE WHEN event_id % 7 > 0 THEN round(p, 4) END AS p FROM prob""")
def model_scores(spark, sf):
    """Path lengths, reconstruction errors, their normal form and the probability."""
    out = score(_judged(spark, sf), _hand_written(spark), DAY)
    # Features are 32-bit numbers, so what adds many of them up is compared to four digits.
    scored_ = F.col("error").isNull()
    return out.select("event_id", "error", r6("rate").alias("rate"), *[F.when(scored_, r6(c, k)).alias(n) for n, c, k in (
        ("if_raw", "if_raw", 6), ("ae_raw", "ae_raw", 4), ("s_if", "isolation_forest", 6), ("s_ae", "autoencoder", 4),
        ("p", "p", 4))])


_MODEL_LAYER = f"""CASE WHEN event_id % 50 = 0 THEN 'L1-rate' WHEN event_id % 7 = 0 THEN 'L-error'
    WHEN p >= {_CUT} THEN 'L4-meta' ELSE '' END"""


def _model_decisions_sql(closed):
    return _MODEL.replace(_FLAG, "-0.5 AS z_n_flags") + f"""
SELECT event_id, layer, CASE WHEN layer IN ('L1-rate', 'L4-meta'{", 'L-error'" if closed else ''}) THEN 'block' ELSE 'allow' END
  AS action, layer = 'L-error' AS degraded, CASE WHEN layer = 'L1-rate' THEN 1 WHEN layer = 'L-error' THEN {int(closed)}
  ELSE round(p, 4) END AS probability FROM (SELECT *, {_MODEL_LAYER} AS layer FROM prob)"""


def _model_decisions(spark, sf, settings):
    out = decide.decide(_judged(spark, sf).withColumn("hits", rules.scan()), _hand_written(spark), settings)
    return out.select("event_id", "layer", "action", "degraded", r6("probability", 4).alias("probability"))


@query("model_decisions", _model_decisions_sql(True))
def model_decisions(spark, sf):
    """All outcomes of the model branch: attack, normal, failed, and settled before it."""
    return _model_decisions(spark, sf, DAY)


@query("model_decisions_open", _model_decisions_sql(False))
def model_decisions_open(spark, sf):
    """The same, failing open."""
    return _model_decisions(spark, sf, DAY.but(fail_closed=False))


@query("fail_closed", """
SELECT 'L-error' AS layer, 'block' AS action, 'inference failure, failing closed: ValueError' AS reason,
  count(*) AS n, true AS degraded, 1.0 AS probability FROM events WHERE event_id % 7 = 0""")
def fail_closed(spark, sf):
    """Every seventh request carries a value that is not finite."""
    df, models = _models(spark, sf)
    broken = F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(0.0)
    df = df.withColumns({
        "path_decode_delta": F.col("path_decode_delta") + broken, "window_count": F.lit(0),
        "burst_count": F.lit(0), "rate_limited": F.lit(False), "rate_reason": F.lit("")})
    out = decide.decide(df.withColumn("hits", rules.scan()), models, DAY)
    return out.filter("layer = 'L-error'").groupBy(
        "layer", "action", "reason", "degraded", "probability").agg(F.count(F.lit(1)).alias("n"))


# ── training ─────────────────────────────────────────────────────────────────

def training_log(spark, sf):
    """Event log with all features and labels, for the training plans."""
    df = featured(spark, sf).join(event_log(spark, sf).select(
        "event_id", "label", "rule_hits", "layer", "window_count", "burst_count"), "event_id")
    # A log is stored; without the cut every feature would be derived per use.
    return cut(df.select("client", "template", "body_size", "label", "rule_hits", "layer",
                         "window_count", "burst_count",
                         scalars.feature_map(FEATURE_NAMES).alias("features")))


@query("train_report")
def train_report(spark, sf):
    report = train.train(training_log(spark, sf), DAY)
    families = report.frames["families"]
    return families.select("family", "ml_n", r6("ml_recall").alias("ml_recall"), "l1_caught",
                           r6("pipeline_recall").alias("pipeline_recall"), "novel",
                           F.lit(report.decision["threshold"]).alias("threshold"))


@query("compare_detectors")
def compare_detectors(spark, sf):
    table, _ = train.compare(train.fit(training_log(spark, sf), DAY), DAY)
    return table




@query("seed_failures")
def seed_failures(spark, sf):
    """Training repeated with two seeds; a pool that is too small is a row, not a gap."""
    runs = train.seed_runs(training_log(spark, sf), (1, 2), DAY.but(forest_trees=20, forest_samples=256, ae_epochs=5))
    return runs.select("seed", F.col("failure").isNotNull().alias("failed"), r6("f1").alias("f1"), r6("roc_auc").alias("roc_auc"))
