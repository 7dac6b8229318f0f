"""Event-log selections and traffic summaries."""
from __future__ import annotations

from pyspark.sql import functions as F

from registry import query
from registry.inputs import LABELLED_SQL, LOG_SQL, event_log, labelled, r6, table, with_
from reqlens.config import DEFAULTS
from reqlens.functions import rules, scalars
from reqlens.operators import eventlog, traffic
from reqlens.operators import requests as shaping
from reqlens.sources.artefacts import decision_frame

LOG = with_(LOG_SQL)


def _epoch(spark, sf):
    return table(spark, sf, "events").agg(
        F.max(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")).first().t


@query("log_since", LOG + """
SELECT event_id FROM log WHERE ts >= (SELECT max(us) / 1e6 FROM log) - 1440 * 60""")
def log_since(spark, sf):
    return eventlog.since(event_log(spark, sf), _epoch(spark, sf), 1440).select("event_id")


@query("log_require_features", LOG + "SELECT event_id FROM log WHERE has_features")
def log_require_features(spark, sf):
    return eventlog.require_features(event_log(spark, sf)).select("event_id")


@query("log_tail", LOG + """
SELECT event_id, template FROM log ORDER BY ts DESC, event_id DESC LIMIT 500""")
def log_tail(spark, sf):
    return eventlog.tail(event_log(spark, sf), 500).select("event_id", "template")


@query("parse_label", LOG + """
SELECT event_id, CASE WHEN label LIKE 'attack%' THEN 1 WHEN label LIKE 'normal%' THEN 0 END AS y,
  CASE WHEN label LIKE 'attack%' THEN CASE WHEN contains(label, ':')
    THEN substr(label, instr(label, ':') + 1) ELSE 'unknown' END END AS family FROM log""")
def parse_label(spark, sf):
    return eventlog.with_label(event_log(spark, sf)).select("event_id", "y", "family")


@query("gate_label", LOG + """
SELECT event_id, label AS lab, CAST(NULL AS STRING) AS production FROM log""")
def gate_label(spark, sf):
    df = event_log(spark, sf).withColumn("lab0", F.col("label"))
    lab = shaping.gate_label(df, DEFAULTS.but(trust_label=True)).withColumnRenamed("label", "lab")
    return shaping.gate_label(lab.withColumn("label", F.col("lab0"))).select(
        "event_id", "lab", F.col("label").alias("production"))


@query("l1_settled", LOG + """
SELECT event_id, (hit_block OR layer = 'L1-rate') AS settled FROM log""")
def l1_settled(spark, sf):
    df = event_log(spark, sf).withColumn("layer", F.nullif("layer", F.lit("")))
    return df.select("event_id", eventlog.l1_settled().alias("settled"))


@query("rule_severity_lookup", LOG + """
SELECT id, severity, count(*) AS n FROM (
  SELECT unnest([CASE WHEN hit_block THEN 'sqli.union' END, CASE WHEN hit_xss THEN
    'xss.script_tag' END, CASE WHEN hit_flag THEN 'sqli.comment_terminator' END]) AS id FROM log)
  JOIN (VALUES ('sqli.union', 'block'), ('xss.script_tag', 'block'),
    ('sqli.comment_terminator', 'flag')) r(id, severity) USING (id) GROUP BY id, severity""")
def rule_severity_lookup(spark, sf):
    """Hit ids to severity; counted first, so the join sees one row per id."""
    counts = event_log(spark, sf).select(F.explode("rule_hits").alias("id")).groupBy("id").agg(
        F.count(F.lit(1)).alias("n"))
    return counts.join(rules.rules_table(spark), "id").select("id", "severity", "n")


@query("labelled_rows", with_(LABELLED_SQL) + """
SELECT event_id, y, family, l1, by_rule, round(win, 6) AS win FROM lab""")
def labelled_rows(spark, sf):
    return labelled(spark, sf).select("event_id", "y", "family", "l1", "by_rule", r6("win").alias("win"))


@query("training_pools", with_(LABELLED_SQL) + """
SELECT event_id, pool FROM (SELECT *, CASE WHEN h < 45 THEN 'base' WHEN h < 70 THEN 'meta'
    WHEN h < 85 THEN 'val' ELSE 'test' END AS pool
  FROM (SELECT *, CAST(concat('0x', substr(sha256(client || '|42'), 1, 8)) AS UBIGINT) % 100 AS h
    FROM lab WHERE NOT l1))
WHERE CASE pool WHEN 'base' THEN y = 0 WHEN 'test' THEN true
  ELSE coalesce(family, '') NOT IN ('cmdi', 'exfil', 'ssti') END""")
def training_pools(spark, sf):
    rows = eventlog.with_pool(labelled(spark, sf), 42)
    return eventlog.training_pool(rows).select("event_id", "pool")


@query("clean_rows", LOG + "SELECT event_id FROM log WHERE NOT hit_block")
def clean_rows(spark, sf):
    return eventlog.clean_rows(event_log(spark, sf)).select("event_id")


@query("flatten_scores", LOG + """
SELECT event_id, CASE WHEN modelled THEN round(s_rate, 6) END AS rate,
  CASE WHEN modelled THEN round(s_if, 6) END AS isolation_forest,
  CASE WHEN modelled THEN round(s_ae, 6) END AS autoencoder,
  CASE WHEN modelled THEN m_lr END AS meta_lr FROM log""")
def flatten_scores(spark, sf):
    df = eventlog.flatten_scores(event_log(spark, sf))
    return df.select("event_id", *[r6(c).alias(c) for c in (
        "rate", "isolation_forest", "autoencoder", "meta_lr")])


@query("blocked_only", LOG + "SELECT event_id, layer FROM log WHERE action = 'block'")
def blocked_only(spark, sf):
    return eventlog.blocked_only(event_log(spark, sf)).select("event_id", "layer")


@query("ml_decided", LOG + "SELECT event_id FROM log WHERE layer IN ('L4-meta', '')")
def ml_decided(spark, sf):
    return eventlog.ml_decided(eventlog.flatten_scores(event_log(spark, sf))).select("event_id")


_LABEL_SQL = """CASE layer WHEN 'L1-rules' THEN 'L1 · signature rule'
  WHEN 'L1-rate' THEN 'L1 · rate limit' WHEN 'L4-meta' THEN 'L4 · meta-learner (ensemble)'
  WHEN 'L-error' THEN 'fail-closed (inference error)'
  WHEN 'L1-only' THEN 'L1 only (models not loaded)' ELSE 'allowed' END"""


@query("decided_by", LOG + f"SELECT event_id, {_LABEL_SQL} AS decided_by FROM log")
def decided_by(spark, sf):
    df = event_log(spark, sf).withColumn("layer", F.nullif("layer", F.lit("")))
    return df.select("event_id", eventlog.decided_by().alias("decided_by"))


@query("recent_events", LOG + f"""
SELECT CAST(epoch_us(make_timestamp(CAST(round(ts * 1000) AS BIGINT) * 1000)) AS BIGINT) AS us,
  method, template, status, action, {_LABEL_SQL} AS "decided by",
  CASE WHEN modelled THEN m_lr END AS "DECISION (L4)",
  CASE WHEN modelled THEN round(s_if, 6) END AS "evidence: iforest",
  latency_ms, client AS "client (hashed)"
FROM log ORDER BY ts DESC, event_id DESC LIMIT 400""")
def recent_events(spark, sf):
    out = eventlog.recent_events(eventlog.for_display(event_log(spark, sf)))
    return out.select(F.unix_micros("time").alias("us"), "method", "template", "status", "action",
                      "decided by", "DECISION (L4)",
                      r6(F.col("`evidence: iforest`")).alias("evidence: iforest"), "latency_ms",
                      "client (hashed)")


@query("epoch_time", LOG + """
SELECT event_id, CAST(round(ts * 1000) AS BIGINT) * 1000 AS us FROM log""")
def epoch_time(spark, sf):
    return event_log(spark, sf).select("event_id", F.unix_micros(scalars.to_time("ts")).alias("us"))


@query("log_rounding", LOG + """
SELECT event_id, ts, round(latency_ms / 7, 3) AS latency_ms, round(m_lr / 3, 4) AS probability,
  substr('event ' || event_id || repeat('x', 250), 1, 200) AS reason FROM log""")
def log_rounding(spark, sf):
    df = event_log(spark, sf)
    return df.select("event_id", "ts", F.bround(F.col("latency_ms") / 7, 3).alias("latency_ms"),
                     F.bround(F.col("probability") / 3, 4).alias("probability"),
                     F.substring(F.concat("reason", F.lit("x" * 250)), 1, 200).alias("reason"))


# ── summaries ────────────────────────────────────────────────────────────────

@query("traffic_stats", LOG + """
SELECT 'layer' AS kind, layer AS name, count(*) AS n FROM log WHERE enforced GROUP BY layer
UNION ALL SELECT 'stat', 'total', count(*) FROM log
UNION ALL SELECT 'stat', 'allowed', count(*) FROM log WHERE NOT enforced
UNION ALL SELECT 'stat', 'blocked', count(*) FROM log WHERE enforced""")
def traffic_stats(spark, sf):
    return traffic.traffic_stats(event_log(spark, sf))


@query("headline", LOG + """
SELECT count(*) AS requests, count(*) FILTER (action = 'block') AS flagged,
  count(*) FILTER (enforced) AS enforced, count(*) FILTER (degraded) AS degraded,
  round(100 * count(*) FILTER (action = 'block') / count(*), 6) AS flagged_pct,
  count(*) FILTER (NOT enforced) AS allowed FROM log""")
def headline(spark, sf):
    out = traffic.headline(event_log(spark, sf))
    return out.withColumn("flagged_pct", r6("flagged_pct"))


@query("blocks_by_layer", LOG + f"""
SELECT {_LABEL_SQL} AS decided_by, count(*) AS n FROM log WHERE action = 'block' GROUP BY 1""")
def blocks_by_layer(spark, sf):
    return traffic.blocks_by_layer(event_log(spark, sf))


@query("category_counts", LOG + """
SELECT category, count(*) AS n FROM (SELECT unnest([CASE WHEN hit_block OR hit_flag THEN 'sqli' END,
  CASE WHEN hit_xss THEN 'xss' END, CASE WHEN layer = 'L1-rate' THEN 'rate' END]) AS category
  FROM log) WHERE category IS NOT NULL GROUP BY category""")
def category_counts(spark, sf):
    return traffic.category_counts(event_log(spark, sf))


@query("mean_evidence", LOG + """
SELECT round(avg(s_rate), 6) AS rate, round(avg(s_if), 6) AS isolation_forest,
  round(avg(s_ae), 6) AS autoencoder FROM log WHERE modelled""")
def mean_evidence(spark, sf):
    out = traffic.mean_evidence(event_log(spark, sf))
    return out.select(*[r6(c).alias(c) for c in out.columns])


def _latency_sql(column: str) -> str:
    return (f"SELECT '{column}' AS \"column\", count({column}) AS count, round(avg({column}), 6) AS mean, "
            f"round(stddev_samp({column}), 6) AS std, min({column}) AS min, max({column}) AS max, "
            + ", ".join(f"round(quantile_cont({column}, {p}), 6) AS {n}"
                        for n, p in (("p50", .5), ("p95", .95), ("p99", .99))) + " FROM log")


@query("latency_summary", LOG + _latency_sql("detect_ms") + " UNION ALL " + _latency_sql("latency_ms"))
def latency_summary(spark, sf):
    out = traffic.latency_summary(event_log(spark, sf))
    return out.withColumns({c: r6(c) for c in ("mean", "std", "p50", "p95", "p99")})


@query("latency_sketch")
def latency_sketch(spark, sf):
    return traffic.latency_sketch(event_log(spark, sf))


@query("traffic_series", LOG + """,
  span AS (SELECT min(us) // 300000000 AS a, max(us) // 300000000 AS b FROM log)
SELECT t.k * 300 AS bin, count(*) FILTER (action = 'allow') AS allowed,
  count(*) FILTER (action = 'block') AS blocked
FROM (SELECT unnest(range(a, b + 1)) AS k FROM span) t
  LEFT JOIN log ON log.us // 300000000 = t.k GROUP BY t.k""".replace(
    "\n,\n", ",\n"))
def traffic_series(spark, sf):
    """Five-minute bins here: events are sparse. By the events' own times: the log's
    milliseconds would put those at the end of a bin into the next."""
    out = traffic.traffic_series(event_log(spark, sf, "time"), seconds=300)
    return out.withColumn("bin", F.unix_seconds("bin"))


@query("clean_load_fpr", LOG + """
SELECT st AS status, count(*) AS n, round((SELECT count(*) FILTER (y0.enforced) / count(*)
  FROM log y0 WHERE label = 'normal'), 6) AS fpr
FROM (SELECT CASE WHEN enforced THEN 403 ELSE status END AS st FROM log WHERE label = 'normal')
GROUP BY st""")
def clean_load_fpr(spark, sf):
    return traffic.clean_load_fpr(_load(spark, sf).filter("label = 'normal'")).withColumn(
        "fpr", r6("fpr"))


def _load(spark, sf):
    """The log as results of a test load."""
    df = event_log(spark, sf)
    return df.withColumns({
        "status": F.when(F.col("enforced"), 403).otherwise(F.col("status")),
        "kind": F.substring_index("label", ":", 1),
        "category": F.coalesce(F.split_part("label", F.lit(":"), F.lit(2)), F.lit("")),
        "error": F.col("event_id") % 97 == 0, "ts": F.timestamp_millis(
            F.round(F.col("ts") * 1000).cast("bigint"))}).filter("label IS NOT NULL")


@query("detection_by_category", LOG + """
SELECT split_part(label, ':', 2) AS category, count(*) AS total,
  count(*) FILTER (enforced) AS blocked, round(count(*) FILTER (enforced) / count(*), 6) AS rate
FROM log WHERE label LIKE 'attack%' GROUP BY 1""")
def detection_by_category(spark, sf):
    return traffic.detection_by_category(_load(spark, sf)).withColumn("rate", r6("rate"))


@query("load_verdicts", LOG + """
SELECT CASE WHEN event_id % 97 = 0 THEN 'ERROR' WHEN label = 'normal' AND enforced THEN 'FALSE POS'
  WHEN label = 'normal' THEN 'OK' WHEN enforced THEN 'BLOCKED' ELSE 'MISSED' END AS verdict,
  count(*) AS n FROM log WHERE label IS NOT NULL GROUP BY 1""")
def load_verdicts(spark, sf):
    return traffic.with_verdict(_load(spark, sf)).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("load_summary", LOG + """
SELECT count(*) AS n, count(DISTINCT client) AS clients, round(avg(latency_ms), 6) AS mean_ms,
  count(*) FILTER (event_id % 97 = 0) AS errors,
  round(count(*) / (max(ts) - min(ts)), 6) AS per_second FROM log WHERE label IS NOT NULL""")
def load_summary(spark, sf):
    return traffic.load_summary(_load(spark, sf)).withColumns(
        {c: r6(c) for c in ("mean_ms", "per_second")})


@query("load_counts", LOG + """
SELECT name, count(*) AS n FROM (SELECT unnest([split_part(label, ':', 1),
  'http_' || CASE WHEN enforced THEN 403 ELSE status END]) AS name FROM log
  WHERE label IS NOT NULL) GROUP BY name""")
def load_counts(spark, sf):
    return traffic.load_counts(_load(spark, sf))


@query("model_summary", LOG + """
SELECT 'now' AS trained_at, 0.6 AS threshold, 34 AS n_features,
  round(2 * tp / (2 * tp + fp + fn), 6) AS test_f1, round(tp / (tp + fn), 6) AS test_recall,
  round(fp / (fp + tn), 6) AS test_fpr, CAST(NULL AS DOUBLE) AS zero_day_recall
FROM (SELECT count(*) FILTER (a AND b) AS tp, count(*) FILTER (NOT a AND b) AS fp,
  count(*) FILTER (a AND NOT b) AS fn, count(*) FILTER (NOT a AND NOT b) AS tn
  FROM (SELECT label LIKE 'attack%' AS a, m_lr >= 0.6 AS b FROM log WHERE label IS NOT NULL))""")
def model_summary(spark, sf):
    from reqlens.operators import metrics
    from reqlens.schemas import FEATURE_NAMES
    rows = eventlog.with_label(event_log(spark, sf)).filter("y IS NOT NULL").withColumn(
        "pred", (F.col("probability") >= 0.6).cast("int"))
    quality = metrics.metrics(rows).first().asDict()
    decision = decision_frame(spark, {
        "trained_at": "now", "threshold": 0.6, "feature_names": FEATURE_NAMES,
        "test_metrics": {k: float(v) for k, v in quality.items()}})
    return traffic.model_summary(decision).withColumns(
        {c: r6(c) for c in ("test_f1", "test_recall", "test_fpr")})
