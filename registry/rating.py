"""Request rates, baselines and calibration."""
from __future__ import annotations

from pyspark.sql import functions as F

from registry import query
from registry.inputs import (DAY, LABELLED_SQL, LOG_SQL, REQUESTS_SQL, event_log, labelled, r6,
                             requests, with_)
from reqlens.config import DEFAULTS
from reqlens.functions import scalars
from reqlens.operators import baseline as bl
from reqlens.operators import eventlog, rates

REQ = with_(REQUESTS_SQL)


def _span_sql(micros: int) -> str:
    """Half-open sliding count; peers of the same instant that arrive later are
    taken out again."""
    return (f"count(*) OVER (PARTITION BY client ORDER BY us RANGE BETWEEN {micros - 1} PRECEDING "
            "AND CURRENT ROW) - (count(*) OVER (PARTITION BY client, us) - row_number() OVER "
            "(PARTITION BY client, us ORDER BY event_id))")


_WINDOW, _BURST = _span_sql(86_400_000_000), _span_sql(21_600_000_000)
_SESSION_SQL = """s0 AS (SELECT *, us - lag(us) OVER (PARTITION BY client ORDER BY us, event_id)
    AS gap FROM req),
  s1 AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 43200000000 THEN 1 ELSE 0 END) OVER (
    PARTITION BY client ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM s0),
  s2 AS (SELECT *, row_number() OVER (PARTITION BY client, sid, template ORDER BY us, event_id)
    AS k, min(us) OVER (PARTITION BY client, sid) AS start_us FROM s1),
  ses AS (SELECT event_id, start_us, sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) OVER (
    PARTITION BY client, sid ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS window_distinct
    FROM s2)"""
_COUNTS_SQL = (f"cnt AS (SELECT event_id, client, us, {_WINDOW} AS window_count, {_BURST} AS "
               "burst_count FROM req)")


@query("window_counts", REQ + f"SELECT event_id, {_WINDOW} AS window_count FROM req")
def window_counts(spark, sf):
    return rates.sliding_counts(requests(spark, sf), DAY).select("event_id", "window_count")


@query("burst_counts", REQ + f"SELECT event_id, {_BURST} AS burst_count FROM req")
def burst_counts(spark, sf):
    return rates.sliding_counts(requests(spark, sf), DAY).select("event_id", "burst_count")


# Half of all requests on one client and instants shared by many: the same
# query where keys are hot.
_HOT_SQL = """hot AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'hot' ELSE client END AS client,
    us // 3600000000 * 3600000000 AS us FROM req)"""


@query("window_counts_hot", with_(REQUESTS_SQL, _HOT_SQL) + f"""
SELECT event_id, {_WINDOW} AS window_count, {_BURST} AS burst_count FROM hot""")
def window_counts_hot(spark, sf):
    df = requests(spark, sf).withColumns({
        "client": F.when(F.col("event_id") % 2 == 0, "hot").otherwise(F.col("client")),
        "ts": F.date_trunc("hour", "ts")})
    return rates.sliding_counts(df, DAY).select("event_id", "window_count", "burst_count")


@query("session_distinct", with_(REQUESTS_SQL, _SESSION_SQL) + "SELECT * FROM ses")
def session_distinct(spark, sf):
    return rates.session_distinct(requests(spark, sf), DAY).select(
        "event_id", F.unix_micros("session_start").alias("start_us"), "window_distinct")


_VERDICT_SQL = """CASE WHEN burst_count > 4 THEN 'burst limit exceeded: ' || burst_count ||
    ' requests in 21600s (limit 4)' WHEN window_count > 8 THEN 'rate limit exceeded: ' ||
    window_count || ' requests in 86400s (limit 8)' ELSE '' END"""


@query("rate_verdict", with_(REQUESTS_SQL, _COUNTS_SQL) + f"""
SELECT event_id, (burst_count > 4 OR window_count > 8) AS rate_limited,
  {_VERDICT_SQL} AS rate_reason FROM cnt""")
def rate_verdict(spark, sf):
    counted = rates.sliding_counts(requests(spark, sf), DAY)
    return rates.with_verdict(counted, DAY).select("event_id", "rate_limited", "rate_reason")


@query("rate_state", with_(REQUESTS_SQL, _COUNTS_SQL, _SESSION_SQL) + f"""
SELECT event_id, window_count, burst_count, window_distinct,
  (burst_count > 4 OR window_count > 8) AS rate_limited FROM cnt JOIN ses USING (event_id)""")
def rate_state(spark, sf):
    return rates.rate_state(requests(spark, sf), DAY).select(
        "event_id", "window_count", "burst_count", "window_distinct", "rate_limited")


@query("rate_score", with_(LOG_SQL) + """
SELECT event_id, round(least(1, greatest(coalesce(window_count, 0) / 8, burst_count / 4)), 6)
  AS rate FROM log""")
def rate_score(spark, sf):
    return event_log(spark, sf).select(
        "event_id", r6(scalars.rate_score("window_count", "burst_count", DAY)).alias("rate"))


@query("policy_breaches", with_(REQUESTS_SQL, _COUNTS_SQL) + """
SELECT client, count(*) AS requests, count(*) FILTER (burst_count > 4) AS burst_blocks,
  count(*) FILTER (burst_count <= 4 AND window_count > 8) AS window_blocks
FROM cnt GROUP BY client HAVING count(*) FILTER (burst_count > 4 OR window_count > 8) > 0""")
def policy_breaches(spark, sf):
    """Which clients break the rate policy, and by which limit?"""
    rated = rates.with_verdict(rates.sliding_counts(requests(spark, sf), DAY), DAY)
    burst = F.col("burst_count") > DAY.burst_limit
    return rated.groupBy("client").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(burst).alias("burst_blocks"),
        F.count_if(F.col("rate_limited") & ~burst).alias("window_blocks"),
        F.count_if("rate_limited").alias("_all")).filter("_all > 0").drop("_all")


# ── baselines ────────────────────────────────────────────────────────────────

_ENDPOINTS_SQL = """(SELECT template, avg(body_size) AS body_mean, stddev_pop(body_size) AS body_std,
  count(*) AS n FROM {0} WHERE {1} GROUP BY template HAVING count(*) >= 5)"""
_NEW, _OLD = (_ENDPOINTS_SQL.format("lab", c) for c in
              ("y = 0 AND event_id % 2 = 0 AND template <> '/api/view/{id}'",
               "event_id % 2 = 1 AND template <> '/api/click/{id}'"))
LAB = with_(LABELLED_SQL, f"newb AS {_NEW}", f"oldb AS {_OLD}")


def _sides(spark, sf):
    df = labelled(spark, sf)
    new = df.filter("y = 0 AND event_id % 2 = 0 AND template <> '/api/view/{id}'")
    old = df.filter("event_id % 2 = 1 AND template <> '/api/click/{id}'")
    return df, old, new


@query("endpoint_baseline", LAB + """
SELECT template, round(body_mean, 6) AS body_mean, round(body_std, 6) AS body_std, n AS count
FROM newb""")
def endpoint_baseline(spark, sf):
    new = bl.endpoint_baseline(_sides(spark, sf)[2])
    return new.withColumns({c: r6(c) for c in ("body_mean", "body_std")})


@query("rate_baseline", LAB + """
SELECT round(avg(win), 6) AS mean, round(stddev_pop(win), 6) AS std, count(*) AS n_samples
FROM lab WHERE y = 0""")
def rate_baseline(spark, sf):
    return bl.rate_baseline(labelled(spark, sf).filter("y = 0")).withColumns(
        {c: r6(c) for c in ("mean", "std")})


_STAT = ("(SELECT avg(win) FROM lab WHERE y = 0 AND event_id % 2 = 0 AND template <> "
         "'/api/view/{id}')")
_SPREAD = _STAT.replace("avg", "stddev_pop")


@query("baseline_join", LAB + f"""
SELECT event_id, round(CASE WHEN b.body_std > 1e-9 THEN greatest(-10, least(10,
    (body_size - b.body_mean) / b.body_std)) ELSE 0 END, 6) AS body_size_z,
  CASE WHEN b.template IS NULL THEN 0 ELSE 1 END AS path_known,
  round(greatest(-10, least(10, (win - {_STAT}) / {_SPREAD})), 6) AS rate_z
FROM lab LEFT JOIN newb b USING (template)""")
def baseline_join(spark, sf):
    df, _, new = _sides(spark, sf)
    out = bl.apply_baseline(df, bl.build_baseline(new))
    return out.select("event_id", r6("body_size_z").alias("body_size_z"), "path_known",
                      r6("rate_z").alias("rate_z"))


@query("novel_endpoints", LAB + """
SELECT event_id, template FROM lab WHERE template NOT IN (SELECT template FROM newb)""")
def novel_endpoints(spark, sf):
    df, _, new = _sides(spark, sf)
    return bl.novel_endpoints(df, bl.endpoint_baseline(new)).select("event_id", "template")


@query("shared_endpoints", LAB + "SELECT template FROM oldb INTERSECT SELECT template FROM newb")
def shared_endpoints(spark, sf):
    _, old, new = _sides(spark, sf)
    return bl.shared_endpoints(bl.endpoint_baseline(old), bl.endpoint_baseline(new))


@query("new_endpoints", LAB + "SELECT template FROM newb EXCEPT SELECT template FROM oldb")
def new_endpoints(spark, sf):
    _, old, new = _sides(spark, sf)
    return bl.new_endpoints(bl.endpoint_baseline(old), bl.endpoint_baseline(new))


@query("contamination", with_(LOG_SQL) + """
SELECT count(*) FILTER (hit_block) AS blocked, count(*) FILTER (hit_block OR hit_flag) AS flagged,
  count(*) AS n, round(count(*) FILTER (hit_block) / count(*), 6) AS fraction
FROM log WHERE has_features""")
def contamination(spark, sf):
    window = eventlog.require_features(event_log(spark, sf))
    return bl.contamination(window).withColumn("fraction", r6("fraction"))


@query("rate_drift", LAB + """
SELECT round(n.m, 6) AS new_mean, round(o.m, 6) AS old_mean, round(o.s, 6) AS old_std,
  round(abs(n.m - o.m) / (o.s + 1e-9), 6) AS drift, abs(n.m - o.m) / (o.s + 1e-9) > 3 AS large
FROM (SELECT avg(win) AS m, stddev_pop(win) AS s FROM lab WHERE event_id % 2 = 1
    AND template <> '/api/click/{id}') o,
  (SELECT avg(win) AS m FROM lab WHERE y = 0 AND event_id % 2 = 0
    AND template <> '/api/view/{id}') n""")
def rate_drift(spark, sf):
    _, old, new = _sides(spark, sf)
    out = bl.rate_drift(bl.rate_baseline(old), bl.rate_baseline(new))
    return out.withColumns({c: r6(c) for c in ("new_mean", "old_mean", "old_std", "drift")})


@query("calibration_gates", with_(LOG_SQL) + """,
  f AS (SELECT count(*) AS n, count(*) FILTER (hit_block) / count(*) AS fraction,
    greatest(0.05, least(0.999, quantile_cont(m_lr, 0.99))) AS t, quantile_cont(m_lr, 0.5) AS m
    FROM log)
SELECT * FROM (
  SELECT 'samples' AS gate, round(n, 6) AS value, 2000.0 AS threshold, n >= 2000 AS passed FROM f
  UNION ALL SELECT 'contamination', round(fraction, 6), 0.02, fraction <= 0.02 FROM f
  UNION ALL SELECT 'threshold_floor', round(t, 6), 0.2, t >= 0.2 FROM f
  UNION ALL SELECT 'median', round(m, 6), 0.5, m < 0.5 FROM f
  UNION ALL SELECT 'threshold_jump', round(t, 6), 0.8, t <= 0.8 FROM f)""")
def calibration_gates(spark, sf):
    from reqlens.operators import metrics
    df = event_log(spark, sf)
    dirt = bl.contamination(df)
    picked = metrics.calibrated_threshold(df, 0.01, "probability")
    middle = metrics.score_distribution(df, "probability")
    facts = dirt.select(
        "n", "fraction", picked.select("threshold").scalar().alias("threshold"),
        middle.select("p50").scalar().alias("median"), F.lit(0.5).alias("previous"))
    out = bl.calibration_gates(facts, DEFAULTS)
    return out.withColumns({c: r6(c) for c in ("value", "threshold")})
