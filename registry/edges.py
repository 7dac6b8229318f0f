"""Rows that the plain fixtures lack: missing and non-finite values, multi-byte and long
texts, deep encodings, unknown columns; and the whole batch path over them."""
from __future__ import annotations

from pyspark.sql import functions as F

from registry import query
from registry.evaluation import _METRIC_SQL, _confusion_sql, _rounded
from registry.inputs import (DAY, LOG_SQL, PAGES_SQL, REQUESTS_SQL, SCORED_SQL, event_log, page_requests, r6,
                             requests, scored, table, with_)
from registry.rating import _COUNTS_SQL, _SESSION_SQL
from registry.shapes import _RULES_SQL, _hit_sql
from reqlens.config import DEFAULTS
from reqlens.functions import rules, text
from reqlens.operators import decide, metrics, traffic
from reqlens.operators import requests as shaping
from reqlens.plans import scoring

# ── missing scores ───────────────────────────────────────────────────────────

_GAPS = "CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN 'NaN'::DOUBLE ELSE score END"
_GAPPED_SQL = (f"gap AS (SELECT doc_id, y, {_GAPS} AS raw, CASE WHEN doc_id % 7 > 1 THEN score END AS score,"
               " coalesce(doc_id % 7 > 1 AND score >= 0.05, false) AS hit FROM sc)")


def _gapped(spark, sf):
    part = F.col("doc_id") % 7
    score = F.when(part == 1, float("nan")).when(part > 1, F.col("score"))
    return scored(spark, sf).select("doc_id", "y", score.alias("score"))


@query("unscored_rows", with_(SCORED_SQL, _GAPPED_SQL) + f"""
SELECT n, unscored, {_METRIC_SQL} FROM (SELECT count(*) AS n,
  count(*) FILTER (score IS NULL) AS unscored, {_confusion_sql('hit')} FROM gap)""")
def unscored_rows(spark, sf):
    """A row without a usable score is one that was not flagged, and is counted."""
    df = _gapped(spark, sf)
    flagged = df.withColumn("pred", F.when(metrics.scored("score").isNotNull(), (F.col("score") >= 0.05).cast("int")))
    return metrics.unscored(df).join(_rounded(metrics.metrics(flagged)))


@query("unscored_threshold", with_(SCORED_SQL, _GAPPED_SQL) + f""",
  grid AS (SELECT i, 0.02::DOUBLE + i * ((0.02::DOUBLE + 0.005::DOUBLE) - 0.02::DOUBLE) AS t FROM range(194) r(i))
SELECT i, {_METRIC_SQL} FROM (SELECT i, {_confusion_sql('coalesce(score >= t, false)')}
  FROM grid, gap GROUP BY i)""")
def unscored_threshold(spark, sf):
    out = metrics.threshold_sweep(_gapped(spark, sf)).drop("threshold")
    return _rounded(out.withColumn("i", F.col("i").cast("bigint")))


@query("unscored_ranking", with_(SCORED_SQL, _GAPPED_SQL) + """,
  g AS (SELECT coalesce(score, -1) AS s, sum(y) AS p, count(*) - sum(y) AS q FROM gap GROUP BY 1),
  k AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp FROM g WINDOW w AS (ORDER BY s DESC
    ROWS UNBOUNDED PRECEDING))
SELECT round(sum(q * (tp - p / 2)) / (sum(p) * sum(q)), 6) AS roc_auc,
  round(sum(p * tp / (tp + fp)) / sum(p), 6) AS pr_auc FROM k""")
def unscored_ranking(spark, sf):
    """Unscored rows rank below every score."""
    return _rounded(metrics.ranking_metrics(_gapped(spark, sf)), ["roc_auc", "pr_auc"])


@query("nan_latency", with_(LOG_SQL) + """, v AS (SELECT 'latency_ms' AS "column",
    CASE WHEN event_id % 11 > 1 THEN latency_ms END AS x FROM log
  UNION ALL SELECT 'detect_ms', CASE WHEN event_id % 5 > 0 THEN detect_ms END FROM log)
SELECT "column", count(x) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min,
  max(x) AS max, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.95), 6) AS p95,
  round(quantile_cont(x, 0.99), 6) AS p99 FROM v GROUP BY 1""")
def nan_latency(spark, sf):
    """NaN and NULL latencies are left out of every statistic."""
    part = F.col("event_id") % 11
    df = event_log(spark, sf).withColumns({
        "latency_ms": F.when(part == 0, float("nan")).when(part > 1, F.col("latency_ms")),
        "detect_ms": F.when(F.col("event_id") % 5 == 0, float("nan")).otherwise(F.col("detect_ms"))})
    return _rounded(traffic.latency_summary(df), ["mean", "std", "p50", "p95", "p99"])


# ── sizes, layers, columns ───────────────────────────────────────────────────

@query("multibyte_oversize", """
SELECT doc_id, strlen(text)::BIGINT AS body_size, CASE WHEN strlen(text) > 3000 THEN 413 ELSE 200 END AS status
FROM documents""")
def multibyte_oversize(spark, sf):
    """Bodies without a logged size are measured in bytes."""
    df = table(spark, sf, "documents").select("doc_id", F.col("text").alias("body"), F.lit(200).alias("status"))
    accepted, refused = shaping.split_oversize(shaping.to_request(df), DEFAULTS.but(max_body_bytes=3_000))
    return accepted.unionByName(refused).select("doc_id", "body_size", "status")


@query("null_layer", with_(LOG_SQL) + """
SELECT event_id, action = 'block' AND coalesce(lay, '') NOT IN ('L4-meta', 'L-error') AS enforced,
  CASE WHEN action = 'block' AND lay IN ('L4-meta', 'L-error') THEN lay END AS would_block
FROM (SELECT event_id, action, CASE WHEN event_id % 3 = 0 THEN NULL ELSE layer END AS lay FROM log)""")
def null_layer(spark, sf):
    df = event_log(spark, sf).withColumn("layer", F.when(F.col("event_id") % 3 > 0, F.col("layer")))
    df = df.select("event_id", "action", "layer").withColumn("enforced", decide.enforced(DEFAULTS))
    return df.select("event_id", "enforced", decide.would_block().alias("would_block"))


@query("private_columns", with_(REQUESTS_SQL) + """
SELECT event_id, method, status, substr(sha256(client), 1, 16) AS client FROM req""")
def private_columns(spark, sf):
    """Columns that nobody listed don't pass, whatever they hold."""
    df = requests(spark, sf).select("event_id", "client", "method", "status", F.col("path").alias("html"),
                                    F.col("body").alias("cookie"), F.col("query").alias("note"))
    return shaping.privacy_projection(df)


# ── attacks behind padding and encodings ─────────────────────────────────────

@query("padded_attack", """
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'xss.script_tag' ELSE '' END AS ids FROM pages""")
def padded_attack(spark, sf):
    """A signature after 70,000 harmless bytes."""
    tail = F.when(F.col("page_id") % 4 == 0, "<script>alert(1)</script>").otherwise("the end")
    df = table(spark, sf, "pages").select("page_id", F.lit("/").alias("path"), F.lit("").alias("query"),
                                          F.concat(F.lit("ab " * 23_400), tail).alias("body"))
    return scoring.shape(df, measured=False).select("page_id", F.array_join(rules.hit_ids(), ",").alias("ids"))


@query("deep_encoding", """
SELECT event_id, 'a <script>alert(' || event_id || ')</script>' AS decoded, 'xss.script_tag' AS ids FROM events""")
def deep_encoding(spark, sf):
    """The same, encoded from five to twelve times over."""
    depth = (F.col("event_id") % 8 + 5).cast("int")
    mark = F.concat(F.lit("%"), F.repeat(F.lit("25"), depth - 1))
    raw = F.concat(F.lit("a+"), mark, F.lit("3Cscript"), mark, F.lit("3Ealert("), F.col("event_id").cast("string"),
                   F.lit(")"), mark, F.lit("3C/script"), mark, F.lit("3E"))
    df = table(spark, sf, "events").select("event_id", F.lit("/").alias("path"), F.lit("").alias("query"),
                                           raw.alias("body"))
    shaped = scoring.shape(df.withColumn("decoded", text.url_decode_loop("body")), measured=False)
    return shaped.select("event_id", "decoded", F.array_join(rules.hit_ids(), ",").alias("ids"))


# ── the batch path ───────────────────────────────────────────────────────────

@query("score_requests", with_(REQUESTS_SQL, _COUNTS_SQL, _SESSION_SQL) + """
SELECT event_id, window_count, burst_count, window_distinct, length(path)::INT AS path_len,
  CASE WHEN burst_count > 4 OR window_count > 8 THEN 'L1-rate' ELSE 'L1-only' END AS layer,
  CASE WHEN burst_count > 4 OR window_count > 8 THEN 'block' ELSE 'allow' END AS action,
  CASE WHEN burst_count > 4 OR window_count > 8 THEN 403 ELSE status END AS status,
  round(ln(1 + window_distinct), 6) AS win_distinct_paths
FROM cnt JOIN ses USING (event_id) JOIN req USING (event_id)""")
def score_requests(spark, sf):
    """Shaping, rules, features, rates and decision of every request."""
    out = scoring.score_requests(requests(spark, sf), None, DAY)
    return out.select("event_id", "window_count", "burst_count", "window_distinct",
                      F.col("path_len").cast("int").alias("path_len"), "layer", "action", "status",
                      r6("win_distinct_paths").alias("win_distinct_paths"))


# "%", "+" and "&" would start another decoding, which SQL can't follow.
_FLAT_SQL = """flat AS (SELECT page_id, regexp_replace(canon_path, '[%+&]', ';', 'g') AS canon_path,
    regexp_replace(canon_body, '[%+&]', ';', 'g') AS canon_body FROM pg)"""
_FLAT_HITS_SQL = "hit AS (SELECT page_id, concat_ws(',', " + ", ".join(
    f"CASE WHEN {_hit_sql(r)} THEN '{r.id}' END" for r in rules.CATALOGUE) + ") AS ids FROM flat)"


@query("score_pages", with_(PAGES_SQL, _FLAT_SQL, _FLAT_HITS_SQL, _RULES_SQL) + """
SELECT page_id, ids, CASE WHEN blk THEN 'L1-rules' ELSE 'L1-only' END AS layer,
  CASE WHEN blk THEN reason ELSE 'anomaly models not loaded' END AS reason,
  CASE WHEN blk THEN 403 ELSE 200 END AS status FROM (
  SELECT page_id, any_value(ids) AS ids, coalesce(bool_or(severity = 'block'), false) AS blk,
    arg_min(id || ': ' || why, ordinal) FILTER (severity = 'block') AS reason
  FROM (SELECT page_id, ids, unnest(CASE WHEN ids = '' THEN [NULL] ELSE string_split(ids, ',') END) AS id
    FROM hit) LEFT JOIN rule USING (id) GROUP BY page_id)""")
def score_pages(spark, sf):
    """Whole pages posted as bodies, through the same path."""
    def flat(name):
        return F.regexp_replace(name, "[%+&]", ";")
    df = page_requests(spark, sf).select(
        F.col("page_id").alias("event_id"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("client"),
        F.timestamp_seconds("page_id").alias("ts"), F.lit("POST").alias("method"), flat("canon_path").alias("path"),
        flat("canon_body").alias("body"), F.lit(200).alias("status"))
    out = scoring.score_requests(df, None, DEFAULTS)
    return out.select(F.col("event_id").alias("page_id"), F.array_join("rule_hits", ",").alias("ids"), "layer",
                      "reason", "status")
