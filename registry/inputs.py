"""Adapters from the given tables to requests, log records and scored rows.

Each adapter exists twice: as a DataFrame and as a SQL common table expression.
Column definitions that read the same in both dialects are shared strings.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.config import DEFAULTS
from reqlens.functions import scalars
from reqlens.operators import eventlog

# Events are sparse, so windows of a day and six hours stand in for a minute
# and five seconds.
DAY = DEFAULTS.but(window_seconds=86_400, window_limit=8, burst_seconds=21_600, burst_limit=4,
                   session_gap_seconds=43_200)


_ROUNDED = re.compile(r"(.*)\bround\((.*), (\d+)\)(.*)")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(col, digits: int = 6):
    """Rounded as SQL here rounds doubles, scaled and back. Spark's own round works on their
    decimal form, and differs where a value is next to a tie."""
    scale = 10.0 ** digits
    return F.round((F.col(col) if isinstance(col, str) else col) * scale) / scale


# ── requests from events ─────────────────────────────────────────────────────

REQUEST_COLUMNS = {
    "event_id": "event_id",
    "client": "'u' || CAST(user_id AS STRING)",
    "method": ("CASE WHEN event_type IN ('view', 'click') THEN 'GET' "
               "WHEN event_type = 'signup' THEN 'POST' WHEN event_type = 'purchase' THEN 'PUT' "
               "ELSE 'DELETE' END"),
    "path": "'/api/' || event_type || '/' || CAST(event_id AS STRING)",
    "query": "CASE WHEN event_id % 5 = 0 THEN 'page=' || CAST(user_id AS STRING) ELSE '' END",
    "template": "'/api/' || event_type || '/{id}'",
    "body": "props",
    "body_size": "CAST(length(props) AS BIGINT)",
    "content_type": "CASE WHEN event_id % 3 = 0 THEN 'Application/JSON' ELSE 'text/plain' END",
    "status": "CASE WHEN event_type = 'error' THEN 500 ELSE 200 END",
    "latency_ms": "value",
    "y": "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END",
}


def _columns(defs: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in defs.items())


REQUESTS_SQL = f"req AS (SELECT {_columns(REQUEST_COLUMNS)}, epoch_us(ts) AS us FROM events)"


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        *[F.expr(sql).alias(name) for name, sql in REQUEST_COLUMNS.items()],
        F.col("ts").cast("timestamp").alias("ts"))


# ── log records from events ──────────────────────────────────────────────────

_HOT = "event_type = 'error' AND event_id % 4 = 0"
LOG_COLUMNS = {
    "event_id": "event_id",
    "client": "'u' || CAST(user_id AS STRING)",
    "method": REQUEST_COLUMNS["method"],
    "template": REQUEST_COLUMNS["template"],
    "body_size": "CAST(length(props) AS BIGINT)",
    "status": REQUEST_COLUMNS["status"],
    "window_count": "CASE WHEN event_id % 31 = 0 THEN NULL ELSE CAST(event_id % 12 AS INT) END",
    "burst_count": "CAST(event_id % 5 AS INT)",
    "latency_ms": "value",
    "detect_ms": "value / 10",
    "s_rate": "CASE WHEN value > 100 THEN 1 ELSE value / 100 END",
    "s_if": "(event_id * 7919 % 1000) / 1000",
    "s_ae": "(event_id * 104729 % 1000) / 1000",
    "label": ("CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_type <> 'error' THEN 'normal' "
              "WHEN event_id % 6 = 0 THEN 'attack:sqli' WHEN event_id % 6 = 1 THEN 'attack:xss' "
              "WHEN event_id % 6 = 2 THEN 'attack:cmdi' WHEN event_id % 6 = 3 THEN 'attack:ssti' "
              "WHEN event_id % 6 = 4 THEN 'attack:scan:deep' ELSE 'attack' END"),
    "hit_block": f"({_HOT})",
    "hit_xss": f"({_HOT} AND event_id % 3 = 0)",
    "hit_flag": "(event_id % 10 = 3)",
    "has_features": "(event_id % 29 <> 0)",
}

_LAYER = ("CASE WHEN hit_block THEN 'L1-rules' WHEN event_id % 17 = 0 THEN 'L1-rate' "
          "WHEN event_id % 101 = 0 THEN 'L-error' WHEN event_id % 103 = 0 THEN 'L1-only' "
          "WHEN (s_rate + s_if + s_ae) / 3 >= 0.6 THEN 'L4-meta' ELSE '' END")
LOG_DERIVED = {
    "layer": _LAYER,
    "m_lr": "round((s_rate + s_if + s_ae) / 3, 4)",
}
LOG_VERDICT = {
    "action": ("CASE WHEN layer IN ('L1-rules', 'L1-rate', 'L4-meta', 'L-error') "
               "THEN 'block' ELSE 'allow' END"),
    "enforced": "(layer IN ('L1-rules', 'L1-rate'))",
    "degraded": "(layer IN ('L-error', 'L1-only'))",
    "modelled": "(layer IN ('L4-meta', ''))",
}

LOG_SQL = f"""log0 AS (SELECT {_columns(LOG_COLUMNS)}, epoch_us(ts) AS us,
    round_even(epoch_us(ts) / 1e6, 3) AS ts FROM events),
  log1 AS (SELECT *, {_columns(LOG_DERIVED)} FROM log0),
  log AS (SELECT *, {_columns(LOG_VERDICT)} FROM log1)"""


def columns_of(defs: dict[str, str]) -> dict:
    """Shared definitions as columns; what they round is rounded as in SQL."""
    found = {name: _ROUNDED.fullmatch(sql) for name, sql in defs.items()}
    return {name: F.expr(sql) if not found[name] else F.expr(
        "{0}round(({1}) * 1e{2}) / 1e{2}{3}".format(*found[name].groups())) for name, sql in defs.items()}


def event_log(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """Log records in the event-log layout, plus event_id as arrival key. `more`: further
    columns to keep, as `time`, the event's own microsecond, of which ts has the millisecond."""
    df = table(spark, sf, "events").select(
        *[F.expr(sql).alias(name) for name, sql in LOG_COLUMNS.items()],
        scalars.epoch_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.col("ts").cast("timestamp").alias("time"))
    for step in (LOG_DERIVED, LOG_VERDICT):
        df = df.withColumns(columns_of(step))

    def some(condition, value):
        return F.when(F.col(condition), F.lit(value))

    def listed(*items):
        return F.array_compact(F.array(*items))

    def pairs(**values):
        return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("double"))])

    none = F.create_map().cast("map<string,double>")
    c = F.col
    return df.select(
        "event_id", "ts", "client", "method", "template", "body_size", "status", "window_count",
        "burst_count", "latency_ms", "detect_ms", "action", "enforced", "layer", "degraded",
        "label", *more,
        F.concat(F.lit("event "), c("event_id").cast("string")).alias("reason"),
        c("m_lr").alias("probability"),
        listed(some("hit_block", "sqli.union"), some("hit_flag", "sqli.comment_terminator"),
               some("hit_xss", "xss.script_tag")).alias("rule_hits"),
        listed(F.when(c("hit_block") | c("hit_flag"), "sqli"), some("hit_xss", "xss"),
               F.when(c("layer") == "L1-rate", "rate")).alias("categories"),
        F.when(c("modelled"), pairs(rate=c("s_rate"), isolation_forest=c("s_if"),
                                    autoencoder=c("s_ae"), meta_lr=c("m_lr"))
               ).otherwise(none).alias("scores"),
        F.when(c("has_features"), pairs(
            body_log_size=F.log1p("body_size"), path_len=F.length("template"),
            win_log_count=F.log1p(c("event_id") % 7))).otherwise(none).alias("features"))


# Labelled rows: y, family, l1, by_rule and win, as training derives them.
LABELLED_SQL = f"""{LOG_SQL},
  lab AS (SELECT *,
    CASE WHEN label LIKE 'attack%' THEN 1 ELSE 0 END AS y,
    CASE WHEN label LIKE 'attack%' THEN CASE WHEN contains(label, ':')
      THEN substr(label, instr(label, ':') + 1) ELSE 'unknown' END END AS family,
    (hit_block OR layer = 'L1-rate') AS l1, (hit_block OR hit_flag) AS by_rule,
    CAST(coalesce(window_count, event_id % 7) AS DOUBLE) AS win
    FROM log WHERE label IS NOT NULL AND has_features)"""


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return eventlog.labelled_rows(event_log(spark, sf))


# ── requests from pages ──────────────────────────────────────────────────────

# Fixed payloads, one per rule family and severity, and two harmless strings.
PAYLOADS = [
    "id=1 union select name from t", "x' or '1'='1' --", "; drop table users",
    "'; update t set a=1", "and sleep(5)", "from information_schema.tables", "name' -- note",
    "<script>alert(1)</script>", "<svg onload=run()>", "see /etc/passwd now",
    "; cat notes.txt", "{{7*7}}", "european union of select goods", "use the -- flag",
]
_PAYLOAD = "CASE page_id % 14 " + " ".join(
    "WHEN {} THEN '{}'".format(i, p.replace("'", "''")) for i, p in enumerate(PAYLOADS)) + " END"

PAGES_SQL = f"""pg0 AS (SELECT page_id,
    regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(url, '[?]([^#]*)', 1) AS query,
    regexp_replace(regexp_replace(lower(html), '<[^>]*>', ' ', 'g'), '[^\\x00-\\x7F]', 'x', 'g')
      AS words, {_PAYLOAD} AS payload FROM pages),
  pg AS (SELECT page_id, path, query, path || CASE WHEN query <> '' THEN '?' || query ELSE '' END
    AS canon_path, trim(regexp_replace(words, '[ \\t\\n\\r]+', ' ', 'g')) || ' ' || payload
    AS canon_body FROM pg0)"""


def page_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as canonical requests: the whole text with a payload at its end."""
    words = F.regexp_replace(F.regexp_replace(F.lower("html"), "<[^>]*>", " "),
                             "[^\\x00-\\x7F]", "x")
    payload = F.element_at(F.array(*[F.lit(p) for p in PAYLOADS]),
                           (F.col("page_id") % 14 + 1).cast("int"))
    df = table(spark, sf, "pages").select(
        "page_id", F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract("url", "[?]([^#]*)", 1).alias("query"), "html",
        words.alias("words"), payload.alias("payload"))
    return df.withColumns({
        "canon_path": F.concat("path", F.when(F.col("query") != "", F.concat(
            F.lit("?"), "query")).otherwise("")),
        "canon_body": F.concat(F.trim(F.regexp_replace("words", "[ \\t\\n\\r]+", " ")),
                               F.lit(" "), "payload")}).drop("words", "payload")


# ── scored, labelled rows from documents and labels ──────────────────────────

SCORED_COLUMNS = {
    "doc_id": "doc_id", "client": "source", "y": "toxic",
    "family": ("CASE WHEN toxic = 1 THEN CASE WHEN lang = 'en' THEN 'sqli' "
               "WHEN lang = 'de' THEN 'cmdi' ELSE 'xss' END END"),
    "score": "CASE WHEN n_chars > 20000 THEN 1 ELSE round(n_chars / 20000, 3) END",
    "score2": "(length(text) % 97) / 97",
    "l1": "(doc_id % 9 = 0)",
}
SCORED_SQL = (f"sc AS (SELECT {_columns(SCORED_COLUMNS)} FROM documents JOIN labels USING (doc_id))")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return joined.select(*[c.alias(name) for name, c in columns_of(SCORED_COLUMNS).items()])


# ── vectors from embeddings ──────────────────────────────────────────────────

VECTOR = [f"x{i}" for i in range(64)]


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", *[F.element_at("embedding", i + 1).cast("double").alias(c)
                             for i, c in enumerate(VECTOR)])


def r6_sql(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n  ".join(ctes) + "\n"
