"""Text shapes, features, request shaping and signature rules."""
from __future__ import annotations

from pyspark.sql import functions as F

from registry import query
from registry.inputs import (PAGES_SQL, REQUESTS_SQL, page_requests, r6, r6_sql, requests, table,
                             with_)
from reqlens.config import DEFAULTS
from reqlens.functions import features, rules, scalars, text
from reqlens.operators import baseline as bl
from reqlens.operators import requests as shaping
from reqlens.schemas import FEATURE_NAMES

# ── paths, queries, characters ───────────────────────────────────────────────

_LONG_PATH = ("path || '/' || md5(path) || '/' || substr(md5(path), 1, 8) || '-' || "
              "substr(md5(path), 9, 4) || '-' || substr(md5(path), 13, 4) || '-' || "
              "substr(md5(path), 17, 4) || '-' || substr(md5(path), 21, 12) || '//?next=/9'")


@query("path_templates", with_(PAGES_SQL) + f"""
SELECT page_id, '/' || array_to_string([CASE WHEN regexp_full_match(s, '[0-9]+') THEN '{{id}}'
    WHEN regexp_full_match(s, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}')
      THEN '{{uuid}}'
    WHEN regexp_full_match(s, '[0-9a-fA-F]{{16,}}') THEN '{{hash}}' ELSE s END
    for s in string_split(split_part({_LONG_PATH}, '?', 1), '/') if s <> ''], '/') AS template
FROM pg""")
def path_templates(spark, sf):
    df = page_requests(spark, sf).withColumn("long_path", F.expr(_LONG_PATH))
    return df.select("page_id", text.path_template("long_path").alias("template"))


@query("path_shape", with_(PAGES_SQL) + """
SELECT page_id, least(len(segs), 20)::BIGINT AS depth,
  coalesce(list_max([length(s) for s in segs]), 0)::BIGINT AS max_seg,
  round(CASE WHEN len(segs) = 0 THEN 0 ELSE
    len([s for s in segs if regexp_full_match(s, '[0-9]+')]) / len(segs) END, 6) AS numeric_ratio
FROM (SELECT page_id, [s for s in string_split(path, '/') if s <> ''] AS segs FROM pg)""")
def path_shape(spark, sf):
    return page_requests(spark, sf).select(
        "page_id", text.path_depth("path", limit=20).cast("bigint").alias("depth"),
        text.path_max_segment("path").cast("bigint").alias("max_seg"),
        r6(text.path_numeric_ratio("path")).alias("numeric_ratio"))


@query("query_shape", with_(PAGES_SQL) + """
SELECT page_id, len(ps)::BIGINT AS params, length(query)::BIGINT AS total_len,
  coalesce(list_max([CASE WHEN contains(p, '=') THEN length(substr(p, instr(p, '=') + 1))
    ELSE 0 END for p in ps]), 0)::BIGINT AS max_value
FROM (SELECT page_id, query, [p for p in string_split(query, '&') if p <> ''] AS ps FROM pg)""")
def query_shape(spark, sf):
    return page_requests(spark, sf).select(
        "page_id", F.size(text.params("query")).cast("bigint").alias("params"),
        F.length("query").cast("bigint").alias("total_len"),
        text.max_param_value("query").cast("bigint").alias("max_value"))


def _class_sql(column: str, pattern: str) -> str:
    return (f"round(CASE WHEN length({column}) = 0 THEN 0 ELSE (length({column}) - "
            f"length(regexp_replace({column}, '{pattern}', '', 'g'))) / length({column}) END, 6)")


_SPECIAL, _DIGIT, _UPPER, _WIDE = ("[^A-Za-z0-9 _\\-./]", "\\p{Nd}", "[A-Z]", "[^\\x00-\\x7F]")


@query("char_ratios", f"""
SELECT doc_id, {_class_sql('text', _SPECIAL)} AS special, {_class_sql('text', _DIGIT)} AS digit,
  {_class_sql('text', _UPPER)} AS upper, {_class_sql('text', _WIDE)} AS nonascii
FROM documents""")
def char_ratios(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", r6(text.special_ratio("text")).alias("special"),
        r6(text.digit_ratio("text")).alias("digit"), r6(text.upper_ratio("text")).alias("upper"),
        r6(text.nonascii_ratio("text")).alias("nonascii"))


@query("body_entropy", """
SELECT doc_id, round(coalesce(sum(-(k / n) * log2(k / n)), 0), 6) AS entropy FROM (
  SELECT doc_id, n, count(*) AS k FROM (
    SELECT doc_id, length(text) AS n, unnest(regexp_extract_all(text, '(?s).')) AS ch
    FROM documents) GROUP BY doc_id, n, ch) GROUP BY doc_id""")
def body_entropy(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", r6(text.shannon_entropy("text")).alias("entropy"))


@query("canonical_payload")
def canonical_payload(spark, sf):
    """Canonical path and whole body of every page, and how much decoding shrank it."""
    df = text.with_payload(page_requests(spark, sf), body="html")
    return df.select("page_id", F.md5("canon_path").alias("path_md5"),
                     F.md5("canon_body").alias("body_md5"),
                     F.length("canon_body").alias("body_len"), r6("path_decode_delta").alias(
                         "path_delta"), r6("q_decode_delta").alias("query_delta"))


@query("decode_delta")
def decode_delta(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", r6(text.decode_delta("text")).alias("delta"))


# Double-encoded spaces and braces, over text that decoding leaves alone otherwise.
_PLAIN = "regexp_replace(props, '[^A-Za-z0-9]', '-')"


@query("url_decoding", """
SELECT event_id, 'a ' || regexp_replace(props, '[^A-Za-z0-9]', '-', 'g') || ' {x}' AS decoded,
  round(12 / (length(props) + 18), 6) AS delta FROM events""")
def url_decoding(spark, sf):
    """Encoded text back to plain text through several rounds of decoding."""
    raw = F.concat(F.lit("a+"), F.expr(_PLAIN), F.lit("%20%257Bx%25257D"))
    df = table(spark, sf, "events").select("event_id", raw.alias("raw"))
    return df.select("event_id", text.url_decode_loop("raw").alias("decoded"),
                     r6(text.decode_delta("raw")).alias("delta"))


# ── features ─────────────────────────────────────────────────────────────────

def _entropy_sql(column: str) -> str:
    return (f"CASE WHEN length({column}) = 0 THEN 0 ELSE (SELECT sum(-(k / n) * log2(k / n)) FROM "
            f"(SELECT count(*) AS k, length({column}) AS n FROM (SELECT unnest(string_split("
            f"{column}, '')) AS ch) GROUP BY ch)) END")


def _is(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


_FEATURE_SQL = {
    "body_log_size": "ln(1 + body_size)", "body_entropy": "be.h",
    "body_special_ratio": _class_sql("body", _SPECIAL), "body_digit_ratio": _class_sql("body", _DIGIT),
    "body_upper_ratio": _class_sql("body", _UPPER), "body_nonascii_ratio": _class_sql("body", _WIDE),
    "body_size_z": ("CASE WHEN b.body_std > 1e-9 THEN greatest(-10, least(10, "
                    "(body_size - b.body_mean) / b.body_std)) ELSE 0 END"),
    "has_body": _is("body_size > 0"), "ct_json": _is("contains(lower(content_type), 'json')"),
    "path_len": "length(path)", "path_depth": "3",
    "path_max_seg": "greatest(3, length(split_part(path, '/', 3)), length(split_part(path, '/', 4)))",
    "path_entropy": "pe.h",
    "path_special_ratio": _class_sql("path", _SPECIAL), "path_digit_ratio": _class_sql("path", _DIGIT),
    "path_numeric_seg_ratio": "1 / 3", "path_nonascii_ratio": "0", "path_decode_delta": "0",
    "path_dot_count": "0", "path_known": _is("b.template IS NOT NULL"),
    "q_param_count": _is("query <> ''"),
    "q_max_val_len": "CASE WHEN query <> '' THEN length(query) - 5 ELSE 0 END",
    "q_total_len": "length(query)", "q_special_ratio": _class_sql("query", _SPECIAL),
    "q_decode_delta": "0", "win_distinct_paths": "ln(1 + event_id % 6)",
    "m_get": _is("method = 'GET'"), "m_post": _is("method = 'POST'"), "m_put": _is("method = 'PUT'"),
    "m_delete": _is("method = 'DELETE'"), "m_patch": "0", "m_other": "0",
    "is_write": _is("method <> 'GET'"), "n_flags": "event_id % 3",
}
_BASE_SQL = ("base AS (SELECT template, avg(body_size) AS body_mean, stddev_pop(body_size) AS "
             "body_std, count(*) AS n FROM req WHERE y = 0 GROUP BY template HAVING count(*) >= 5)")
_CHARS_SQL = """{0}e AS (SELECT event_id, sum(-(k / n) * log2(k / n)) AS h FROM (
    SELECT event_id, n, count(*) AS k FROM (SELECT event_id, length({1}) AS n,
      unnest(string_split({1}, '')) AS ch FROM req) GROUP BY event_id, n, ch) GROUP BY event_id)"""


def featured(spark, sf, df=None):
    """Event requests with all 34 features against a baseline of normal traffic."""
    df = requests(spark, sf)
    endpoints = bl.endpoint_baseline(df.filter(F.col("y") == 0))
    base = bl.Baseline(endpoints, ready=True)
    df = text.with_payload(bl.with_endpoint_stats(df, base)).withColumns({
        "window_distinct": F.col("event_id") % 6, "n_flags": F.col("event_id") % 3})
    return features.with_features(df)


@query("feature_vector", with_(REQUESTS_SQL, _BASE_SQL, _CHARS_SQL.format("b", "body"),
                               _CHARS_SQL.format("p", "path")) + "SELECT event_id, " + ", ".join(
    f"round(CAST({_FEATURE_SQL[n]} AS DOUBLE), 6) AS {n}" for n in FEATURE_NAMES) + """
FROM req JOIN be USING (event_id) JOIN pe USING (event_id) LEFT JOIN base b USING (template)""")
def feature_vector(spark, sf):
    return featured(spark, sf).select("event_id", *[r6(n).alias(n) for n in FEATURE_NAMES])


@query("feature_vector_pages")
def feature_vector_pages(spark, sf):
    """Features of whole pages posted as bodies, with real encodings in them."""
    df = page_requests(spark, sf).select("page_id", "path", "query", F.col("html").alias("body"))
    df = shaping.to_request(df).withColumns({  # features need no canonical body
        "path_decode_delta": text.decode_delta("path"), "q_decode_delta": text.decode_delta("query"),
        "body_mean": F.lit(None).cast("double"), "body_std": F.lit(None).cast("double"),
        "path_known": F.lit(1.0), "window_distinct": F.lit(1), "n_flags": F.lit(0)})
    return features.with_features(df).select("page_id", *[r6(n).alias(n) for n in FEATURE_NAMES])


@query("feature_snapshot", with_(REQUESTS_SQL) + """
SELECT event_id, 'path_len' AS name, CAST(length(path) AS DOUBLE) AS value FROM req UNION ALL
SELECT event_id, 'q_total_len', CAST(length(query) AS DOUBLE) FROM req UNION ALL
SELECT event_id, 'is_write', CAST(CASE WHEN method <> 'GET' THEN 1 ELSE 0 END AS DOUBLE) FROM req""")
def feature_snapshot(spark, sf):
    names = ["path_len", "q_total_len", "is_write"]
    snap = featured(spark, sf).select("event_id", scalars.feature_map(names).alias("f"))
    return snap.select("event_id", F.explode("f").alias("name", "value"))


# ── request shaping ──────────────────────────────────────────────────────────

@query("request_defaults", """
SELECT event_id, CASE WHEN event_type = 'view' THEN 'GET' ELSE upper(event_type) END AS method,
  CASE WHEN event_id % 4 = 0 THEN '/' ELSE '/api/' || event_id END AS path,
  CASE WHEN event_id % 4 = 0 THEN '/' ELSE '/api/{id}' END AS template, '' AS query,
  CASE WHEN event_id % 3 = 0 THEN 0 ELSE length(props) END::BIGINT AS body_size FROM events""")
def request_defaults(spark, sf):
    df = table(spark, sf, "events").selectExpr(
        "event_id", "CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS method",
        "CASE WHEN event_id % 4 = 0 THEN '' ELSE '/api/' || event_id END AS path",
        "props AS body", "CASE WHEN event_id % 3 = 0 THEN 0L END AS body_size")
    return shaping.to_request(df).select(
        "event_id", "method", "path", "template", "query", "body_size")


@query("oversize_split", """
SELECT doc_id, CASE WHEN n_chars > 5000 THEN 413 ELSE 200 END AS status FROM documents""")
def oversize_split(spark, sf):
    small = DEFAULTS.but(max_body_bytes=5_000)
    df = table(spark, sf, "documents").selectExpr(
        "doc_id", "n_chars AS body_size", "200 AS status")
    accepted, refused = shaping.split_oversize(df, small)
    return accepted.unionByName(refused).select("doc_id", "status")


@query("truncate_body", """
SELECT doc_id, CASE WHEN strlen(text) <= 1000 THEN length(text) ELSE
  (SELECT max(k) FROM range(0, 1001) t(k) WHERE strlen(left(text, k)) <= 1000) END::BIGINT AS kept
FROM documents""")
def truncate_body(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", F.col("text").alias("body"))
    cut = shaping.truncate_body(df, DEFAULTS.but(inspect_bytes=1_000))
    return cut.select("doc_id", F.length("body").cast("bigint").alias("kept"))


_XFF = ("CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 5 = 1 THEN ' , ' "
        "WHEN event_id % 5 = 2 THEN 'h' || user_id WHEN event_id % 5 = 3 "
        "THEN 'a' || user_id || ', b' || event_id ELSE ' c, d' || user_id || ',, e ' END")


@query("xff_client", """
SELECT event_id, 'p' || user_id AS hops0, CASE event_id % 5 WHEN 2 THEN 'h' || user_id
    WHEN 3 THEN 'b' || event_id WHEN 4 THEN 'e' ELSE 'p' || user_id END AS hops1,
  CASE event_id % 5 WHEN 2 THEN 'h' || user_id WHEN 3 THEN 'a' || user_id
    WHEN 4 THEN 'd' || user_id ELSE 'p' || user_id END AS hops2,
  CASE event_id % 5 WHEN 2 THEN 'h' || user_id WHEN 3 THEN 'a' || user_id WHEN 4 THEN 'c'
    ELSE 'p' || user_id END AS hops9 FROM events""")
def xff_client(spark, sf):
    df = table(spark, sf, "events").selectExpr(
        "event_id", "'p' || user_id AS peer", f"{_XFF} AS xff")
    return df.select("event_id", *[scalars.client_id("peer", "xff", h).alias(f"hops{h}")
                                   for h in (0, 1, 2, 9)])


@query("client_hash", with_(REQUESTS_SQL) + """
SELECT event_id, substr(sha256(client), 1, 16) AS client,
  substr(sha256(CAST(us AS STRING) || client || path), 1, 16) AS request_id FROM req""")
def client_hash(spark, sf):
    return requests(spark, sf).select(
        "event_id", scalars.request_id(F.unix_micros("ts"), "client", "path").alias("request_id"),
        scalars.hash_client("client").alias("client"))


@query("privacy_projection", with_(REQUESTS_SQL) + """
SELECT event_id, method, template, body_size, status, latency_ms, y, us,
  substr(sha256(client), 1, 16) AS client FROM req""")
def privacy_projection(spark, sf):
    df = shaping.privacy_projection(requests(spark, sf))
    return df.withColumn("us", F.unix_micros("ts")).drop("ts")


# ── signature rules ──────────────────────────────────────────────────────────

def _hit_sql(rule) -> str:
    subject = {"path": "canon_path", "body": "canon_body",
               "any": "canon_path || chr(10) || canon_body"}[rule.target]
    pattern = rule.pattern.replace("'", "''")
    return f"regexp_matches({subject}, '{pattern}', 'i')"


def _ids_sql(kept=rules.CATALOGUE) -> str:
    return "concat_ws(',', " + ", ".join(
        f"CASE WHEN {_hit_sql(r)} THEN '{r.id}' END" for r in kept) + ")"


_HITS_SQL = "hit AS (SELECT page_id, " + _ids_sql() + " AS ids FROM pg)"
_RULES_SQL = "rule AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{r.id}', '{r.category}', '{r.severity}', '{r.why.replace(chr(39), chr(39) * 2)}', {i})"
    for i, r in enumerate(rules.CATALOGUE)) + ") t(id, category, severity, why, ordinal))"


@query("rule_scan", with_(PAGES_SQL, _HITS_SQL) + "SELECT page_id, ids FROM hit")
def rule_scan(spark, sf):
    hits = page_requests(spark, sf).withColumn("hits", rules.scan())
    return hits.select("page_id", F.array_join(rules.hit_ids(), ",").alias("ids"))


@query("rule_scan_table", with_(PAGES_SQL, _HITS_SQL) + "SELECT page_id, ids FROM hit")
def rule_scan_table(spark, sf):
    """A rule table that is data, not code."""
    hits = rules.scan_table(page_requests(spark, sf), rules.rules_table(spark))
    return hits.select("page_id", F.array_join(rules.hit_ids(), ",").alias("ids"))


@query("rule_severity", with_(PAGES_SQL, _HITS_SQL, _RULES_SQL) + """
SELECT page_id, CASE WHEN bool_or(severity = 'block') THEN 'block'
    WHEN count(id) > 0 THEN 'flag' END AS worst,
  arg_min(id || ': ' || why, ordinal) FILTER (severity = 'block') AS reason,
  coalesce(string_agg(DISTINCT category, ',' ORDER BY category), '') AS categories,
  count(id) AS n_hits
FROM (SELECT page_id, unnest(CASE WHEN ids = '' THEN [NULL] ELSE string_split(ids, ',') END) AS id
  FROM hit) LEFT JOIN rule USING (id) GROUP BY page_id""")
def rule_severity(spark, sf):
    df = page_requests(spark, sf).withColumn("hits", rules.scan())
    return df.select(
        "page_id", rules.worst_severity().alias("worst"), rules.block_reason().alias("reason"),
        F.array_join(rules.categories(), ",").alias("categories"),
        rules.n_flags().cast("bigint").alias("n_hits"))
