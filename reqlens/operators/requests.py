"""Shaping raw requests: defaults, size limits, identity, privacy."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlens.config import DEFAULTS, Settings
from reqlens.functions import scalars, text
from reqlens.schemas import FEATURE_NAMES

# What may leave the gateway beside the hashed client: numbers, verdicts and
# templates, no request text. Columns that are not listed are dropped.
PUBLIC = ("event_id", "ts", "us", "method", "template", "path_len", "body_size", "status",
          "window_count", "burst_count", "window_distinct", "session_start", "latency_ms",
          "detect_ms", "action", "enforced", "would_block", "layer", "reason", "probability",
          "scores", "rule_hits", "categories", "degraded", "features", "label", "y", "family",
          "header_count", "has_referer", "has_auth", *FEATURE_NAMES)


def _or(name: str, default, df: DataFrame, kind: str) -> Column:
    if name not in df.columns:
        return F.lit(default).cast(kind)
    return F.coalesce(F.col(name).cast(kind), F.lit(default).cast(kind))


def to_request(df: DataFrame) -> DataFrame:
    """Canonical event columns with defaults; every other column passes through.

    body_size falls back to the text's bytes only where it is absent, so an
    explicit 0 stays 0.
    """
    path = F.when(_or("path", "/", df, "string") == "", "/").otherwise(
        _or("path", "/", df, "string"))
    method = F.when(_or("method", "GET", df, "string") == "", "GET").otherwise(
        _or("method", "GET", df, "string"))
    body = _or("body", "", df, "string")
    size = F.octet_length(body).cast("bigint")
    if "body_size" in df.columns:
        size = F.coalesce(F.col("body_size").cast("bigint"), size)
    template = text.path_template(path)
    if "template" in df.columns:
        template = F.coalesce(F.nullif(F.col("template"), F.lit("")), template)
    return df.withColumns({
        "method": F.upper(method), "path": path, "query": _or("query", "", df, "string"),
        "body": body, "body_size": size, "template": template,
        "content_type": _or("content_type", "", df, "string"),
        "user_agent": _or("user_agent", "", df, "string"),
    })


def split_oversize(df: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused). Refused requests never reach counters or rules."""
    over = F.col("body_size") > settings.max_body_bytes
    refused = df.filter(over).withColumn("status", F.lit(413))
    return df.filter(F.coalesce(~over, F.lit(True))), refused


def truncate_body(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Only the first inspect_bytes bytes of the body are inspected; without
    that limit, all of it.

    A character cut in half is dropped: of the four byte lengths that can end
    the last whole character, the longest valid one is kept.
    """
    if settings.inspect_bytes is None:
        return df
    raw = F.encode("body", "UTF-8")
    whole = F.coalesce(*[
        F.try_validate_utf8(F.substring(raw, 1, settings.inspect_bytes - k).cast("string"))
        for k in range(4)])
    return df.withColumn("body", F.when(
        F.octet_length("body") <= settings.inspect_bytes, F.col("body")).otherwise(whole))


def resolve_client(df: DataFrame, peer="peer", forwarded="xff",
                   settings: Settings = DEFAULTS) -> DataFrame:
    return df.withColumn("client", scalars.client_id(peer, forwarded, settings.trusted_hops))


def gate_label(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Labels come from the client, so they count only on a trusted lab network."""
    return df.withColumn("label", F.when(F.lit(settings.trust_label), F.col("label")))


def privacy_projection(df: DataFrame) -> DataFrame:
    """Keeps the PUBLIC columns and the hashed client."""
    keep = [c for c in df.columns if c in PUBLIC]
    return df.select(*keep, scalars.hash_client("client").alias("client"))
