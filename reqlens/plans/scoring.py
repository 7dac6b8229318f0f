"""From raw requests to decisions: the path batch and stream scoring share.

Text is read once, before any shuffle: `shape` canonicalises it, scans the rules,
measures the features that need no history and drops it. What is shuffled to its
client for the rates, and all that `judge` needs, is numbers, hits and labels.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqlens.config import DEFAULTS, Settings
from reqlens.functions import features, rules, text
from reqlens.models.bundle import ModelSet
from reqlens.operators import baseline as bl
from reqlens.operators import decide, rates, requests

TEXT = ("path", "query", "body", "content_type", "user_agent", "canon_path", "canon_body", "xff", "peer")


def shape(df: DataFrame, settings: Settings = DEFAULTS, rule_table: DataFrame | None = None,
          measured: bool = True) -> DataFrame:
    """Canonical requests -> hits and, if `measured`, early features, without text."""
    df = text.with_payload(requests.truncate_body(df, settings))
    df = (rules.scan_table(df, rule_table) if rule_table is not None
          else df.withColumn("hits", rules.scan()))
    if measured:
        df = df.withColumns(features.early_columns(settings))
    else:
        df = df.drop("path_decode_delta", "q_decode_delta").withColumn("path_len", F.length("path"))
    return df.drop(*TEXT)


def judge(df: DataFrame, models: ModelSet | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Shaped requests with rate columns -> decisions with enforcement."""
    if set(features.EARLY) <= set(df.columns):
        if models is not None:
            df = bl.with_endpoint_stats(df, models.baseline)
        else:
            df = df.withColumns({"body_mean": F.lit(None).cast("double"),
                                 "body_std": F.lit(None).cast("double"), "path_known": F.lit(1.0)})
        if "window_distinct" not in df.columns:
            df = df.withColumn("window_distinct", F.lit(0))
        df = df.withColumns(features.late_columns()).drop("body_mean", "body_std")
    return decide.enforce(decide.decide(df, models, settings), settings)


def inspect(df: DataFrame, models: ModelSet | None = None, settings: Settings = DEFAULTS,
            rule_table: DataFrame | None = None) -> DataFrame:
    """Requests that already have rate columns -> decisions with enforcement."""
    return judge(shape(df, settings, rule_table), models, settings)


def accept(df: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(canonical requests, refused oversize requests)."""
    return requests.split_oversize(requests.to_request(df), settings)


def score_requests(df: DataFrame, models: ModelSet | None = None,
                   settings: Settings = DEFAULTS) -> DataFrame:
    """Batch scoring."""
    accepted, _ = accept(df, settings)
    rated = rates.rate_state(accepted, settings, prepare=lambda rows: shape(rows, settings))
    return judge(rated, models, settings)


def event_log(df: DataFrame, models: ModelSet | None = None,
              settings: Settings = DEFAULTS) -> DataFrame:
    return decide.to_event_log(score_requests(df, models, settings), settings)
