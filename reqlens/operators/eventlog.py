"""Selections and projections over the numeric event log."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlens.config import DEFAULTS, Settings
from reqlens.functions import rules, scalars

# Display labels per deciding layer.
LAYER_LABELS = {
    "L1-rules": "L1 · signature rule",
    "L1-rate": "L1 · rate limit",
    "L4-meta": "L4 · meta-learner (ensemble)",
    "L-error": "fail-closed (inference error)",
    "L1-only": "L1 only (models not loaded)",
    "": "allowed",
}

# Column captions of the recent-events table.
RECENT_NAMES = {
    "meta_lr": "DECISION (L4)", "rate": "evidence: rate",
    "isolation_forest": "evidence: iforest", "autoencoder": "evidence: autoencoder",
    "decided_by": "decided by", "client": "client (hashed)",
}
RECENT_COLUMNS = ["time", "method", "template", "status", "action", "decided_by", "meta_lr",
                  "rate", "isolation_forest", "autoencoder", "categories", "reason",
                  "latency_ms", "detect_ms", "client"]


def since(df: DataFrame, now: float, minutes: float | None) -> DataFrame:
    """Events of the last `minutes`; without a limit, all of them. Both filters
    reach the scan, and the one on `dt`, where it exists, prunes directories."""
    if not minutes:
        return df
    first = now - minutes * 60
    if "dt" in df.columns:
        day = F.to_date(F.timestamp_seconds(F.lit(first)))
        df = df.filter(F.col("dt") >= day)
    return df.filter(F.col("ts") >= F.lit(first))


def require_features(df: DataFrame) -> DataFrame:
    return df.filter(F.size("features") > 0)


def tail(df: DataFrame, n: int, order=("ts", "event_id")) -> DataFrame:
    """The newest n records. A distributed log has no file order, so arrival
    keys decide; per-partition heaps keep this to n rows per task."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def with_label(df: DataFrame) -> DataFrame:
    y, family = scalars.parse_label("label")
    return df.withColumns({"y": y, "family": family})


def l1_settled(rule_hits="rule_hits", layer="layer") -> Column:
    """Did a BLOCK signature or the rate limit settle the request alone?"""
    return rules.ids_block(rule_hits) | F.coalesce(F.col(layer) == "L1-rate", F.lit(False))


def labelled_rows(df: DataFrame) -> DataFrame:
    """Records usable for training, with y, family, l1, by_rule and win."""
    logged = F.try_element_at(F.col("features"), F.lit("win_log_count"))
    return require_features(with_label(df)).filter(F.col("y").isNotNull()).withColumns({
        "client": F.coalesce(F.col("client"), F.lit("?")),
        "template": F.coalesce(F.col("template"), F.lit("/")),
        "body_size": F.coalesce(F.col("body_size"), F.lit(0)),
        "l1": l1_settled(),
        "by_rule": F.coalesce(F.size("rule_hits") > 0, F.lit(False)),
        "win": F.coalesce(F.col("window_count").cast("double"), F.expm1(logged), F.lit(0.0)),
    })


def is_novel(settings: Settings = DEFAULTS, family="family") -> Column:
    """NULL families are not novel; a plain NOT IN would lose those rows."""
    return F.coalesce(F.col(family).isin(*settings.novel_families), F.lit(False))


def with_pool(df: DataFrame, seed: int) -> DataFrame:
    return df.withColumn("pool", scalars.pool_of("client", seed))


def training_pool(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """ML-visible rows in their pools: base is normal-only, meta and val lose
    the withheld families, test keeps everything."""
    rows = df.filter(~F.col("l1"))
    keep = (F.when(F.col("pool") == "base", F.col("y") == 0)
            .when(F.col("pool").isin("meta", "val"), ~is_novel(settings))
            .otherwise(True))
    return rows.filter(keep)


def clean_rows(df: DataFrame) -> DataFrame:
    return df.filter(~rules.ids_block())


def flatten_scores(df: DataFrame) -> DataFrame:
    return df.withColumns({
        k: F.try_element_at(F.col("scores"), F.lit(k))
        for k in ("rate", "isolation_forest", "autoencoder", "meta_lr")})


def blocked_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("action") == "block")


def ml_decided(df: DataFrame) -> DataFrame:
    return df.filter(F.col("layer").isin("L4-meta", "") & F.col("meta_lr").isNotNull())


def decided_by(layer="layer") -> Column:
    label = F.create_map(*[F.lit(x) for kv in LAYER_LABELS.items() for x in kv])
    code = F.coalesce(F.col(layer), F.lit(""))
    return F.coalesce(F.try_element_at(label, code), code)


def for_display(df: DataFrame) -> DataFrame:
    return flatten_scores(df).withColumns({
        "time": scalars.to_time("ts"), "decided_by": decided_by()})


def recent_events(df: DataFrame, n: int = 400, order=("ts", "event_id")) -> DataFrame:
    """Newest n events with the caption names; missing columns are skipped."""
    cols = [c for c in RECENT_COLUMNS if c in df.columns]
    return tail(df, n, order).select(*cols).withColumnsRenamed(RECENT_NAMES)
