"""The decision cascade and what follows from it: enforcement, status, log record."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlens.config import DEFAULTS, Settings
from reqlens.functions import rules, scalars
from reqlens.functions.features import feature_columns
from reqlens.models.bundle import ModelSet, score
from reqlens.schemas import FEATURE_NAMES

ML_LAYERS = ("L4-meta", "L-error")


def _scores(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


def l1_columns(hits="hits") -> dict[str, Column]:
    """blocked_by_rule, limited and survives, from rule hits and the rate verdict."""
    blocked = rules.has_block(hits)
    limited = ~blocked & F.coalesce(F.col("rate_limited"), F.lit(False))
    return {"_rule": blocked, "_rate": limited, "_survives": ~(blocked | limited)}


def decide(df: DataFrame, models: ModelSet | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds the decision columns to requests with hits and the rate columns.

    The cheap, certain layer runs as plain columns. The models run in the same
    pass, but rows that layer settled reach them as NULL and cost nothing; a
    split into branches would read and canonicalise the input once per branch.
    """
    df = df.withColumns(l1_columns()).withColumn("n_flags", rules.n_flags("hits"))
    rule, rate, survives = F.col("_rule"), F.col("_rate"), F.col("_survives")
    if models is not None:
        if not set(FEATURE_NAMES) <= set(df.columns):
            df = df.withColumns(feature_columns(settings))
        df = score(df, models, settings, when=survives)
        # A missing or non-finite probability is a scoring failure as well.
        failed = survives & (F.col("error").isNotNull() | F.col("p").isNull() | F.isnan("p"))
        error = F.coalesce("error", F.lit("ValueError"))
        attack = survives & ~failed & (F.col("p") >= models.threshold)
        normal = survives & ~failed & ~attack
        no_model = F.lit(False)
    else:
        failed, attack, normal, error = F.lit(False), F.lit(False), F.lit(False), F.lit("")
        no_model = survives
        df = df.withColumn("p", F.lit(None).cast("double"))

    closed = F.lit(settings.fail_closed)
    action = F.when(rule | rate | attack | (failed & closed), "block").otherwise("allow")
    layer = (F.when(rule, "L1-rules").when(rate, "L1-rate").when(no_model, "L1-only")
             .when(failed, "L-error").when(attack, "L4-meta").otherwise(""))
    threshold = models.threshold if models is not None else settings.fallback_threshold
    # Layers above and reasons below, as they stand in the log.
    reason = (
        F.when(rule, rules.block_reason("hits"))
        .when(rate, F.coalesce(F.nullif("rate_reason", F.lit("")), F.lit("rate limit exceeded")))
        .when(no_model, "anomaly models not loaded")
        .when(failed, F.concat(F.lit("inference failure, failing "
                                     + ("closed" if settings.fail_closed else "open") + ": "), error))
        .when(attack, F.format_string("ensemble anomaly probability %.3f >= threshold %.3f",
                                      F.col("p"), F.lit(float(threshold))))
        .otherwise(""))
    probability = F.when(rule | rate | (failed & closed), 1.0).when(
        attack | normal, F.col("p")).otherwise(0.0)
    one = F.lit(1.0)
    scores = F.when(rule, _scores(rule=one)).when(rate, _scores(rate=one))
    if models is not None:
        scores = scores.when(attack | normal, _scores(
            rate=F.bround("rate", 4), isolation_forest=F.bround("isolation_forest", 4),
            autoencoder=F.bround("autoencoder", 4), meta_lr=F.bround("p", 4)))
    scores = scores.otherwise(F.create_map().cast("map<string,double>"))
    return df.withColumns({
        "action": action, "layer": layer, "reason": reason, "probability": probability,
        "scores": scores, "rule_hits": rules.hit_ids("hits"),
        "categories": rules.categories("hits", rate), "degraded": no_model | failed,
    }).drop("_rule", "_rate", "_survives")


def enforced(settings: Settings = DEFAULTS, action="action", layer="layer") -> Column:
    """Certain verdicts are enforced in both enforcing modes, learned ones only in full."""
    if settings.mode == "monitor":
        return F.lit(False)
    block = F.coalesce(F.col(action) == "block", F.lit(False))
    learned = F.coalesce(F.col(layer).isin(*ML_LAYERS), F.lit(False))
    return block if settings.mode == "enforce" else block & ~learned


def would_block(action="action", layer="layer", flag="enforced") -> Column:
    return F.when((F.col(action) == "block") & ~F.col(flag), F.col(layer))


def response_status(settings: Settings = DEFAULTS, upstream="status", flag="enforced",
                    body_size="body_size") -> Column:
    return (F.when(F.col(body_size) > settings.max_body_bytes, 413)
            .when(F.col(flag), 403).otherwise(F.col(upstream)))


def enforce(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds enforced, would_block and the client-visible status; a decision made
    without counters is degraded too."""
    df = df.withColumn("enforced", enforced(settings))
    cols = {"would_block": would_block(), "status": response_status(settings)}
    if "rate_degraded" in df.columns:
        cols["degraded"] = F.col("degraded") | F.coalesce("rate_degraded", F.lit(False))
    return df.withColumns(cols)


def to_event_log(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The numeric log record: features and a hashed client, no request text."""
    features = F.create_map(*[x for n in FEATURE_NAMES for x in (
        F.lit(n), F.bround(F.col(n).cast("double"), 5))])
    has = set(df.columns)
    if not set(FEATURE_NAMES) <= has:
        df = df.withColumns(feature_columns(settings))
    label = F.col("label") if "label" in has else F.lit(None).cast("string")
    latency = F.col("latency_ms") if "latency_ms" in has else F.lit(None).cast("double")
    detect = F.col("detect_ms") if "detect_ms" in has else F.lit(None).cast("double")
    return df.select(
        scalars.epoch_seconds("ts").alias("ts"), scalars.hash_client("client").alias("client"),
        "method", "template", (F.length("path") if "path" in has else F.col("path_len").cast(
            "int")).alias("path_len"), "body_size",
        F.col("status").cast("int").alias("status"),
        F.col("window_count").cast("int").alias("window_count"),
        F.col("burst_count").cast("int").alias("burst_count"),
        F.bround(latency, 3).alias("latency_ms"), F.bround(detect, 3).alias("detect_ms"),
        "action", "enforced", "layer", F.substring("reason", 1, 200).alias("reason"),
        F.bround("probability", 4).alias("probability"), "scores", "rule_hits", "categories",
        "degraded", features.alias("features"),
        F.when(F.lit(settings.trust_label), label).alias("label"))
