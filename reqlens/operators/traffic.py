"""Traffic summaries over the event log and over test-load results."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reqlens.operators import eventlog
from reqlens.operators.running import percentiles_by, usable


def _ones(condition):
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("bigint")


def traffic_stats(df: DataFrame) -> DataFrame:
    """(layer, n): enforced blocks per layer, and rows 'total', 'allowed' and
    'blocked', from one aggregation."""
    layer = F.coalesce("layer", F.lit(""))
    hit = F.coalesce("enforced", F.lit(False))
    counts = df.groupBy(hit.alias("hit"), F.when(hit, layer).alias("layer")).agg(
        F.count(F.lit(1)).alias("n"))

    def row(kind, name):
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"))

    shown = F.array_compact(F.array(
        row("stat", F.lit("total")),
        row("stat", F.when(F.col("hit"), "blocked").otherwise("allowed")),
        F.when(F.col("hit"), row("layer", F.col("layer")))))
    return counts.select(F.explode(shown).alias("k"), "n").groupBy("k.kind", "k.name").agg(
        F.sum("n").alias("n"))


def headline(df: DataFrame) -> DataFrame:
    blocked = F.col("action") == "block"
    out = df.agg(F.count(F.lit(1)).alias("requests"), _ones(blocked).alias("flagged"),
                 _ones(F.col("enforced")).alias("enforced"),
                 _ones(F.col("degraded")).alias("degraded"))
    return out.withColumns({
        "flagged_pct": 100 * F.col("flagged") / F.greatest(F.lit(1), F.col("requests")),
        "allowed": F.col("requests") - F.col("enforced")})


def blocks_by_layer(df: DataFrame) -> DataFrame:
    return eventlog.blocked_only(df).groupBy(eventlog.decided_by().alias("decided_by")).agg(
        F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "decided_by")


def category_counts(df: DataFrame) -> DataFrame:
    return df.select(F.explode("categories").alias("category")).groupBy("category").agg(
        F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")


def mean_evidence(df: DataFrame) -> DataFrame:
    """Means of the base scores over requests the models decided."""
    return eventlog.ml_decided(eventlog.flatten_scores(df)).agg(
        *[F.avg(c).alias(c) for c in ("rate", "isolation_forest", "autoencoder")])


def latency_summary(df: DataFrame, columns=("detect_ms", "latency_ms")) -> DataFrame:
    """describe() with 50/95/99 %: one row per column, exact percentiles. NaN counts
    as missing. Percentiles and moments each come from one aggregation of all columns."""
    names = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    stats = df.agg(*[F.struct(
        F.count(usable(F.col(c))).alias("count"), F.avg(usable(F.col(c))).alias("mean"),
        F.stddev_samp(usable(F.col(c))).alias("std"), F.min(usable(F.col(c))).alias("min"),
        F.max(usable(F.col(c))).alias("max")).alias(c) for c in columns])
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])
    stats = stats.select(F.explode(parts).alias("r")).select("r.column", "r.s.*")
    return stats.join(percentiles_by(df, columns, names), "column")


def latency_sketch(df: DataFrame, columns=("detect_ms", "latency_ms"),
                   accuracy: int = 10_000) -> DataFrame:
    """The same shape in one pass with approximate percentiles."""
    out = None
    row = df.agg(*[F.struct(
        F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"), F.max(c).alias("max"),
        F.percentile_approx(c, [0.5, 0.95, 0.99], accuracy).alias("p")).alias(c) for c in columns])
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])
    out = row.select(F.explode(parts).alias("r")).select(
        "r.column", "r.s.count", "r.s.mean", "r.s.std", "r.s.min", "r.s.max",
        *[F.element_at("r.s.p", i + 1).alias(n) for i, n in enumerate(("p50", "p95", "p99"))])
    return out


def traffic_series(df: DataFrame, time: str = "time", seconds: int = 5) -> DataFrame:
    """(bin, allowed, blocked) per time bin, empty bins included as zeros.

    The spine grows in two steps, hours and then the bins of an hour, so a long
    log's bins are made by many tasks and never held in one row.
    """
    width = f"{seconds} seconds"
    bins = df.groupBy(F.window(time, width).start.alias("bin")).agg(
        _ones(F.col("action") == "allow").alias("allowed"),
        _ones(F.col("action") == "block").alias("blocked"))
    first, last = (F.floor(F.unix_seconds(edge) / seconds) * seconds
                   for edge in (F.min(time), F.max(time)))
    edges = df.agg(first.alias("first"), last.alias("last"))
    step = seconds * 720
    starts = F.sequence("first", "last", F.lit(step).cast("bigint"))
    inner = F.sequence(F.col("at"), F.least(F.col("at") + (step - seconds), F.col("stop")),
                       F.lit(seconds).cast("bigint"))
    spine = (edges.filter(F.col("first").isNotNull())
             .select(F.explode(starts).alias("at"), F.col("last").alias("stop"))
             .repartition("at").select(F.explode(inner).alias("s"))
             .select(F.timestamp_seconds("s").alias("bin")))
    return spine.join(bins, "bin", "left").fillna(0, ["allowed", "blocked"])


def clean_load_fpr(df: DataFrame) -> DataFrame:
    """On attack-free traffic every 403 is a false positive: per status its
    count, and the false-positive rate over everything sent."""
    every = Window.partitionBy()  # over a row per status
    counts = df.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    wrong = F.coalesce(F.sum(F.when(F.col("status") == 403, F.col("n"))).over(every), F.lit(0))
    return counts.withColumn("fpr", wrong / F.greatest(F.lit(1), F.sum("n").over(every)))


def with_verdict(df: DataFrame) -> DataFrame:
    """Test-load verdict per request, from kind ('normal' or 'attack'), status
    and error. Blocked means status 403."""
    blocked = F.coalesce(F.col("status") == 403, F.lit(False))
    normal = F.col("kind") == "normal"
    return df.withColumns({"blocked": blocked, "verdict": (
        F.when(F.coalesce("error", F.lit(False)), "ERROR")
        .when(normal & blocked, "FALSE POS").when(normal, "OK")
        .when(blocked, "BLOCKED").otherwise("MISSED"))})


def detection_by_category(df: DataFrame) -> DataFrame:
    return with_verdict(df).filter(F.col("kind") == "attack").groupBy("category").agg(
        F.count(F.lit(1)).alias("total"), _ones(F.col("blocked")).alias("blocked")).withColumn(
        "rate", F.col("blocked") / F.col("total"))


def load_summary(df: DataFrame) -> DataFrame:
    """One row over a test load: clients, mean duration, errors, requests per
    second between the first and last request."""
    span = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("n"), F.count_distinct("client").alias("clients"),
        F.avg("latency_ms").alias("mean_ms"), _ones(F.col("error")).alias("errors"),
        (n / F.greatest(F.lit(1.0), span)).alias("per_second"))


def load_counts(df: DataFrame) -> DataFrame:
    """Counts by label kind (text before ':') and by status, as (name, n)."""
    kind = F.substring_index("label", ":", 1)
    status = F.concat(F.lit("http_"), F.col("status").cast("string"))
    return df.select(F.explode(F.array(kind, status)).alias("name")).filter(
        F.col("name").isNotNull()).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def model_summary(decision: DataFrame) -> DataFrame:
    m = F.col("test_metrics")
    return decision.select(
        "trained_at", "threshold", F.size("feature_names").alias("n_features"),
        *[F.try_element_at(m, F.lit(k)).alias(f"test_{k}") for k in ("f1", "recall", "fpr")],
        "zero_day_recall")
