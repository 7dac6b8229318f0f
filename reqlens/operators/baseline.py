"""Per-endpoint baselines, drift between them, and the calibration gates."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqlens.config import DEFAULTS, Settings
from reqlens.functions import rules, scalars
from reqlens.schemas import ENDPOINT_BASELINE

SHARES = 16  # of a template's rows in the join


@dataclass(frozen=True)
class Baseline:
    """What is normal for one deployment. `endpoints` stays a DataFrame since it
    grows with the API; the rate statistics are three numbers."""
    endpoints: DataFrame
    rate_mean: float = 0.0
    rate_std: float = 0.0
    n_samples: int = 0
    ready: bool = False


def empty_baseline(spark) -> Baseline:
    return Baseline(spark.createDataFrame([], ENDPOINT_BASELINE))


def endpoint_baseline(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    size = F.coalesce(F.col("body_size"), F.lit(0)).cast("double")
    return df.groupBy("template").agg(
        F.avg(size).alias("body_mean"), F.stddev_pop(size).alias("body_std"),
        F.count(F.lit(1)).alias("count"),
    ).filter(F.col("count") >= settings.baseline_min_count)


def rate_baseline(df: DataFrame) -> DataFrame:
    """One row; n_samples counts every row, not only the kept endpoints' rows."""
    win = F.coalesce(F.col("win"), F.lit(0.0))
    return df.agg(F.coalesce(F.avg(win), F.lit(0.0)).alias("mean"),
                  F.coalesce(F.stddev_pop(win), F.lit(0.0)).alias("std"),
                  F.count(F.lit(1)).alias("n_samples"))


def build_baseline(df: DataFrame, settings: Settings = DEFAULTS) -> Baseline:
    endpoints = endpoint_baseline(df, settings)
    rate = rate_baseline(df).first()
    return Baseline(endpoints, rate["mean"], rate["std"], rate["n_samples"],
                    rate["n_samples"] > 0 and not endpoints.isEmpty())


def join_endpoints(df: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Left join on template. No broadcast hint: the baseline grows with the API,
    so its measured size decides. A template's rows are dealt over SHARES by hash, as an
    API of few templates would else keep as few tasks busy with all that follows."""
    keep = endpoints.select("template", "body_mean", "body_std", F.lit(True).alias("_known"))
    df = df.drop("body_mean", "body_std")
    told_apart = [c for c in ("event_id", "client", "ts", "path", "body_size") if c in df.columns]
    if not told_apart:
        return df.join(keep, "template", "left")
    df = df.withColumn("_share", F.pmod(F.xxhash64(*told_apart), F.lit(SHARES)))
    keep = keep.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SHARES - 1).cast("bigint"))))
    return df.join(keep, ["template", "_share"], "left").drop("_share")


def apply_baseline(df: DataFrame, baseline: Baseline) -> DataFrame:
    """Recomputes body_size_z, path_known and rate_z (from `win`, if present)."""
    out = join_endpoints(df, baseline.endpoints)
    size = F.coalesce(F.col("body_size"), F.lit(0)).cast("double")
    known = F.when(F.col("_known"), 1.0).otherwise(0.0 if baseline.ready else 1.0)
    cols = {"body_size_z": scalars.safe_z(size, "body_mean", "body_std"), "path_known": known}
    if "win" in df.columns:
        cols["rate_z"] = scalars.safe_z(
            F.coalesce(F.col("win"), F.lit(0.0)), F.lit(baseline.rate_mean),
            F.lit(baseline.rate_std)) if baseline.ready else F.lit(0.0)
    return out.withColumns(cols).drop("_known", "body_mean", "body_std")


def with_endpoint_stats(df: DataFrame, baseline: Baseline) -> DataFrame:
    """The join alone, as the feature expressions want it: body_mean, body_std
    and path_known."""
    out = join_endpoints(df, baseline.endpoints)
    return out.withColumn("path_known", F.when(F.col("_known"), 1.0).otherwise(
        0.0 if baseline.ready else 1.0)).drop("_known")


def novel_endpoints(df: DataFrame, endpoints: DataFrame) -> DataFrame:
    return df.join(endpoints.select("template"), "template", "left_anti")


def shared_endpoints(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.select("template").intersect(new.select("template"))


def new_endpoints(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.select("template").subtract(old.select("template"))


def contamination(df: DataFrame) -> DataFrame:
    blocked = F.coalesce(F.sum(rules.ids_block().cast("bigint")), F.lit(0))
    flagged = F.coalesce(F.sum((F.size("rule_hits") > 0).cast("bigint")), F.lit(0))
    n = F.count(F.lit(1))
    return df.agg(blocked.alias("blocked"), flagged.alias("flagged"), n.alias("n")).withColumn(
        "fraction", F.col("blocked") / F.greatest(F.lit(1), F.col("n")))


def rate_drift(old_rate: DataFrame, new_rate: DataFrame) -> DataFrame:
    """Shift of the mean rate in old standard deviations; NULL without spread."""
    old_mean, old_std = (old_rate.select(c).scalar() for c in ("mean", "std"))
    out = new_rate.select(F.col("mean").alias("new_mean"), old_mean.alias("old_mean"),
                          old_std.alias("old_std"))
    drift = F.when(F.col("old_std") > 0, F.abs(F.col("new_mean") - F.col("old_mean"))
                   / (F.col("old_std") + 1e-9))
    return out.withColumn("drift", drift).withColumn(
        "large", F.coalesce(F.col("drift") > 3, F.lit(False)))


def calibration_gates(facts: DataFrame, settings: Settings = DEFAULTS,
                      force: bool = False) -> DataFrame:
    """(gate, value, threshold, passed) from one row with n, fraction, threshold,
    median and previous. `force` lets every gate pass."""
    ok = F.lit(force)

    def gate(name, value, limit, passed):
        return F.struct(F.lit(name).alias("gate"), value.cast("double").alias("value"),
                        limit.cast("double").alias("threshold"),
                        (passed | ok).alias("passed"))

    c = F.col
    rise = c("previous") + 0.3
    return facts.select(F.explode(F.array(
        gate("samples", c("n"), F.lit(settings.calibration_min_samples),
             c("n") >= settings.calibration_min_samples),
        gate("contamination", c("fraction"), F.lit(settings.max_contamination),
             c("fraction") <= settings.max_contamination),
        gate("threshold_floor", c("threshold"), F.lit(0.2), c("threshold") >= 0.2),
        gate("median", c("median"), F.lit(0.5), c("median") < 0.5),
        gate("threshold_jump", c("threshold"), rise, c("threshold") <= rise),
    )).alias("g")).select("g.*")
