"""Detector evaluation: confusion metrics, ranking metrics, thresholds, tests."""
from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqlens.config import DEFAULTS, Settings
from reqlens.functions import scalars
from reqlens.operators import eventlog
from reqlens.operators.running import cumulative_by_value, percentiles, percentiles_by
from reqlens.schemas import FEATURE_NAMES

# The threshold grid 0.02, 0.025, ... 0.985 with its float steps.
GRID_START = 0.02
GRID_STEP = (GRID_START + 0.005) - GRID_START
GRID_SIZE = 194

RUN_METRICS = ["f1", "recall", "precision", "fpr", "roc_auc", "pr_auc", "zero_day_recall"]


def _ones(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("bigint")


def ratio(top, bottom) -> Column:
    """top / bottom, 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


# ── confusion ────────────────────────────────────────────────────────────────

def confusion_aggs(y="y", pred="pred") -> list[Column]:
    # A row without a prediction was not flagged.
    y, p = F.col(y), F.coalesce(F.col(pred), F.lit(0))
    return [_ones((p == 1) & (y == 1)).alias("tp"), _ones((p == 0) & (y == 0)).alias("tn"),
            _ones((p == 1) & (y == 0)).alias("fp"), _ones((p == 0) & (y == 1)).alias("fn")]


def with_metrics(df: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall, f1, fpr and fnr to tp, tn, fp, fn."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    df = df.withColumns({
        "accuracy": (tp + tn) / F.greatest(F.lit(1), tp + tn + fp + fn),
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "fpr": ratio(fp, fp + tn), "fnr": ratio(fn, fn + tp)})
    # From the counts: equal ones are equal numbers, which the harmonic mean of ratios isn't.
    return df.withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))


def metrics(df: DataFrame, *by: str, y="y", pred="pred") -> DataFrame:
    return with_metrics(df.groupBy(*by).agg(*confusion_aggs(y, pred)))


def pipeline_metrics(scored: DataFrame, settled: DataFrame) -> DataFrame:
    """Metrics over model-scored rows plus rows settled before any model."""
    return metrics(scored.select("y", "pred").unionByName(
        settled.select("y", F.lit(1).alias("pred"))))


# ── ranking ──────────────────────────────────────────────────────────────────

def scored(score) -> Column:
    """The score, NULL where there is none or it is not a number."""
    score = (F.col(score) if isinstance(score, str) else score).cast("double")
    return F.when(~F.isnan(score), score)


def unscored(df: DataFrame, score="score") -> DataFrame:
    """One row: rows in all, and rows without a usable score. Everywhere below,
    such a row is one that no threshold flags: it ranks under every score."""
    return df.agg(F.count(F.lit(1)).alias("n"), _ones(scored(score).isNull()).alias("unscored"))


def _by_score(df: DataFrame, score: str, y: str) -> DataFrame:
    last = F.lit(float("-inf"))
    return cumulative_by_value(df.select(F.coalesce(scored(score), last).alias("score"), F.col(y).alias("y")),
                               "score", {"pos": (F.col("y") == 1).cast("bigint"),
                                         "neg": (F.col("y") == 0).cast("bigint")}, descending=True)


def ranking_metrics(df: DataFrame, score="score", y="y") -> DataFrame:
    """One row: exact roc_auc (ties averaged) and average precision (step sum);
    NaN where only one class is present."""
    c = F.col
    area = F.sum(c("neg") * (c("cum_pos") - c("pos") / 2)) / (F.sum("pos") * F.sum("neg"))
    steps = F.sum(c("pos") * c("cum_pos") / (c("cum_pos") + c("cum_neg"))) / F.sum("pos")
    both = (F.sum("pos") > 0) & (F.sum("neg") > 0)
    nan = F.lit(float("nan"))
    return _by_score(df, score, y).agg(
        F.when(both, area).otherwise(nan).alias("roc_auc"),
        F.when(both, steps).otherwise(nan).alias("pr_auc"))


def roc_auc(df: DataFrame, score="score", y="y") -> DataFrame:
    return ranking_metrics(df, score, y).select("roc_auc")


def average_precision(df: DataFrame, score="score", y="y") -> DataFrame:
    return ranking_metrics(df, score, y).select("pr_auc")


# ── thresholds ───────────────────────────────────────────────────────────────

def _grid_value(i: Column) -> Column:
    return F.lit(GRID_START) + i * F.lit(GRID_STEP)


def _steps_reached(score: Column) -> Column:
    """How many grid thresholds are <= score. The division is only a guess that
    the comparisons with real grid values correct."""
    guess = F.floor((score - GRID_START) / GRID_STEP)
    steps = (F.when(score >= _grid_value(guess + 1), guess + 2)
             .when(score >= _grid_value(guess), guess + 1).otherwise(guess))
    reached = F.greatest(F.lit(0), F.least(F.lit(GRID_SIZE), steps)).cast("int")
    return F.when(scored(score).isNull(), 0).otherwise(reached)


def threshold_sweep(df: DataFrame, score="score", y="y") -> DataFrame:
    """Metrics at every grid threshold (predict 1 where score >= t), from one
    pass: rows collapse to 195 step counts, which accumulate from the top."""
    spark = df.sparkSession
    hits = df.select(_steps_reached(F.col(score)).alias("step"), F.col(y).alias("y")).groupBy(
        "step").agg(_ones(F.col("y") == 1).alias("pos"), _ones(F.col("y") == 0).alias("neg"))
    grid = spark.range(GRID_SIZE + 1, numPartitions=1).select(F.col("id").cast("int").alias("step"))
    full = grid.join(hits, "step", "left").fillna(0, ["pos", "neg"])
    above = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy(F.desc("step")).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    full = full.withColumns({
        "tp": F.sum("pos").over(above), "fp": F.sum("neg").over(above),
        "_p": F.sum("pos").over(every), "_n": F.sum("neg").over(every)})
    full = full.filter(F.col("step") > 0).select(
        (F.col("step") - 1).alias("i"), _grid_value(F.col("step") - 1).alias("threshold"),
        "tp", (F.col("_n") - F.col("fp")).alias("tn"), "fp",
        (F.col("_p") - F.col("tp")).alias("fn"))
    return with_metrics(full)


def pick_threshold(df: DataFrame, budget: float | None = None, score="score",
                   y="y") -> DataFrame:
    """One row (threshold, f1, feasible): highest F1 within the false-positive
    budget, lowest threshold on ties; (0.5, 0, false) where none has F1 > 0."""
    sweep = threshold_sweep(df, score, y).filter(F.col("f1") > 0)
    if budget is not None:
        sweep = sweep.filter(F.col("fpr") <= budget)
    best = sweep.agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("i"))).alias("b"))
    return best.select(
        F.coalesce("b.threshold", F.lit(0.5)).alias("threshold"),
        F.coalesce("b.f1", F.lit(0.0)).alias("f1"), F.col("b").isNotNull().alias("feasible"))


def score_range(df: DataFrame, columns: dict[str, str]) -> dict[str, tuple[float, float]]:
    """(1st, 99.5th percentile) per score column; columns maps name -> column."""
    rows = percentiles_by(df, sorted(set(columns.values())), {"lo": 0.01, "hi": 0.995}).collect()
    found = {r["column"]: (r.lo, r.hi) for r in rows}
    return {name: found[column] for name, column in columns.items()}


def calibrated_threshold(df: DataFrame, fpr: float, p="p") -> DataFrame:
    """One row (threshold, would_block): the (1-fpr) percentile kept in
    [0.05, 0.999], and the share of rows at or above it."""
    threshold = percentiles(df, p, {"t": 1.0 - fpr}).select(
        F.least(F.lit(0.999), F.greatest(F.lit(0.05), F.col("t"))).alias("t")).scalar()
    return df.agg(F.max(threshold).alias("threshold"),
                  F.avg(F.when(F.col(p) >= threshold, 1.0).otherwise(0.0)).alias("would_block"))


def score_distribution(df: DataFrame, p="p") -> DataFrame:
    return percentiles(df, p, {"p50": 0.5, "p95": 0.95, "p99": 0.99, "max": 1.0})


def saturation(df: DataFrame, would_block: Column, fpr: float, p="p") -> DataFrame:
    """Share at the very top, and whether no threshold can meet the budget."""
    return df.agg(F.avg(F.when(F.col(p) >= 0.999, 1.0).otherwise(0.0)).alias("ceiling"),
                  F.max(would_block).alias("would_block")).withColumn(
        "unreachable", F.col("would_block") > 2 * fpr)


# ── training-data checks ─────────────────────────────────────────────────────

def pool_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("pool").agg(F.count(F.lit(1)).alias("n"), _ones(F.col("y") == 1).alias("attacks"))


def duplication(df: DataFrame, columns=FEATURE_NAMES) -> DataFrame:
    """Distinct vectors among all; heavy duplication makes metrics optimistic."""
    out = df.select(scalars.vector_signature(columns).alias("sig")).groupBy("sig").agg(
        F.count(F.lit(1)).alias("k")).agg(
        F.count(F.lit(1)).alias("distinct_vectors"), F.coalesce(F.sum("k"), F.lit(0)).alias("n"))
    return out.withColumns({
        "ratio": F.col("distinct_vectors") / F.greatest(F.lit(1), F.col("n")),
        "warn": F.col("distinct_vectors") < 0.2 * F.col("n")})


def l1_partition(df: DataFrame) -> DataFrame:
    """What the deterministic layer settled: attacks, false positives, cause."""
    l1 = F.col("l1")
    out = df.agg(_ones(l1).alias("settled"), _ones(l1 & (F.col("y") == 1)).alias("attacks"),
                 _ones(l1 & F.col("by_rule")).alias("by_rule"), _ones(~l1).alias("reach_ml"))
    return out.withColumns({"false_positives": F.col("settled") - F.col("attacks"),
                            "by_rate": F.col("settled") - F.col("by_rule")})


def _long(row: DataFrame, columns, stats: dict[str, str]) -> DataFrame:
    """One row of <stat>_<column> values -> one row per column."""
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), *[F.col(f"{s}_{c}").alias(name)
                                              for s, name in stats.items()])
        for c in columns])).alias("r")).select("r.*")


def feature_variance(df: DataFrame, columns=FEATURE_NAMES) -> DataFrame:
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns],
                 *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    std = F.col("std")
    return _long(row, columns, {"m": "mean", "s": "std"}).withColumn(
        "status", F.when(std < 1e-12, "dead").when(std < 0.01, "near-constant").otherwise("ok"))


def skew_check(df: DataFrame, columns=("rate_z", "body_size_z", "path_known")) -> DataFrame:
    return feature_variance(df, columns).select(
        "feature", "mean", "std", (F.col("std") < 1e-9).alias("constant"))


# ── families ─────────────────────────────────────────────────────────────────

def family_recall(scored: DataFrame, settled: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Per attack family: what the model saw and caught, what was settled before
    it, and the recall of both together."""
    seen = scored.filter(F.col("y") == 1).groupBy("family").agg(
        F.count(F.lit(1)).alias("ml_n"), F.sum("pred").alias("_caught"),
        F.avg("pred").alias("ml_recall"))
    early = settled.filter(F.col("y") == 1).groupBy("family").agg(
        F.count(F.lit(1)).alias("l1_caught"))
    out = seen.join(early, "family", "full_outer").fillna(0, ["ml_n", "_caught", "l1_caught"])
    return out.select(
        "family", "ml_n", "ml_recall", "l1_caught",
        ((F.col("_caught") + F.col("l1_caught"))
         / F.greatest(F.lit(1), F.col("ml_n") + F.col("l1_caught"))).alias("pipeline_recall"),
        eventlog.is_novel(settings).alias("novel"))


def zero_day_recall(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    novel = eventlog.is_novel(settings)
    attack = F.col("y") == 1
    return df.agg(F.avg(F.when(attack & novel, F.col("pred"))).alias("zero_day_recall"),
                  F.avg(F.when(attack & ~novel, F.col("pred"))).alias("known_recall"))


def best_single(df: DataFrame, order=("rate", "iforest", "autoencoder"),
                stack: str = "stack") -> DataFrame:
    """From (model, f1): the best single detector, the first in `order` on ties,
    and whether the stack beats it."""
    single = F.col("model") != stack
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    return df.agg(
        F.max_by("model", F.when(single, F.struct(F.col("f1"), -place))).alias("best"),
        F.max(F.when(single, F.col("f1"))).alias("best_f1"),
        F.max(F.when(~single, F.col("f1"))).alias("stack_f1"),
    ).withColumn("stack_wins", F.col("stack_f1") > F.col("best_f1"))


# ── statistics ───────────────────────────────────────────────────────────────

def paired_discordance(df: DataFrame, a: str, b: str, by=()) -> DataFrame:
    """(n01, n10): rows only `a` gets right, rows only `b` gets right; per group of `by`."""
    a, b = F.col(a), F.col(b)
    return df.groupBy(*by).agg(_ones(a & ~b).alias("n01"), _ones(~a & b).alias("n10"))


def mcnemar_p(n01: int, n10: int) -> float:
    n = n01 + n10
    if n == 0:
        return 1.0
    if n < 25:
        tail = sum(math.comb(n, k) for k in range(min(n01, n10) + 1))
        return min(1.0, 2 * tail / 2 ** n)
    return math.erfc(math.sqrt((abs(n01 - n10) - 1) ** 2 / n / 2))


def with_mcnemar(df: DataFrame) -> DataFrame:
    """Adds p, method and significant to rows with n01 and n10."""
    def p_values(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([mcnemar_p(int(x), int(y)) for x, y in zip(a, b)], dtype="float64")

    n = F.col("n01") + F.col("n10")
    # Names of the methods, and below of the verdicts.
    return df.withColumns({
        "p": F.pandas_udf(p_values, "double")("n01", "n10"),
        "method": F.when(n == 0, "no discordant pairs").when(n < 25, "exact binomial").otherwise(
            "chi-square with continuity correction"),
    }).withColumn("significant", (n > 0) & (F.col("p") < 0.05))


def mcnemar(df: DataFrame, a: str, b: str) -> DataFrame:
    return with_mcnemar(paired_discordance(df, a, b))


def verdict() -> Column:
    """From n01, n10 and significant, with the stack as `a`."""
    return (F.when(F.col("significant") & (F.col("n01") > F.col("n10")),
                   "stack significantly better")
            .when(F.col("significant"), "single detector significantly better")
            .otherwise("no significant difference"))


def _poisson(mean_one: int = 18) -> list[float]:
    """The distribution function of a Poisson number of mean 1, up to double precision."""
    return [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(mean_one)]


SINGLE_COPIES = 32  # equal values up to which each has a draw of its own


def bootstrap_ci(values: DataFrame, column: str, n_boot: int = 10_000, alpha: float = 0.05,
                 seed: int = 0) -> DataFrame:
    """One row (mean, ci_low, ci_high, n) for the mean of a column, of any number of rows.

    A Poisson bootstrap: in each replicate a value counts a Poisson number of times, drawn
    from a hash of value and replicate, and replicates are weighted means, summed map-side.
    Nothing is numbered, joined or ordered, and results repeat exactly on any layout. Equal
    values are one row with their count; beyond SINGLE_COPIES of them their common number
    is drawn at once, from the normal approximation. Nulls don't count; fewer than two
    values give NaN bounds.
    """
    values = values.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    copies = F.when(F.col("c") <= SINGLE_COPIES, F.sequence(F.lit(1), F.col("c").cast("int"))).otherwise(
        F.array(F.lit(0)))
    rows = values.groupBy("v").agg(F.count(F.lit(1)).alias("c")).select("v", "c", F.explode(copies).alias("copy"))
    draws = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("replicate"))

    def uniform(salt: int) -> Column:
        return (F.shiftrightunsigned(F.xxhash64("v", "copy", "replicate", F.lit(seed), F.lit(salt)), 11) + 0.5) * 2.0 ** -53

    draws = draws.withColumns({"u": uniform(0), "w": uniform(1)})
    single = F.lit(0)
    for step in _poisson():
        single = single + (F.col("u") >= step).cast("int")
    normal = F.sqrt(-2 * F.log("u")) * F.cos(2 * math.pi * F.col("w"))
    many = F.greatest(F.lit(0.0), F.round(F.col("c") + F.sqrt("c") * normal))
    draws = draws.withColumn("k", F.when(F.col("copy") > 0, single.cast("double")).otherwise(many))
    means = draws.groupBy("replicate").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("v")).alias("s"))
    means = means.filter("k > 0").select((F.col("s") / F.col("k")).alias("m"))
    bounds = percentiles(means, "m", {"low": alpha / 2, "high": 1 - alpha / 2})
    n = F.count("v")
    return values.agg(F.avg("v").alias("mean"),
                      *[F.when(n < 2, F.lit(float("nan"))).otherwise(F.max(bounds.select(name).scalar())).alias(
                          f"ci_{name}") for name in ("low", "high")],
                      n.alias("n"))


def seed_summary(runs: DataFrame, columns=RUN_METRICS) -> DataFrame:
    """Per metric: mean, minimum, maximum and count over runs that have it."""
    long = runs.unpivot([], [F.col(c) for c in columns], "metric", "value")
    return long.filter(F.col("value").isNotNull()).groupBy("metric").agg(
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.count("value").alias("n"))


def seed_intervals(runs: DataFrame, columns=RUN_METRICS, n_boot: int = 10_000) -> DataFrame:
    """Bootstrap interval per metric."""
    parts = [bootstrap_ci(runs, c, n_boot).select(F.lit(c).alias("metric"), "ci_low", "ci_high")
             for c in columns]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
