"""Training, paired comparison and multi-seed validation from an event log."""
from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.config import DEFAULTS, Settings
from reqlens.functions.features import from_map
from reqlens.models import autoencoder, forest, meta, scaler
from reqlens.models.bundle import ModelSet, base_scores, raw_scores
from reqlens.operators import baseline as bl
from reqlens.operators import eventlog, metrics
from reqlens.schemas import BASE_SCORES, FEATURE_NAMES, SEED_RUNS
from reqlens.session import cut
from reqlens.sources import artefacts

DETECTORS = {"rate": "rate", "iforest": "isolation_forest", "autoencoder": "autoencoder",
             "stack": "p"}


#: Copies of a row that one task numbers.
COPIES = 65_536


class PoolTooSmall(ValueError):
    pass


@dataclass
class Fitted:
    """Models fitted on the base pool and the other pools scored with them."""
    rows: DataFrame          # every labelled row with pool and l1
    patched: DataFrame       # pool rows with baseline-relative features
    scored: DataFrame        # meta, val and test rows with base scores and p
    baseline: bl.Baseline
    scaler_table: DataFrame
    nodes: DataFrame
    sample: int
    models: ModelSet
    pool_sizes: dict[str, int]

    def pool(self, name: str) -> DataFrame:
        return self.scored.filter(F.col("pool") == name)

    def settled_test(self) -> DataFrame:
        return self.rows.filter(F.col("l1") & (F.col("pool") == "test"))


def numbered(rows: DataFrame) -> DataFrame:
    """rows with row_id, a hash of their content and of a number among their copies:
    samples that hash it are uniform over rows, and don't depend on how the log is laid
    out. Copies are counted before the shuffle, and those of one row spread over tasks."""
    columns = rows.columns
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_hash", F.xxhash64(*columns))
    last = F.floor((F.col("_n") - 1) / COPIES)
    parts = counted.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition("_hash", "_part")
    start = F.col("_part") * COPIES
    copies = parts.withColumn("_copy", F.explode(F.sequence(start, F.least("_n", start + COPIES) - 1)))
    return copies.select(*columns, F.xxhash64("_hash", "_copy").alias("row_id"))


def prepare(log: DataFrame) -> DataFrame:
    """Labelled rows as narrow numeric columns, with row ids: what all seeds share."""
    rows = from_map(eventlog.labelled_rows(log)).select(
        "y", "family", "client", "template", "body_size", "win",
        F.coalesce("burst_count", F.lit(0)).alias("burst_count"), "l1", "by_rule", *FEATURE_NAMES)
    return cut(numbered(rows))


def fit(log: DataFrame, settings: Settings = DEFAULTS, seed: int | None = None,
        prepared: DataFrame | None = None) -> Fitted:
    """`prepared`: what prepare(log) returned, if it is at hand."""
    seed = settings.seed if seed is None else seed
    rows = eventlog.with_pool(prepare(log) if prepared is None else prepared, seed)
    pools = eventlog.training_pool(rows, settings)
    sizes = {r.pool: r.n for r in metrics.pool_counts(pools).collect()}
    sizes = {p: sizes.get(p, 0) for p in ("base", "meta", "val", "test")}
    if min(sizes.values()) < settings.min_pool_rows:
        raise PoolTooSmall(f"a pool is too small to train on: {sizes}")

    # Every pool gets features relative to a baseline from the base pool only.
    baseline = bl.build_baseline(pools.filter(F.col("pool") == "base"), settings)
    patched = cut(bl.apply_baseline(pools, baseline))
    base = patched.filter(F.col("pool") == "base")

    scaler_table = scaler.fit_scaler(base, FEATURE_NAMES)
    params = scaler.parameters(scaler_table, FEATURE_NAMES)
    vector = scaler.scaled_vector(params)
    nodes, sample = forest.fit_forest(base, vector, "row_id", settings.forest_trees,
                                      settings.forest_samples, seed)
    nodes = cut(nodes)
    trees = forest.load_forest(nodes, sample)
    network, _ = autoencoder.fit_autoencoder(base, vector, "row_id", settings, seed)

    raw = cut(raw_scores(patched, params, trees, network))
    ranges = metrics.score_range(raw.filter(F.col("pool") == "base"),
                                 {"if": "if_raw", "ae": "ae_raw"})
    scored = base_scores(raw.filter(F.col("pool") != "base"), ranges, settings,
                         window="win", burst="burst_count")
    learner = meta.fit_meta(scored.filter(F.col("pool") == "meta"), BASE_SCORES)
    scored = scored.withColumn("p", learner.probability())
    models = ModelSet(params, trees, network, learner, baseline, ranges,
                      settings.fallback_threshold, list(FEATURE_NAMES), {})
    return Fitted(rows, patched, scored, baseline, scaler_table, nodes, sample, models, sizes)


@dataclass
class TrainReport:
    decision: dict
    fitted: Fitted
    frames: dict[str, DataFrame]
    notes: list[str]
    version: str | None = None


def train(log: DataFrame, settings: Settings = DEFAULTS, seed: int | None = None,
          store: artefacts.Store | None = None, prepared: DataFrame | None = None) -> TrainReport:
    """Fit, choose the threshold on validation, evaluate once on test, persist."""
    seed = settings.seed if seed is None else seed
    fitted = fit(log, settings, seed, prepared)
    duplicates = metrics.duplication(fitted.rows).first()
    picked = metrics.pick_threshold(fitted.pool("val"), settings.target_fpr, score="p").first()

    test = fitted.pool("test").withColumn("pred", (F.col("p") >= picked.threshold).cast("int"))
    settled = fitted.settled_test()
    frames = {
        "test": test, "variance": metrics.feature_variance(
            fitted.patched.filter(F.col("pool") == "base")),
        "skew": metrics.skew_check(fitted.patched), "l1": metrics.l1_partition(fitted.rows),
        "families": metrics.family_recall(test, settled, settings).orderBy("family"),
        "pipeline": metrics.pipeline_metrics(test, settled),
        "zero_day": metrics.zero_day_recall(test, settings),
    }
    quality = metrics.metrics(test).first().asDict()
    ranking = metrics.ranking_metrics(test, "p").first()
    zero_day = frames["zero_day"].first().zero_day_recall

    notes = []
    if duplicates.n < 2000:
        notes.append("very small corpus; results will be noisy")
    if duplicates.warn:
        notes.append("heavy duplication; metrics will be optimistic")
    if not picked.feasible:
        notes.append("no threshold meets the false-positive budget; 0.5 used")
    notes += [f"{n} counts strongly against attacks" for n in fitted.models.meta.warnings]

    def places(value):
        return None if value is None else round(float(value), 4)

    ranges = fitted.models.ranges
    decision = {
        "version": 3, "trained_at": time.strftime("%Y-%m-%dT%H:%M:%S"), "seed": seed,
        "feature_names": list(FEATURE_NAMES), "threshold": picked.threshold,
        "if_lo": ranges["if"][0], "if_hi": ranges["if"][1],
        "ae_lo": ranges["ae"][0], "ae_hi": ranges["ae"][1],
        "meta_inputs": list(BASE_SCORES), "pool_sizes": fitted.pool_sizes,
        "novel_families": sorted(settings.novel_families),
        "test_metrics": {k: places(v) for k, v in quality.items()},
        "test_roc_auc": places(ranking.roc_auc), "test_pr_auc": places(ranking.pr_auc),
        "zero_day_recall": places(zero_day), "unique_feature_ratio": places(duplicates.ratio),
    }
    report = TrainReport(decision, fitted, frames, notes)
    if store is not None:
        report.version = persist(log.sparkSession, store, fitted, decision)
    return report


def persist(spark: SparkSession, store: artefacts.Store, fitted: Fitted, decision: dict) -> str:
    version = artefacts.new_version()
    artefacts.save_models(spark, store, version, {
        "scaler": fitted.scaler_table, "nodes": fitted.nodes,
        "trees": len(fitted.models.forest.roots), "sample": fitted.sample,
        "network": fitted.models.network, "meta": fitted.models.meta})
    artefacts.save_baseline(spark, store, version, fitted.baseline)
    artefacts.save_decision(spark, store, version, {**decision, "model_version": version})
    artefacts.publish(spark, store, version)
    return version


def compare(fitted: Fitted, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(metrics per detector, paired tests of the stack against each single one).

    Every detector gets its threshold on validation under the same budget, and
    all predictions are columns of the same test row, so pairing needs no join.
    """
    val, test = fitted.pool("val"), fitted.pool("test")
    preds, thresholds = {}, {}
    for name, column in DETECTORS.items():
        t = metrics.pick_threshold(val, settings.target_fpr, score=column).first().threshold
        thresholds[name] = t
        preds[name] = (F.col(column) >= t).cast("int")
    wide = test.select("y", *[p.alias(n) for n, p in preds.items()])

    long = wide.select("y", F.explode(F.array(*[
        F.struct(F.lit(n).alias("model"), F.lit(thresholds[n]).alias("threshold"),
                 F.col(n).alias("pred")) for n in preds])).alias("m")).select("y", "m.*")
    table = metrics.metrics(long, "model", "threshold")

    right = wide.select(*[(F.col(n) == F.col("y")).alias(n) for n in preds])
    counts = [metrics.paired_discordance(right, "stack", n).withColumn(
        "pair", F.lit(f"stack_vs_{n}")) for n in preds if n != "stack"]
    pairs = counts[0].unionByName(counts[1]).unionByName(counts[2])
    tests = metrics.with_mcnemar(pairs).withColumn("verdict", metrics.verdict())
    return table, tests


def seed_runs(log: DataFrame, seeds=range(1, 11), settings: Settings = DEFAULTS) -> DataFrame:
    """A row per seed: its test results, or why its split could not be trained (failure).
    The log is prepared once; anything but a pool that is too small is raised."""
    prepared, runs = prepare(log), []
    for seed in seeds:
        try:
            d = train(log, settings, seed, prepared=prepared).decision
        except PoolTooSmall as failure:
            runs.append((seed, *[None] * 7, str(failure)))
            continue
        m = d["test_metrics"]
        runs.append((seed, m["f1"], m["recall"], m["precision"], m["fpr"],
                     d["test_roc_auc"], d["test_pr_auc"], d["zero_day_recall"], None))
    return log.sparkSession.createDataFrame(runs, SEED_RUNS + ", failure STRING")


def validate(log: DataFrame, seeds=range(1, 11), settings: Settings = DEFAULTS,
             n_boot: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(runs, summary with bootstrap intervals). Retrains per seed; seeds whose split
    cannot be trained are listed with the reason and left out of the summary; fewer than
    two successful runs are refused."""
    table = seed_runs(log, seeds, settings)
    good = table.filter("failure IS NULL").drop("failure")
    if good.count() < 2:
        raise ValueError("not enough successful runs for statistics")
    summary = metrics.seed_summary(good).join(
        metrics.seed_intervals(good, n_boot=n_boot), "metric", "left")
    return table, summary
