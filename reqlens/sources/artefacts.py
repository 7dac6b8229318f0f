"""Model artefacts as tables in immutable version directories.

<root>/<version>/<table> holds one version; <root>/CURRENT is a one-row table
naming the active one. Publishing writes a new version and then moves the
pointer, so older versions are the backups and readers never see half a model.
"""
from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.config import DEFAULTS, Settings
from reqlens.models.autoencoder import load_network, weights_table
from reqlens.models.bundle import ModelSet, check_contract
from reqlens.models.forest import load_forest
from reqlens.models.meta import load_meta
from reqlens.models.scaler import parameters
from reqlens.operators.baseline import Baseline, empty_baseline
from reqlens.schemas import (DECISION, ENDPOINT_BASELINE, FEATURE_NAMES, FOREST_META,
                             RATE_BASELINE, SCALER)


@dataclass(frozen=True)
class Store:
    root: str

    def at(self, version: str, table: str) -> str:
        return f"{self.root}/{version}/{table}"


def new_version() -> str:
    return time.strftime("%Y%m%d-%H%M%S") + f"-{time.time_ns() % 10**9:09d}"


def publish(spark: SparkSession, store: Store, version: str) -> None:
    """Appends to the pointer log; the newest row is the active version."""
    spark.createDataFrame([(version, time.time_ns())], "version string, at bigint").coalesce(
        1).write.mode("append").parquet(f"{store.root}/CURRENT")


def versions(spark: SparkSession, store: Store) -> DataFrame:
    return spark.read.schema("version string, at bigint").parquet(f"{store.root}/CURRENT")


def current_version(spark: SparkSession, store: Store) -> str | None:
    try:
        row = versions(spark, store).agg(F.max_by("version", "at").alias("v")).first()
    except AnalysisException:
        return None
    return row.v


def save_baseline(spark: SparkSession, store: Store, version: str, baseline: Baseline) -> None:
    baseline.endpoints.write.mode("overwrite").parquet(store.at(version, "endpoint_baseline"))
    spark.createDataFrame(
        [(float(baseline.rate_mean), float(baseline.rate_std), int(baseline.n_samples))],
        RATE_BASELINE).coalesce(1).write.mode("overwrite").parquet(store.at(version, "rate_baseline"))


def load_baseline(spark: SparkSession, store: Store, version: str | None) -> Baseline:
    """A version without a baseline has an empty one that is not ready. Any other
    failure to read is raised: it must not make every path look known."""
    if version is None:
        return empty_baseline(spark)
    try:
        endpoints = spark.read.schema(ENDPOINT_BASELINE).parquet(store.at(version, "endpoint_baseline"))
        rate = spark.read.schema(RATE_BASELINE).parquet(store.at(version, "rate_baseline")).first()
        return Baseline(endpoints, rate["mean"], rate["std"], rate["n_samples"],
                        rate["n_samples"] > 0 and not endpoints.isEmpty())
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty_baseline(spark)


def decision_frame(spark: SparkSession, decision: dict) -> DataFrame:
    blank = spark.createDataFrame([], DECISION)
    return spark.createDataFrame([tuple(decision.get(f) for f in blank.columns)], blank.schema)


def save_decision(spark: SparkSession, store: Store, version: str, decision: dict) -> None:
    decision_frame(spark, decision).coalesce(1).write.mode("overwrite").parquet(
        store.at(version, "decision"))


def load_decision(spark: SparkSession, store: Store, version: str) -> DataFrame:
    return spark.read.schema(DECISION).parquet(store.at(version, "decision"))


def save_models(spark: SparkSession, store: Store, version: str, models: dict) -> None:
    """`models`: scaler and nodes as DataFrames, sample, network and meta."""
    for name in ("scaler", "nodes"):
        models[name].write.mode("overwrite").parquet(store.at(version, name))
    spark.createDataFrame([(models["trees"], models["sample"])], FOREST_META).coalesce(
        1).write.mode("overwrite").parquet(store.at(version, "forest"))
    weights_table(spark, models["network"]).coalesce(1).write.mode("overwrite").parquet(
        store.at(version, "autoencoder"))
    models["meta"].table(spark).coalesce(1).write.mode("overwrite").parquet(
        store.at(version, "meta"))


def load_models(spark: SparkSession, store: Store, version: str | None = None,
                settings: Settings = DEFAULTS) -> ModelSet:
    """The active (or given) version. The feature contract is checked first, so a
    mismatch fails before any parameter is read."""
    version = version or current_version(spark, store)
    if version is None:
        raise FileNotFoundError(f"no published model under {store.root}")
    decision = load_decision(spark, store, version).first().asDict()
    check_contract(decision["feature_names"])
    source = decision.get("model_version") or version

    def read(table):
        return spark.read.parquet(store.at(source, table))

    sample = read("forest").first()["sample_size"]
    threshold = decision["threshold"]
    return ModelSet(
        scaler=parameters(spark.read.schema(SCALER).parquet(store.at(source, "scaler")), FEATURE_NAMES),
        forest=load_forest(read("nodes"), sample), network=load_network(read("autoencoder")),
        meta=load_meta(read("meta")), baseline=load_baseline(spark, store, version),
        ranges={"if": (decision["if_lo"], decision["if_hi"]),
                "ae": (decision["ae_lo"], decision["ae_hi"])},
        threshold=settings.fallback_threshold if threshold is None else threshold,
        feature_names=decision["feature_names"], decision=decision)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


class Reloader:
    """Resolves the active version per micro-batch and loads it when it changed."""

    def __init__(self, store: Store, settings: Settings = DEFAULTS):
        self.store, self.settings = store, settings
        self.version, self.models = None, None

    def get(self, spark: SparkSession) -> ModelSet | None:
        version = current_version(spark, self.store)
        if version is not None and version != self.version:
            self.models = load_models(spark, self.store, version, self.settings)
            self.version = version
        return self.models
