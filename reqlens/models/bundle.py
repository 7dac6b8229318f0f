"""The fitted model set, and the one function that scores rows with it."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlens.config import DEFAULTS, Settings
from reqlens.functions import scalars
from reqlens.functions.features import assemble
from reqlens.models.autoencoder import Network
from reqlens.models.forest import Forest
from reqlens.models.meta import Meta
from reqlens.operators.baseline import Baseline
from reqlens.schemas import BASE_SCORES, FEATURE_NAMES


@dataclass
class ModelSet:
    scaler: dict[str, tuple[float, float]]
    forest: Forest
    network: Network
    meta: Meta | None
    baseline: Baseline
    ranges: dict[str, tuple[float, float]]
    threshold: float
    feature_names: list[str]
    decision: dict


def check_contract(names: list[str]) -> None:
    """A model fitted on other features, or on another order, is refused."""
    if list(names) != FEATURE_NAMES:
        raise ValueError(
            f"feature contract mismatch: the model has {len(names)} features, "
            f"this build has {len(FEATURE_NAMES)}; retrain")


def raw_scores(df: DataFrame, scaler, forest: Forest, network: Network,
               when: Column | None = None) -> DataFrame:
    """Adds if_raw, ae_raw and error from the feature columns, in one crossing.

    Rows outside `when` are NULL vectors and skip the models. Rows with values
    that are not finite count as a ValueError. A batch that fails otherwise is
    halved until the failing rows stand alone, and only those carry an error.
    """
    mean = np.array([m for m, _ in scaler.values()])
    scale = np.array([s for _, s in scaler.values()])

    def evaluate(X, raw, names):
        try:
            # Models see the float32 vector that the feature contract promises.
            scaled = (X.astype(np.float32).astype(np.float64) - mean) / scale
            raw[:, 0], raw[:, 1] = forest.score(scaled), network.errors(scaled)
        except Exception as e:
            if len(X) == 1:
                names[0] = type(e).__name__
                return
            half = len(X) // 2
            evaluate(X[:half], raw[:half], names[:half])
            evaluate(X[half:], raw[half:], names[half:])

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            raw = np.full((len(x), 2), np.nan)
            names = np.full(len(x), None, dtype=object)
            live = np.flatnonzero(x.notna().to_numpy())
            if len(live):
                X = np.stack(x.iloc[live].to_numpy()).astype(float)
                finite = np.isfinite(X).all(axis=1)
                names[live[~finite]] = "ValueError"
                if finite.any():
                    got, failed = raw[live[finite]], names[live[finite]]
                    evaluate(X[finite], got, failed)
                    raw[live[finite]], names[live[finite]] = got, failed
            yield pd.DataFrame({
                "if_raw": pd.array(raw[:, 0], dtype="Float64"),
                "ae_raw": pd.array(raw[:, 1], dtype="Float64"), "error": names})

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(score, "if_raw double, ae_raw double, error string")
    vector = assemble(list(scaler))
    if when is not None:
        vector = F.when(when, vector)
    return df.withColumn("_s", udf(vector)).select(
        *df.columns, "_s.if_raw", "_s.ae_raw", F.col("_s.error").alias("error"))


def base_scores(df: DataFrame, ranges, settings: Settings = DEFAULTS,
                window="window_count", burst="burst_count") -> DataFrame:
    """Adds the meta-learner's inputs in [0, 1]: rate, isolation_forest, autoencoder."""
    return df.withColumns({
        "rate": scalars.rate_score(window, burst, settings),
        "isolation_forest": scalars.norm_score("if_raw", *ranges["if"]),
        "autoencoder": scalars.norm_score("ae_raw", *ranges["ae"])})


def score(df: DataFrame, models: ModelSet, settings: Settings = DEFAULTS,
          when: Column | None = None, window="window_count", burst="burst_count") -> DataFrame:
    """Adds raw scores, base scores, error and the probability `p`."""
    out = base_scores(raw_scores(df, models.scaler, models.forest, models.network, when),
                      models.ranges, settings, window, burst)
    return out.withColumn("p", models.meta.probability())


__all__ = ["BASE_SCORES", "ModelSet", "base_scores", "check_contract", "raw_scores", "score"]
