"""SQL names for the functions that Spark SQL does not have."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from reqlens.functions import text


def register(spark: SparkSession) -> None:
    """payload_decode, payload_normalize, payload_canonical and text_entropy."""
    spark.udf.register("payload_decode", text.url_decode_udf())
    spark.udf.register("payload_normalize", text.normalize_udf())
    spark.udf.register("payload_canonical", text.canonical_udf())
    spark.udf.register("text_entropy", text.entropy_udf())


def register_models(spark: SparkSession, models) -> None:
    """iforest_score and ae_score over a scaled array<double> vector."""
    forest, network = models.forest, models.network

    def isolation(x: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

    def reconstruction(x: pd.Series) -> pd.Series:
        return pd.Series(network.errors(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

    spark.udf.register("iforest_score", F.pandas_udf(isolation, "double"))
    spark.udf.register("ae_score", F.pandas_udf(reconstruction, "double"))
