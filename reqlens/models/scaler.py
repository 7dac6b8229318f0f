"""Standardisation with population spread.

A zero-variance column keeps scale 1, so a later deviation from its constant
stays visible. The library scaler outputs 0 there and would hide it.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mean, scale) in column order, from one aggregation."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns],
                 *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"),
                 F.when(F.col(f"s_{c}") > 1e-12, F.col(f"s_{c}")).otherwise(1.0).alias("scale"))
        for c in columns])).alias("r")).select("r.*")


def parameters(table: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """The one row per feature that the table holds, on the driver."""
    found = {r.feature: (r["mean"], r["scale"]) for r in table.collect()}
    return {c: found[c] for c in columns}


def scaled(params: dict[str, tuple[float, float]]) -> dict[str, Column]:
    """Column expressions with the parameters as literals."""
    return {c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(mean)) / F.lit(scale)
            for c, (mean, scale) in params.items()}


def scaled_vector(params: dict[str, tuple[float, float]]) -> Column:
    return F.array(*scaled(params).values())
