"""Logistic-regression meta-learner over the base scores: the only decider."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlens.schemas import BASE_SCORES


@dataclass(frozen=True)
class Meta:
    intercept: float
    coefficients: dict[str, float]

    @property
    def warnings(self) -> list[str]:
        """Inputs that count strongly against an attack; investigate before trusting."""
        return [name for name, w in self.coefficients.items() if w < -0.5]

    def probability(self) -> Column:
        """P(attack) as a plain expression over the score columns."""
        z = F.lit(self.intercept)
        for name, weight in self.coefficients.items():
            z = z + F.col(name) * F.lit(weight)
        return 1.0 / (1.0 + F.exp(-z))

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [("intercept", self.intercept), *self.coefficients.items()],
            "name string, value double")


def load_meta(table: DataFrame, inputs=BASE_SCORES) -> Meta:
    values = {r.name: r.value for r in table.collect()}
    return Meta(values["intercept"], {c: values[c] for c in inputs})


def fit_meta(df: DataFrame, inputs=BASE_SCORES, y: str = "y") -> Meta:
    """Balanced class weights and an L2 penalty of strength C = 1. The weights
    sum to n, so regParam = 1/n states the same objective."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(y) == 1).cast("int")).alias("p")).first()
    n, p = counts.n, counts.p or 0
    if p == 0 or p == n:
        raise ValueError("the meta-learner needs both classes")
    weight = F.when(F.col(y) == 1, n / (2.0 * p)).otherwise(n / (2.0 * (n - p)))
    rows = VectorAssembler(inputCols=list(inputs), outputCol="_x").transform(
        df.select(*inputs, F.col(y).cast("double").alias("_y"), weight.alias("_w")))
    model = LogisticRegression(
        featuresCol="_x", labelCol="_y", weightCol="_w", standardization=False,
        elasticNetParam=0.0, regParam=1.0 / n, maxIter=2000, tol=1e-10).fit(rows)
    return Meta(float(model.intercept), dict(zip(inputs, map(float, model.coefficients))))
