"""Isolation forest (Liu, Ting & Zhou, 2008).

Trees are independent, so each is built by its own task from its own bounded
subsample; the subsampling is part of the method. Scoring ships the node table,
whose size is fixed by trees and sample size, and walks it in Arrow batches.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reqlens.schemas import FOREST_NODES

EULER_GAMMA = 0.5772156649015329
BLOCK = 2_048  # rows scored at a time


def mean_path(n):
    """c(n): average path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    out = 2.0 * (np.log(big - 1.0) + EULER_GAMMA) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, out))


def grow_tree(X: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes (node, feature, threshold, left, right, size); leaves have feature -1."""
    limit = math.ceil(math.log2(max(len(X), 2)))
    nodes, stack = [None], [(0, np.arange(len(X)), 0)]
    while stack:
        at, rows, depth = stack.pop()
        part = X[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes[at] = (at, -1, 0.0, -1, -1, len(rows))
            continue
        feature = int(rng.choice(usable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        if threshold >= high[feature]:
            threshold = float(low[feature])
        below = part[:, feature] <= threshold
        left, right = len(nodes), len(nodes) + 1
        nodes += [None, None]
        nodes[at] = (at, feature, threshold, left, right, len(rows))
        stack += [(left, rows[below], depth + 1), (right, rows[~below], depth + 1)]
    return nodes


def tree_samples(df: DataFrame, vector: Column, key: str, n: int, trees: int, sample: int,
                 seed: int) -> DataFrame:
    """(tree, x) with `sample` rows per tree, drawn without replacement.

    A row joins a tree when its hash says so. With much data a first hash thins
    the rows to about one tree each, so nothing is hashed once per tree there.
    """
    rows = df.select(F.col(key).alias("k"), vector.alias("x"))
    rate = min(1.0, (sample + 6 * math.sqrt(sample) + 10) / max(1, n))
    entry = min(1.0, rate * trees)

    def unit(*cols):
        return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)) / float(1 << 53)

    # Hashes are below 1, so a rate of 1 keeps every row.
    rows = rows.filter(unit("k", F.lit(f"entry{seed}")) < entry)
    ids = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)),
                   lambda t: unit("k", t, F.lit(seed)) < rate / entry)
    picked = rows.select("k", "x", F.explode(ids).alias("tree"))
    place = Window.partitionBy("tree").orderBy(F.xxhash64("k", "tree", F.lit(seed)), "k")
    return picked.withColumn("r", F.row_number().over(place)).filter(
        F.col("r") <= sample).select("tree", "r", "x")


def fit_forest(df: DataFrame, vector: Column, key: str, trees: int = 300, sample: int = 4096,
               seed: int = 42) -> tuple[DataFrame, int]:
    """(node table, sample size used)."""
    n = df.count()
    sample = min(sample, n)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        X = np.stack(pdf.sort_values("r")["x"].to_numpy())
        nodes = grow_tree(X, np.random.default_rng([seed, tree]))
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "size"])
        out.insert(0, "tree", tree)
        return out

    drawn = tree_samples(df, vector, key, n, trees, sample, seed)
    # Bounded groups: at most `sample` rows per tree.
    return drawn.groupBy("tree").applyInPandas(build, FOREST_NODES), sample


class Forest:
    """Node arrays for scoring; at most trees * 2 * sample nodes."""

    def __init__(self, nodes: pd.DataFrame, sample: int):
        nodes = nodes.sort_values(["tree", "node"])
        starts = nodes.groupby("tree")["node"].size().cumsum().shift(fill_value=0)
        base = nodes["tree"].map(starts).to_numpy()
        leaf = nodes["feature"].to_numpy() < 0
        own = base + nodes["node"].to_numpy()
        self.roots = starts.to_numpy().astype(np.int64)
        self.feature = np.where(leaf, 0, nodes["feature"]).astype(np.int32)
        # A leaf points at itself, so walking past it changes nothing.
        self.threshold = np.where(leaf, np.inf, nodes["threshold"])
        left = np.where(leaf, own, base + nodes["left"]).astype(np.int64)
        right = np.where(leaf, own, base + nodes["right"]).astype(np.int64)
        self.child = np.column_stack([left, right]).ravel()
        self.scale = float(mean_path(sample))
        # What a walk adds that stops at the node: its depth, and the path of the rows left there.
        depth, level = np.zeros(len(nodes)), self.roots
        self.levels = []  # per level, whether a tree goes on below it
        for at in range(math.ceil(math.log2(max(sample, 2)))):
            inner = level[~leaf[level]]
            if not len(inner):
                break
            self.levels.append(np.isin(np.arange(len(self.roots)), np.searchsorted(self.roots, inner, side="right") - 1))
            level = np.concatenate([left[inner], right[inner]])
            depth[level] = at + 1
        self.value = depth + mean_path(nodes["size"].to_numpy())

    def score(self, X: np.ndarray) -> np.ndarray:
        """2^(-E[h]/c) - 0.5: above 0 is more isolated than average."""
        total = np.zeros(len(X))
        width = X.shape[1] if X.ndim == 2 else 0
        for start in range(0, len(X), BLOCK):  # a block stays in the processor's cache for all trees
            part = np.ascontiguousarray(X[start:start + BLOCK], dtype=float).ravel()
            rows = np.arange(0, len(part), width)
            for tree, root in enumerate(self.roots):
                at = np.full(len(rows), root)
                for goes_on in self.levels:
                    if not goes_on[tree]:
                        break
                    right = part.take(rows + self.feature.take(at)) > self.threshold.take(at)
                    at = self.child.take(2 * at + right)
                total[start:start + BLOCK] += self.value.take(at)
        mean = total / max(1, len(self.roots))
        return 2.0 ** (-mean / self.scale) - 0.5 if self.scale > 0 else np.zeros(len(X))


def load_forest(nodes: DataFrame, sample: int) -> Forest:
    return Forest(nodes.toPandas(), sample)


def score_forest(df: DataFrame, vector: Column, forest: Forest, out: str = "if_raw") -> DataFrame:
    """Adds the raw anomaly score; higher is more anomalous. The node arrays travel
    with the function, which Spark ships as a broadcast when it is large."""
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(forest.score(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(score, "double")(vector))
