"""Dense autoencoder trained by distributed parameter averaging.

Rows belong to settings.ae_shards shards by their key's hash, whatever the data's
size and the cluster's. Each round, every shard runs ae_sync_epochs passes of
mini-batch Adam over its own rows, batch by batch in key order, from the shared state, and the states are averaged, weighted by
rows (Zinkevich et al., 2010). Averaging is a Spark aggregation per parameter; the
driver only sees the result, a few thousand numbers. One shard gives plain sequential
training; more shards than slots queue.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlens.config import DEFAULTS, Settings


class Network:
    """d -> hidden -> bottleneck -> hidden -> d, ReLU inside, linear output."""

    def __init__(self, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.layers = layers

    @classmethod
    def initial(cls, width: int, hidden: int, bottleneck: int, seed: int) -> "Network":
        rng = np.random.default_rng(seed)
        sizes = [width, hidden, bottleneck, hidden, width]
        return cls([(rng.standard_normal((a, b)) * np.sqrt(2.0 / (a + b)), np.zeros(b))
                    for a, b in zip(sizes, sizes[1:])])

    def activations(self, X: np.ndarray) -> list[np.ndarray]:
        out = [X]
        for i, (W, b) in enumerate(self.layers):
            z = out[-1] @ W + b
            out.append(z if i == len(self.layers) - 1 else np.maximum(z, 0.0))
        return out

    def errors(self, X: np.ndarray) -> np.ndarray:
        return ((X - self.activations(X)[-1]) ** 2).mean(axis=1)

    def gradient(self, X: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Flat gradient of the squared error summed over features, averaged over rows."""
        acts = self.activations(X)
        delta = 2.0 * (acts[-1] - target) / len(X)
        parts = []
        for i in range(len(self.layers) - 1, -1, -1):
            parts.append((acts[i].T @ delta, delta.sum(axis=0)))
            if i:
                delta = (delta @ self.layers[i][0].T) * (acts[i] > 0)
        return np.concatenate([np.r_[w.ravel(), b] for w, b in reversed(parts)])

    def flat(self) -> np.ndarray:
        return np.concatenate([np.r_[W.ravel(), b] for W, b in self.layers])

    def with_flat(self, flat: np.ndarray) -> "Network":
        layers, at = [], 0
        for W, b in self.layers:
            layers.append((flat[at:at + W.size].reshape(W.shape),
                           flat[at + W.size:at + W.size + b.size]))
            at += W.size + b.size
        return Network(layers)


def local_pass(net: Network, flat, m, v, t, X, batch, lr, noise, rng):
    """One shuffled pass of Adam over X; returns the new (flat, m, v, t)."""
    order = rng.permutation(len(X))
    for at in range(0, len(X), batch):
        part = X[order[at:at + batch]]
        if len(part) < 2:
            continue
        noisy = part + rng.normal(0.0, noise, part.shape) if noise else part
        g = net.with_flat(flat).gradient(noisy, part)
        t += 1
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        flat = flat - lr * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return flat, m, v, t


def fit_autoencoder(df: DataFrame, vector: Column, key: str, settings: Settings = DEFAULTS,
                    seed: int | None = None, shards: int | None = None
                    ) -> tuple[Network, list[float]]:
    """(network, validation error per round). A tenth of the rows, chosen by
    hash, stops training after ae_patience rounds without gain; the best weights
    are returned."""
    seed = settings.seed if seed is None else seed
    rows = df.select(F.col(key).alias("k"), vector.alias("x")).withColumn(
        "held", F.pmod(F.xxhash64("k", F.lit(seed)), F.lit(10)) == 0)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    # Hash partitioning keeps rows with their shard across rounds and retries.
    rows = rows.repartition(shards or settings.ae_shards, "k").sortWithinPartitions("k")
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _train(rows, size.d, settings, seed)
    finally:
        rows.unpersist()


def _train(rows: DataFrame, width: int, settings: Settings, seed: int):
    net = Network.initial(width, settings.ae_hidden, settings.ae_bottleneck, seed)
    flat = net.flat()
    size = len(flat)
    state = np.concatenate([flat, np.zeros(2 * size), [0.0]])
    best, best_flat, waited, history = np.inf, flat, 0, []

    sync = max(1, min(settings.ae_sync_epochs, settings.ae_epochs))
    rounds = -(-settings.ae_epochs // sync)
    for round_ in range(rounds + 1):
        total = _round(rows, net, state, round_, settings, seed, last=round_ == rounds)
        # Slots past the state: held-out error sum, held-out rows, trained rows.
        error, held, trained = total[-3:]
        if round_ > 0 and held > 0:
            # The incoming state was measured before it was trained further.
            loss = error / held
            history.append(loss)
            if loss < best - 1e-7:
                best, best_flat, waited = loss, state[:size], 0
            else:
                waited += sync
                if waited >= settings.ae_patience:
                    break
        if trained > 0:
            state = total[:-3] / trained
        if held == 0:
            best_flat = state[:size]
    return net.with_flat(best_flat), history


def _round(rows, net, state, round_, settings, seed, last):
    """Sums over partitions of [rows * new state..., error, held rows, rows]."""
    size = (len(state) - 1) // 3
    batch, lr, noise = settings.ae_batch, settings.ae_lr, settings.ae_noise
    sync = max(1, min(settings.ae_sync_epochs, settings.ae_epochs))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat, m, v = state[:size], state[size:2 * size], state[2 * size:3 * size]
        t, n, error, held = int(round(state[-1])), 0, 0.0, 0
        first = net.with_flat(flat)
        rng = np.random.default_rng([seed, round_])
        for pdf in batches:
            if not len(pdf):
                continue
            X = np.stack(pdf["x"].to_numpy())
            out = pdf["held"].to_numpy(dtype=bool)
            if out.any():
                error += float(first.errors(X[out]).sum())
                held += int(out.sum())
            if not last and (~out).any():
                n += int((~out).sum())
                for _ in range(sync):
                    flat, m, v, t = local_pass(net, flat, m, v, t, X[~out], batch, lr, noise, rng)
        new = np.concatenate([flat, m, v, [t]]) * n
        values = np.concatenate([new, [error, held, n]])
        yield pd.DataFrame({"i": np.arange(len(values), dtype="int32"), "value": values})

    sums = rows.select("x", "held").mapInPandas(work, "i int, value double").groupBy("i").agg(
        F.sum("value").alias("value"))
    return sums.toPandas().sort_values("i")["value"].to_numpy()


def weights_table(spark, net: Network) -> DataFrame:
    """(layer, row, col, value); row -1 holds the biases."""
    out = []
    for i, (W, b) in enumerate(net.layers):
        out += [(i, r, c, float(W[r, c])) for r in range(W.shape[0]) for c in range(W.shape[1])]
        out += [(i, -1, c, float(b[c])) for c in range(len(b))]
    return spark.createDataFrame(out, "layer int, row int, col int, value double")


def load_network(weights: DataFrame) -> Network:
    pdf = weights.toPandas()
    layers = []
    for _, part in pdf.groupby("layer"):
        W = np.zeros((part["row"].max() + 1, part["col"].max() + 1))
        b = np.zeros(part["col"].max() + 1)
        bias = part["row"] < 0
        b[part.loc[bias, "col"]] = part.loc[bias, "value"]
        W[part.loc[~bias, "row"], part.loc[~bias, "col"]] = part.loc[~bias, "value"]
        layers.append((W, b))
    return Network(layers)


def score_autoencoder(df: DataFrame, vector: Column, net: Network, out: str = "ae_raw") -> DataFrame:
    """Adds the mean squared reconstruction error of each row."""
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(net.errors(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")
    return df.withColumn(out, F.pandas_udf(score, "double")(vector))
