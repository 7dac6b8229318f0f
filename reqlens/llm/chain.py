"""Linear-chain conditional random fields in numpy batches.

Many sequences are worked on side by side: step t handles the t-th item of every
sequence that is so long. A model is bounded: it has weights for the features of its
training items only, and a feature that it doesn't know weighs nothing.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_FILTER_BITS = 20


@dataclass
class Chain:
    features: np.ndarray     # sorted 64-bit hashes
    weights: np.ndarray      # features x labels
    transitions: np.ndarray  # label before x label
    start: np.ndarray        # labels of a first item

    def unary(self, slots: list[np.ndarray]) -> np.ndarray:
        """Scores of the labels of each item; slots are arrays of feature hashes."""
        out = np.zeros((len(slots[0]), self.weights.shape[1]))
        if not len(self.features):
            return out
        known = np.zeros(1 << _FILTER_BITS, bool)
        mask = np.uint64((1 << _FILTER_BITS) - 1)
        known[(self.features & mask).astype(np.int64)] = True
        for hashes in slots:
            at = np.flatnonzero(known[(hashes & mask).astype(np.int64)])
            place = np.searchsorted(self.features, hashes[at])
            place[place == len(self.features)] = 0
            found = self.features[place] == hashes[at]
            out[at[found]] += self.weights[place[found]]
        return out


def _rows(bounds: np.ndarray):
    """Items by step: sequences by falling length, and how many have a t-th item."""
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    starts, lengths = bounds[:-1][order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
    return starts, active


def marginals(chain: Chain, unary: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward: label marginals of each item, the summed marginals of each
    transition, and the log of the partition function. bounds: of the sequences."""
    starts, active = _rows(bounds)
    top = unary.max(axis=1, keepdims=True) if len(unary) else unary
    local = np.exp(unary - top)
    step, first = np.exp(chain.transitions), np.exp(chain.start)
    alpha, beta = np.zeros_like(unary), np.zeros_like(unary)
    scale = np.ones(len(unary))
    now = None
    for t, k in enumerate(active.tolist()):
        at = starts[:k] + t
        now = (first if t == 0 else now[:k] @ step) * local[at]
        scale[at] = now.sum(axis=1)
        now = now / scale[at][:, None]
        alpha[at] = now
    pairs = np.zeros_like(step)
    ahead = np.zeros((0, unary.shape[1]))
    for t in range(len(active) - 1, -1, -1):
        k = int(active[t])
        at = starts[:k] + t
        message = np.ones((k, unary.shape[1]))
        message[:len(ahead)] = ahead @ step.T
        if len(ahead):
            pairs += step * (alpha[at[:len(ahead)]].T @ ahead)
        beta[at] = message
        ahead = local[at] * message / scale[at][:, None]
    log_z = float(np.log(scale).sum() + (top.sum() if len(unary) else 0.0))
    return alpha * beta, pairs, log_z


def viterbi(chain: Chain, unary: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The best labels of each item; of equal ones the lower label."""
    starts, active = _rows(bounds)
    back = np.zeros(unary.shape, np.int8)
    labels = np.zeros(len(unary), np.int64)
    best, ends = None, np.zeros((len(starts), unary.shape[1]))
    for t, k in enumerate(active.tolist()):
        at = starts[:k] + t
        if t == 0:
            best = chain.start + unary[at]
        else:
            paths = best[:k, :, None] + chain.transitions
            back[at] = paths.argmax(axis=1)
            best = paths.max(axis=1) + unary[at]
        ends[:k] = best
    for t in range(len(active) - 1, -1, -1):
        k = int(active[t])
        at = starts[:k] + t
        later = int(active[t + 1]) if t + 1 < len(active) else 0
        labels[at[later:]] = ends[later:k].argmax(axis=1)
        nxt = at[:later] + 1
        labels[at[:later]] = back[nxt, labels[nxt]]
    return labels


def fit(slots: list[np.ndarray], labels: np.ndarray, bounds: np.ndarray, n_labels: int,
        least: int = 2, l2: float = 1e-3, rounds: int = 60, rate: float = 0.3) -> Chain:
    """Maximises the penalised likelihood by Adagrad over all items; deterministic.
    Features with fewer than `least` items are left out."""
    every, counts = np.unique(np.concatenate(slots), return_counts=True)
    every = every[counts >= least]
    chain = Chain(every, np.zeros((len(every), n_labels)), np.zeros((n_labels, n_labels)),
                  np.zeros(n_labels))
    n = max(1, len(labels))
    places, items = [], []
    for hashes in slots:
        place = np.searchsorted(every, hashes)
        place[place == len(every)] = 0
        found = np.flatnonzero(every[place] == hashes) if len(every) else np.zeros(0, int)
        places.append(place[found])
        items.append(found)
    place, item = np.concatenate(places), np.concatenate(items)
    truth = np.zeros((len(labels), n_labels))
    truth[np.arange(len(labels)), labels] = 1
    heads = bounds[:-1][np.diff(bounds) > 0]
    inner = np.ones(len(labels), bool)
    inner[heads] = False
    here = np.flatnonzero(inner)
    seen = np.zeros((n_labels, n_labels))
    np.add.at(seen, (labels[here - 1], labels[here]), 1)
    sums = [np.full_like(x, 1e-8) for x in (chain.weights, chain.transitions, chain.start)]
    for _ in range(rounds):
        unary = np.zeros((len(labels), n_labels))
        for y in range(n_labels):
            unary[:, y] = np.bincount(item, chain.weights[place, y], len(labels))
        p, pairs, _z = marginals(chain, unary, bounds)
        gap = truth - p
        grads = [np.stack([np.bincount(place, gap[item, y], len(every)) for y in range(n_labels)], axis=1),
                 seen - pairs, gap[heads].sum(axis=0)]
        for x, g, s in zip((chain.weights, chain.transitions, chain.start), grads, sums):
            g = g / n - l2 / n * x
            s += g * g
            x += rate * g / np.sqrt(s)
    return chain
