"""Gradient-boosted trees in numpy: histogram training on the driver's bounded sample, flat node arrays for scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from colloquy.llm.common import sigmoid


@dataclass
class Trees:
    """All trees as arrays (tree, node). Node k has children 2k + 1 and 2k + 2; the last level holds the values."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray, block: int = 4096) -> np.ndarray:
        """Log-odds of each row of ``x``; rows walk all trees at once, one level a step."""
        out = np.full(len(x), self.base)
        trees = np.arange(len(self.feature))[None, :]
        for at in range(0, len(x), block):
            part = x[at : at + block]
            rows, node = np.arange(len(part))[:, None], np.zeros((len(part), len(self.feature)), np.int32)
            for _ in range(self.depth):
                right = part[rows, self.feature[trees, node]] > self.threshold[trees, node]
                node = 2 * node + 1 + right
            out[at : at + block] += self.value[trees, node - (2**self.depth - 1)].sum(1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 1.0, least: float = 0.6) -> Trees:
    """Boost ``rounds`` trees of ``depth`` on the logistic loss.

    ``monotone`` maps a feature to +1 (score never falls as it grows) or -1. A split on such a feature is taken only if
    its child values are in that order, and its subtrees are held to their side of the middle of the two.
    """
    n, width = x.shape
    monotone = monotone or {}
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1).astype(np.int64) if n else np.zeros((0, width), np.int64)
    share = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    features, limits, values = [], [], []
    margin = np.full(n, base)
    for _ in range(rounds):
        p = sigmoid(margin)
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, limit = np.zeros(inner, np.int32), np.full(inner, np.inf)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        value = np.zeros(2 * inner + 1)
        node = np.zeros(n, np.int64)
        value[0] = -grad.sum() / (hess.sum() + l2)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-9)
            local = node - first
            for j in range(width):
                k = len(cuts[j]) + 1
                if k < 2:
                    continue
                key = local * k + binned[:, j]
                g = np.bincount(key, grad, count * k).reshape(count, k).cumsum(1)
                h = np.bincount(key, hess, count * k).reshape(count, k).cumsum(1)
                total_g, total_h = g[:, -1:], h[:, -1:]
                gl, hl, gr, hr = g[:, :-1], h[:, :-1], total_g - g[:, :-1], total_h - h[:, :-1]
                nodes = np.arange(first, first + count)
                vl = np.clip(-gl / (hl + l2), low[nodes, None], high[nodes, None])
                vr = np.clip(-gr / (hr + l2), low[nodes, None], high[nodes, None])
                loss = lambda v, a, b: a * v + 0.5 * (b + l2) * v * v
                parent = np.clip(-total_g / (total_h + l2), low[nodes, None], high[nodes, None])
                gain = loss(parent, total_g, total_h) - loss(vl, gl, hl) - loss(vr, gr, hr)
                gain[(hl < least) | (hr < least)] = -np.inf
                if j in monotone:
                    gain[(vr - vl) * monotone[j] < 0] = -np.inf
                at = gain.argmax(1)
                top = gain[np.arange(count), at]
                for c in np.flatnonzero(top > best):
                    best[c], feature[first + c], limit[first + c] = top[c], j, cuts[j][at[c]]
                    left, right = 2 * (first + c) + 1, 2 * (first + c) + 2
                    value[left], value[right] = vl[c, at[c]], vr[c, at[c]]
                    low[[left, right]], high[[left, right]] = low[first + c], high[first + c]
                    if j in monotone:
                        middle = (value[left] + value[right]) / 2
                        (high if monotone[j] > 0 else low)[left] = middle
                        (low if monotone[j] > 0 else high)[right] = middle
            for c in range(count):
                if not np.isfinite(limit[first + c]):  # no split: both children stand for the node
                    left, right = 2 * (first + c) + 1, 2 * (first + c) + 2
                    value[left] = value[right] = value[first + c]
                    low[[left, right]], high[[left, right]] = low[first + c], high[first + c]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > limit[node])
        leaf = rate * value[inner:]
        margin += leaf[node - inner]
        features.append(feature), limits.append(limit), values.append(leaf)
    if not features:
        features, limits, values = [np.zeros(inner, np.int32)], [np.full(inner, np.inf)], [np.zeros(leaves)]
    return Trees(np.array(features), np.array(limits), np.array(values), base, depth)


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the knots (score, probability) of the best non-decreasing fit of ``y`` on ``score``.

    One prior row of the mean outcome is added to each pooled block, so that no block claims certainty.
    """
    if not len(score):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    weight = np.ones(len(score)) if weight is None else weight
    order = np.argsort(score, kind="stable")
    at, first = np.unique(score[order], return_index=True)
    sums = np.add.reduceat((y * weight)[order], first)
    counts = np.add.reduceat(weight[order], first)
    blocks: list[list[float]] = []  # sum, count, knots
    for s, c in zip(sums, counts):
        blocks.append([s, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, c2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + c2, blocks[-1][2] + k2]
    prior = float((y * weight).sum() / weight.sum())
    fitted = np.concatenate([np.full(int(k), (s + prior) / (c + 1)) for s, c, k in blocks])
    return at, np.maximum.accumulate(fitted)
