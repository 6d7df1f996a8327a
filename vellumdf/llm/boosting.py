"""Gradient-boosted regression trees over binned features, for models that are trained here."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 250, depth: int = 4, rate: float = 0.1, bins: int = 64, least: int = 12) -> dict:
    """Least-squares boosting.  A tree is lists of feature, threshold and value, children of node i at 2i+1 and 2i+2."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    base = float(y.mean())
    pred = np.full(len(y), base)
    trees = []
    size = 2 ** (depth + 1) - 1
    for _ in range(rounds):
        rest = y - pred
        feature, threshold, value = [-1] * size, [0.0] * size, [0.0] * size
        member = {0: np.arange(len(y))}
        for node in range(size):
            at = member.pop(node, None)
            if at is None or not len(at):
                continue
            value[node] = rate * float(rest[at].mean())
            if node * 2 + 2 >= size or len(at) < 2 * least:
                continue
            best = (1e-9, -1, 0)
            total, n = rest[at].sum(), len(at)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                count = np.cumsum(np.bincount(binned[at, j], minlength=len(e) + 1))[:-1]
                left = np.cumsum(np.bincount(binned[at, j], weights=rest[at], minlength=len(e) + 1))[:-1]
                ok = (count >= least) & (n - count >= least)
                if ok.any():
                    gain = np.where(ok, left**2 / np.maximum(count, 1) + (total - left) ** 2 / np.maximum(n - count, 1) - total**2 / n, 0)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
            if best[1] < 0:
                continue
            _, j, k = best
            feature[node], threshold[node] = j, float(edges[j][k])
            go = binned[at, j] <= k
            member[2 * node + 1], member[2 * node + 2] = at[go], at[~go]
        tree = {"feature": feature, "threshold": threshold, "value": value}
        trees.append(tree)
        pred = pred + _apply(tree, x)
    return {"base": base, "trees": trees}


def _apply(tree: dict, x: np.ndarray) -> np.ndarray:
    feature, threshold, value = (np.array(tree[k]) for k in ("feature", "threshold", "value"))
    node = np.zeros(len(x), np.int64)
    while True:
        f = feature[node]
        go = f >= 0
        if not go.any():
            return value[node]
        right = x[np.arange(len(x)), np.maximum(f, 0)] > threshold[node]
        node = np.where(go, 2 * node + 1 + right, node)


def stacked(model: dict) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(base, features, thresholds, values) of all trees, one behind the other."""
    feature, threshold, value = (np.array([t[k] for t in model["trees"]]) for k in ("feature", "threshold", "value"))
    return model["base"], feature.astype(np.int64), threshold, value


def predict_stacked(trees: tuple[float, np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    """All trees side by side, level by level."""
    base, feature, threshold, value = trees
    if not feature.size:
        return np.full(len(x), base)
    size = feature.shape[1]
    root = np.arange(len(feature)) * size
    node = np.broadcast_to(root, (len(x), len(root))).copy()
    feature, threshold = feature.ravel(), threshold.ravel()
    rows = np.arange(len(x))[:, None]
    while True:
        f = feature[node]
        go = f >= 0
        if not go.any():
            return base + value.ravel()[node].sum(1)
        right = x[rows, np.maximum(f, 0)] > threshold[node]
        node = np.where(go, 2 * (node - root) + 1 + right + root, node)


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    return predict_stacked(stacked(model), x)
