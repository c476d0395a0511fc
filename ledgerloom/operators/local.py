"""Fitted trees and networks, and fits of rows that one process holds.

The fits here are the plain methods for small arrays; tables are fitted by `trees` and `networks`,
which reach the same models from sums in the cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Numpy:
    """A fitted model: a function of a matrix, and a batch scorer of tables."""

    def predict(self, df: DataFrame, x: str = "x", name: str = "y_pred") -> DataFrame:
        """df with the predictions; the model goes to the executors once."""
        held = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def score(v: pd.Series) -> pd.Series:
            return pd.Series(held.value(np.stack(v.to_numpy()).astype(float)) if len(v) else np.zeros(0))
        return df.withColumn(name, score(F.col(x)))


class Forest(_Numpy):
    """The mean of trees, nested (feature, cut, left, right)."""

    def __init__(self, trees: list):
        self.trees, self._flat = trees, [_flat(t) for t in trees]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.mean([_tree_values(t, x) for t in self._flat], axis=0)

    def to_json(self) -> dict:
        return {"trees": self.trees}

    @classmethod
    def from_json(cls, body: dict) -> Forest:
        nested = lambda t: float(t) if isinstance(t, (int, float)) else (t[0], t[1], nested(t[2]), nested(t[3]))
        return cls([nested(t) for t in body["trees"]])


class Network(_Numpy):
    """One hidden layer, on a standardised target."""

    def __init__(self, weights: list[np.ndarray], mean: float, std: float):
        self.weights, self.mean, self.std = weights, mean, std

    def __call__(self, x: np.ndarray) -> np.ndarray:
        p = self.weights
        return (np.maximum(0, x @ p[0] + p[1]) @ p[2] + p[3][0]) * self.std + self.mean

    def to_json(self) -> dict:
        return {"weights": [w.tolist() for w in self.weights], "mean": self.mean, "std": self.std}

    @classmethod
    def from_json(cls, body: dict) -> Network:
        return cls([np.array(w, float) for w in body["weights"]], body["mean"], body["std"])


def _tree(x, y, rng, depth, leaf, features, random_cuts):
    """Nested tuples (feature, cut, left, right) or a leaf's mean."""
    if depth == 0 or len(y) < 2 * leaf or np.ptp(y) == 0:
        return float(y.mean())
    best = (1e-12, None, None)
    for f in rng.choice(x.shape[1], features, replace=False) if features < x.shape[1] else range(x.shape[1]):
        v = x[:, f]
        low, high = v.min(), v.max()
        if low == high:
            continue
        if random_cuts:
            cuts = [rng.uniform(low, high)]
            for c in cuts:
                m = v <= c
                n = int(m.sum())
                if leaf <= n <= len(y) - leaf:
                    gain = n * (len(y) - n) / len(y) * (y[m].mean() - y[~m].mean()) ** 2
                    if gain > best[0]:
                        best = (gain, f, c)
            continue
        order = np.argsort(v, kind="stable")
        s, t = v[order], np.cumsum(y[order])
        n = np.arange(1, len(y))
        ok = (s[1:] > s[:-1]) & (n >= leaf) & (len(y) - n >= leaf)
        if ok.any():
            gain = np.where(ok, n * (len(y) - n) / len(y) * (t[:-1] / n - (t[-1] - t[:-1]) / (len(y) - n)) ** 2, -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, (s[k] + s[k + 1]) / 2)
    if best[1] is None:
        return float(y.mean())
    m = x[:, best[1]] <= best[2]
    return int(best[1]), float(best[2]), _tree(x[m], y[m], rng, depth - 1, leaf, features, random_cuts), _tree(x[~m], y[~m], rng, depth - 1, leaf, features, random_cuts)


def _flat(tree):
    """A nested tree as (feature, cut, children, value, depth): a node's rows with x <= cut go to
    children[2 * node], the others to the one after it; a leaf is both its own children."""
    feature, cut, children, value, deepest = [], [], [], [], 0
    nodes = [(tree, 0)]
    for at, (node, depth) in enumerate(nodes):  # a node's children are appended as it is read
        deepest = max(deepest, depth)
        if isinstance(node, float):
            f, c, both, v = 0, 0.0, (at, at), node
        else:
            f, c, both, v = node[0], node[1], (len(nodes), len(nodes) + 1), 0.0
            nodes += [(node[2], depth + 1), (node[3], depth + 1)]
        feature.append(f)
        cut.append(c)
        children += both
        value.append(v)
    return np.array(feature, np.intp), np.array(cut, float), np.array(children, np.intp), np.array(value, float), deepest


def _tree_values(flat, x):
    """All rows go down a level at a time: as many steps as the tree is deep, however many nodes it has."""
    feature, cut, children, value, deepest = flat
    cells, first, at = x.ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x), np.intp)
    for _ in range(deepest):
        at = children.take(2 * at + 1 - (cells.take(first + feature.take(at)) <= cut.take(at)))
    return value.take(at)


def fit_trees(x, y, *, trees=1, depth=8, leaf=10, features=1.0, bootstrap=False, random_cuts=False, seed=42):
    rng = np.random.default_rng(seed)
    k = max(1, int(round(features * x.shape[1])))
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y)) if bootstrap else slice(None)
        out.append(_tree(x[rows], y[rows], rng, depth, leaf, k, random_cuts))
    return Forest(out)


def fit_mlp(x, y, *, hidden=16, epochs=200, rate=0.01, l2=1e-4, seed=42):
    """One hidden ReLU layer, Adam over the full batch, the target standardised on the fit rows."""
    rng = np.random.default_rng(seed)
    mu, sd = y.mean(), y.std() or 1.0
    t = (y - mu) / sd
    p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, epochs + 1):
        h = np.maximum(0, x @ p[0] + p[1])
        e = (h @ p[2] + p[3][0] - t) / len(t)
        back = np.outer(e, p[2]) * (h > 0)
        grads = [x.T @ back + l2 * p[0], back.sum(0), h.T @ e + l2 * p[2], np.array([e.sum()])]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Network(p, float(mu), float(sd))


FITS = {
    "tree": lambda x, y, seed, **o: fit_trees(x, y, seed=seed, **({"depth": 8, "leaf": 10} | o)),
    "random_forest": lambda x, y, seed, **o: fit_trees(x, y, seed=seed, **({"trees": 20, "depth": 10, "leaf": 3, "features": 0.5, "bootstrap": True} | o)),
    "extra_trees": lambda x, y, seed, **o: fit_trees(x, y, seed=seed, **({"trees": 20, "depth": 10, "leaf": 3, "random_cuts": True} | o)),
    "mlp": lambda x, y, seed, **o: fit_mlp(x, y, seed=seed, **o),
}
