"""Neural estimators over subplans: a network over sets (tables, joins, predicates) and a plain one over flat features.

A model is fitted on the driver, on MAX_TRAIN_ROWS labelled rows at most; predictions run where the rows are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows a fit takes at most: those of the smallest hashes, so a refit takes the same ones.
MAX_TRAIN_ROWS = 50_000
SETS = ("tables", "joins", "predicates")


def _mse(p: np.ndarray, y: np.ndarray, span: float) -> tuple[float, np.ndarray]:
    return ((p - y) ** 2).mean(), 2 * (p - y) / len(y)


def _mse_pos(p: np.ndarray, y: np.ndarray, span: float) -> tuple[float, np.ndarray]:
    w = np.where(p < y, 10.0, 1.0)
    return (w * (p - y) ** 2).mean(), 2 * w * (p - y) / len(y)


def _q(p: np.ndarray, y: np.ndarray, span: float) -> tuple[float, np.ndarray]:
    q = np.exp(np.abs(p - y) * span)
    return q.mean(), np.sign(p - y) * span * q / len(y)


def _ranked(p: np.ndarray, y: np.ndarray, span: float) -> tuple[float, np.ndarray]:
    """mse, and a tenth of the mean cross-entropy of each pair's order against half of one more than the labels' difference."""
    value, slope = _mse(p, y, span)
    i, j = np.triu_indices(len(p), 1)
    if not len(i):
        return value, slope
    s = 1 / (1 + np.exp(p[j] - p[i]))
    t = (1 + np.clip(y[i] - y[j], -1, 1)) / 2
    g = 0.1 * (s - t) / len(i)
    return value - 0.1 * (t * np.log(s) + (1 - t) * np.log(1 - s)).mean(), slope + np.bincount(i, g, len(p)) - np.bincount(j, g, len(p))


#: Losses of scaled logs and their slopes: mse; mse with underestimates ten times; mean q-error; mse and order of pairs in a batch.
LOSSES = {"mse": _mse, "mse_pos": _mse_pos, "q": _q, "mse+ranknet": _ranked}


class Layers:
    """Dense layers, each but an open last one followed by a rectifier."""

    def __init__(self, sizes: list[int], rng: np.random.Generator, open_end: bool = False):
        self.w = [rng.normal(0, (2 / a) ** 0.5, (a, b)) for a, b in zip(sizes, sizes[1:], strict=False)]
        self.b = [np.zeros(b) for b in sizes[1:]]
        self.open_end = open_end

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.seen = [x]
        for i, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            x = x @ w + b
            if i < len(self.w) - 1 or not self.open_end:
                x = np.maximum(x, 0)
            self.seen.append(x)
        return x

    def backward(self, g: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Gradients of the input and of (w, b) layer by layer, in the order of params()."""
        grads = []
        for i in reversed(range(len(self.w))):
            if i < len(self.w) - 1 or not self.open_end:
                g = g * (self.seen[i + 1] > 0)
            flat_x, flat_g = self.seen[i].reshape(-1, self.w[i].shape[0]), g.reshape(-1, self.w[i].shape[1])
            grads = [flat_x.T @ flat_g, flat_g.sum(0), *grads]
            g = g @ self.w[i].T
        return g, grads

    def params(self) -> list[np.ndarray]:
        return [p for wb in zip(self.w, self.b, strict=True) for p in wb]


class SetNet:
    """Each set's elements go through its own layers and are averaged (0 for an empty set); the averages and the flat features through further layers to a sigmoid.

    Without sets it is a plain multi-layer network. Output: the log of the label, scaled to [0, 1] over the training rows.
    """

    def __init__(self, sets: dict[str, int], flat: int, hidden: int = 32, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.sets = {s: Layers([n, hidden, hidden], rng) for s, n in sets.items()}
        self.top = Layers([hidden * len(sets) + flat, hidden, hidden, 1], rng, open_end=True)
        self.low, self.span = 0.0, 1.0

    def params(self) -> list[np.ndarray]:
        return [p for part in [*self.sets.values(), self.top] for p in part.params()]

    def forward(self, x: dict[str, tuple[np.ndarray, np.ndarray]], flat: np.ndarray) -> np.ndarray:
        """x: by set, elements (rows, most elements, features) and mask (rows, most elements)."""
        means = [(layers.forward(x[s][0]) * x[s][1][:, :, None]).sum(1) / np.maximum(x[s][1].sum(1), 1)[:, None] for s, layers in self.sets.items()]
        return 1 / (1 + np.exp(-self.top.forward(np.concatenate([*means, flat], axis=1))[:, 0]))

    def gradients(self, x: dict, flat: np.ndarray, y: np.ndarray, loss: str = "mse") -> tuple[float, list[np.ndarray]]:
        """Mean loss over rows (see LOSSES) and its gradients, in the order of params()."""
        p = self.forward(x, flat)
        value, slope = LOSSES[loss](p, y, self.span)
        g, grads = self.top.backward((slope * p * (1 - p))[:, None])
        out, at = [], 0
        for s, layers in self.sets.items():
            width = layers.b[-1].size
            share = x[s][1] / np.maximum(x[s][1].sum(1), 1)[:, None]
            out += layers.backward(g[:, None, at : at + width] * share[:, :, None])[1]
            at += width
        return float(value), out + grads

    def fit(self, x: dict, flat: np.ndarray, labels: np.ndarray, epochs: int = 300, batch: int = 256, rate: float = 3e-3, loss: str = "mse", seed: int = 1,
            keep: float = 1.0, average: float = 0.0, val: tuple[dict, np.ndarray, np.ndarray] | None = None, patience: int = 20) -> SetNet:
        """Adam over shuffled batches, gradients clipped to norm 10; labels below 1 count as 1.

        keep: each batch sees an element of a set, and a flat feature, with this probability (query masking). average: the weights are the mean
        over this last share of epochs. val: with rows (x, flat, labels) held out, training stops after `patience` epochs
        without a lower loss on them, and the best epoch's weights stay.
        """
        y = np.log(np.maximum(labels, 1))
        self.low, self.span = float(y.min()), float(y.max() - y.min()) or 1.0
        scaled = lambda v: (np.log(np.maximum(v, 1)) - self.low) / self.span
        y, rng, t = (y - self.low) / self.span, np.random.default_rng(seed), 0
        params = self.params()
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        total, summed, best, best_at, kept = [np.zeros_like(p) for p in params], 0, np.inf, 0, None
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for rows in np.array_split(order, -(-len(y) // batch)):
                t += 1
                some, f = {s: (e[rows], k[rows]) for s, (e, k) in x.items()}, flat[rows]
                if keep < 1:
                    some = {s: (e, k * (rng.uniform(size=k.shape) < keep)) for s, (e, k) in some.items()}
                    f = f * (rng.uniform(size=f.shape) < keep)
                _, grads = self.gradients(some, f, y[rows], loss)
                scale = min(1.0, 10 / (sum(float((g**2).sum()) for g in grads) ** 0.5 + 1e-12))
                for i, (p, g) in enumerate(zip(params, grads, strict=True)):
                    m[i] = 0.9 * m[i] + 0.1 * g * scale
                    v[i] = 0.999 * v[i] + 0.001 * (g * scale) ** 2
                    p -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
            if epoch >= epochs * (1 - average):
                summed += 1
                total = [a + p for a, p in zip(total, params, strict=True)]
            if val is not None:
                now = float(LOSSES[loss](self.forward(val[0], val[1]), scaled(val[2]), self.span)[0])
                if now < best:
                    best, best_at, kept = now, epoch, [p.copy() for p in params]
                elif epoch - best_at >= patience:
                    break
        final = kept if kept is not None else [a / summed for a in total] if summed else params
        for p, new in zip(params, final, strict=True):
            p[...] = new
        self.epochs = epoch + 1
        return self

    def predict(self, x: dict, flat: np.ndarray) -> np.ndarray:
        return np.exp(self.forward(x, flat) * self.span + self.low)


def arrays(pdf: pd.DataFrame, sets: dict[str, int], flat: int) -> tuple[dict, np.ndarray]:
    """Padded elements and masks by set, and the flat features, of rows with one array<array<double>> column for each set and `flat`."""
    x = {}
    for s, width in sets.items():
        most = max([1, *map(len, pdf[s])])
        e, k = np.zeros((len(pdf), most, width)), np.zeros((len(pdf), most))
        for i, elements in enumerate(pdf[s]):
            for j, values in enumerate(elements):
                e[i, j], k[i, j] = values, 1
        x[s] = (e, k)
    return x, np.array([list(f) for f in pdf["flat"]], float).reshape(len(pdf), flat)


def fit_net(train: DataFrame, label: str, key: str, sets: tuple[str, ...] = SETS, val: DataFrame | None = None, **how) -> tuple[SetNet, dict[str, int], int]:
    """The network fitted on train's rows of smallest hashes of `key`, MAX_TRAIN_ROWS at most; sets=() makes the plain network.

    val: rows to stop early by, as many at most; how: see SetNet.fit.
    """
    taken = lambda d: d.select(label, key, *sets, "flat").orderBy(F.xxhash64(key), key).limit(MAX_TRAIN_ROWS).toPandas()
    pdf = taken(train)
    if not len(pdf):
        raise ValueError("no labelled rows")
    widths = {s: max((len(v) for elements in pdf[s] for v in elements), default=1) for s in sets}
    flat = len(pdf["flat"].iloc[0])
    x, f = arrays(pdf, widths, flat)
    if val is not None and len(held := taken(val)):
        how["val"] = (*arrays(held, widths, flat), held[label].to_numpy(float))
    return SetNet(widths, flat).fit(x, f, pdf[label].to_numpy(float), **how), widths, flat


def net_estimates(rows: DataFrame, net: SetNet, widths: dict[str, int], flat: int) -> DataFrame:
    """(subplan, est) of rows with features; the weights, some kilobytes, travel with the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, f = arrays(pdf, widths, flat)
                yield pd.DataFrame({"subplan": pdf["subplan"], "est": net.predict(x, f)})

    return rows.select("subplan", *widths, "flat").mapInPandas(run, "subplan string, est double")
