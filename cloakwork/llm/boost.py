"""Gradient-boosted trees with logistic loss, in numpy, small enough to print as SQL."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _grow(bins, grad, hess, rows, depth, cuts, least, l2) -> Node:
    g, h = grad[rows].sum(), hess[rows].sum()
    leaf = Node(value=float(-g / (h + l2)))
    if depth == 0 or len(rows) < 2 * least:
        return leaf
    best, at = 1e-6, None
    base = g * g / (h + l2)
    for f, cut in enumerate(cuts):
        if not len(cut):
            continue
        b = bins[f][rows]
        n = len(cut) + 1
        gs = np.cumsum(np.bincount(b, grad[rows], n))[:-1]
        hs = np.cumsum(np.bincount(b, hess[rows], n))[:-1]
        cs = np.cumsum(np.bincount(b, minlength=n))[:-1]
        gain = gs**2 / (hs + l2) + (g - gs) ** 2 / (h - hs + l2) - base
        gain[(cs < least) | (len(rows) - cs < least)] = 0
        i = int(gain.argmax())
        if gain[i] > best:
            best, at = gain[i], (f, i)
    if at is None:
        return leaf
    go = bins[at[0]][rows] <= at[1]
    return Node(
        feature=at[0],
        threshold=float(cuts[at[0]][at[1]]),
        low=_grow(bins, grad, hess, rows[go], depth - 1, cuts, least, l2),
        high=_grow(bins, grad, hess, rows[~go], depth - 1, cuts, least, l2),
    )


def _apply(node: Node, x: np.ndarray, out: np.ndarray, rows: np.ndarray) -> None:
    if node.feature < 0:
        out[rows] += node.value
        return
    go = x[rows, node.feature] <= node.threshold
    _apply(node.low, x, out, rows[go])
    _apply(node.high, x, out, rows[~go])


class Boosted:
    """fit(), then margin() is the log odds and probability() is in (0, 1)."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, least: int = 4, l2: float = 1.0):
        self.n, self.depth, self.rate, self.least, self.l2 = trees, depth, rate, least, l2
        self.trees: list[Node] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = []
        for f in range(x.shape[1]):
            v = np.unique(x[:, f])
            mid = (v[1:] + v[:-1]) / 2
            cuts.append(mid if len(mid) <= 64 else np.unique(np.quantile(mid, np.linspace(0, 1, 64))))
        # bin i holds the values up to cut i
        bins = [np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]
        f = np.zeros(len(y))
        rows = np.arange(len(y))
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-f))
            tree = _grow(bins, p - y, p * (1 - p) + 1e-9, rows, self.depth, cuts, self.least, self.l2)
            step = np.zeros(len(y))
            _apply(tree, x, step, rows)
            f += self.rate * step
            self.trees.append(tree)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in self.trees:
            _apply(t, x, out, rows)
        return out * self.rate

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))

    def sql(self, names: list[str]) -> str:
        """The margin as an SQL expression over the named features."""

        def say(node: Node) -> str:
            if node.feature < 0:
                return f"{node.value * self.rate:.9e}D"
            return f"if({names[node.feature]} <= {node.threshold!r}D, {say(node.low)}, {say(node.high)})"

        return " + ".join(say(t) for t in self.trees)


def calibrated_threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least margin cut at which the chosen rows have at least that precision."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    good = hit / np.arange(1, len(y) + 1) >= precision
    last = np.ones(len(y), bool)
    last[:-1] = p[order][1:] < p[order][:-1]
    at = np.flatnonzero(good & last)
    if not len(at):
        return float("inf")
    i = at[-1]
    nxt = p[order][i + 1] if i + 1 < len(y) else p[order][i] - 2
    return float((p[order][i] + nxt) / 2)
