"""Gradient-boosted trees for a two-class question, fitted on a bounded sample and applied as SQL text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _grow(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, depth: int, least: int, damping: float) -> Node:
    """One regression tree on the loss's first and second derivatives; splits at midpoints between distinct values."""
    g, h = gradient.sum(), weight.sum()
    node = Node(value=float(g / (h + damping)))
    if depth == 0 or len(x) < 2 * least:
        return node
    best = 1e-6
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        values, left_g, left_h = x[order, f], np.cumsum(gradient[order]), np.cumsum(weight[order])
        n = np.arange(1, len(x))
        ok = (values[1:] > values[:-1]) & (n >= least) & (len(x) - n >= least)
        if not ok.any():
            continue
        gl, hl = left_g[:-1][ok], left_h[:-1][ok]
        gain = gl**2 / (hl + damping) + (g - gl) ** 2 / (h - hl + damping) - g**2 / (h + damping)
        at = int(np.argmax(gain))
        if gain[at] > best:
            best = float(gain[at])
            i = np.nonzero(ok)[0][at]
            node.feature, node.cut = f, float((values[i] + values[i + 1]) / 2)
    if node.feature >= 0:
        low = x[:, node.feature] <= node.cut
        node.low = _grow(x[low], gradient[low], weight[low], depth - 1, least, damping)
        node.high = _grow(x[~low], gradient[~low], weight[~low], depth - 1, least, damping)
    return node


def _apply(node: Node, x: np.ndarray) -> np.ndarray:
    if node.low is None or node.high is None:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.cut, _apply(node.low, x), _apply(node.high, x))


@dataclass
class Boosted:
    """Log-odds: a prior plus shrunken trees."""

    prior: float
    rate: float
    trees: list[Node]

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.prior)
        for t in self.trees:
            z += self.rate * _apply(t, x)
        return 1 / (1 + np.exp(-z))

    def sql(self, names: list[str]) -> str:
        """The probability as an expression over columns of these names."""

        def text(n: Node) -> str:
            if n.low is None or n.high is None:
                return f"({self.rate * n.value!r}D)"
            return f"IF({names[n.feature]} <= {n.cut!r}D, {text(n.low)}, {text(n.high)})"

        return f"1D / (1D + exp(-({' + '.join([f'({self.prior!r}D)', *map(text, self.trees)])})))"


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, least: int = 5, damping: float = 1.0) -> Boosted:
    """Boosting on the logistic loss. The prior is smoothed, so a sample of one class (or of no rows) gives a defined model."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Boosted(float(np.log(share / (1 - share))), rate, [])
    z = np.full(len(y), model.prior)
    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-z))
        tree = _grow(x, y - p, p * (1 - p), depth, least, damping)
        model.trees.append(tree)
        z += rate * _apply(tree, x)
    return model


def threshold(scores: np.ndarray, y: np.ndarray, precision: float, default: float = 0.5) -> float:
    """The least score at or above which the share of positives is at least ``precision``; the default if there is none."""
    order = np.argsort(-scores, kind="stable")
    good = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last_of_tie = np.append(scores[order][1:] != scores[order][:-1], True) if len(y) else np.zeros(0, bool)
    ok = np.nonzero((good >= precision) & last_of_tie)[0]
    return float(scores[order][ok[-1]]) if len(ok) else default
