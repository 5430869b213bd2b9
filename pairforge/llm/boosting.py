"""Gradient boosted trees on a table of feature cells, scored as a column expression.

Features are small integers, so rows with equal features are one cell: a
grouping over all rows gives counts and positives of each cell, and the trees
are fitted on the cells.  The number of cells is bounded by the product of the
features' sizes, whatever the number of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, functions as F

ROUNDS, RATE, RIDGE, DEPTH = 30, 0.3, 1.0, 2


@dataclass
class Split:
    feature: int
    at: int  # left: value <= at
    left: "Split | float"
    right: "Split | float"


@dataclass
class Trees:
    names: list[str]
    base: float
    trees: list[Split | float]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += _walk(tree, x)
        return out

    def column(self, of) -> Column:
        """The margin (log odds) from ``of(name)``, the column of a feature."""
        total = F.lit(float(self.base))
        for tree in self.trees:
            total = total + _column(tree, self.names, of)
        return total


def _walk(tree: Split | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, Split):
        return np.full(len(x), tree)
    return np.where(x[:, tree.feature] <= tree.at, _walk(tree.left, x), _walk(tree.right, x))


def _column(tree: Split | float, names: list[str], of) -> Column:
    if not isinstance(tree, Split):
        return F.lit(float(tree))
    left, right = (_column(t, names, of) for t in (tree.left, tree.right))
    return F.when(of(names[tree.feature]) <= tree.at, left).otherwise(right)


def _grow(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, depth: int) -> Split | float:
    g, h = gradient.sum(), weight.sum()
    leaf = float(RATE * g / (h + RIDGE))
    best, choice = 1e-6, None
    for f in range(x.shape[1] if depth else 0):
        values = x[:, f]
        size = int(values.max()) + 1
        gl, hl = np.cumsum(np.bincount(values, gradient, size)), np.cumsum(np.bincount(values, weight, size))
        gain = gl**2 / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g**2 / (h + RIDGE)
        at = int(gain[:-1].argmax()) if size > 1 else 0
        if size > 1 and gain[at] > best:
            best, choice = gain[at], (f, at)
    if choice is None:
        return leaf
    low = x[:, choice[0]] <= choice[1]
    return Split(*choice, *(_grow(x[m], gradient[m], weight[m], depth - 1) for m in (low, ~low)))


def fit(names: list[str], x: np.ndarray, n: np.ndarray, positive: np.ndarray) -> Trees:
    """Logistic boosting; ``n`` rows and ``positive`` ones of each cell ``x``."""
    total = n.sum()
    rate = min(max(positive.sum() / max(total, 1), 1e-4), 1 - 1e-4)
    model = Trees(names, math.log(rate / (1 - rate)), [])
    if not total:
        return model
    margin = model.margin(x)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, positive - n * p, n * p * (1 - p), DEPTH)
        model.trees.append(tree)
        margin += _walk(tree, x)
    return model


def least_margin(margin: np.ndarray, n: np.ndarray, positive: np.ndarray, precision: float) -> float:
    """The lowest margin from which on judged precision is at least ``precision``; infinite if none is.

    Half a hit is added to the hits and one to the rows, so a few rows count for
    less than they show, but a handful of hits without a miss is enough.
    """
    order = np.argsort(-margin, kind="stable")
    total, hits, cut = np.cumsum(n[order]), np.cumsum(positive[order]), margin[order]
    last = np.append(cut[1:] != cut[:-1], True) if len(cut) else np.zeros(0, bool)
    good = last & ((hits + 0.5) / (total + 1) >= precision)
    return float(cut[good].min()) if good.any() else math.inf
