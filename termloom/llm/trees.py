"""Small binary classification trees on numeric tables that fit the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Node:
    """A leaf (feature < 0) or a split: left takes x[feature] <= at."""

    value: float
    feature: int = -1
    at: float = 0.0
    left: Node | None = None
    right: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int, min_leaf: int, features: np.ndarray | None = None) -> Node:
    """A Gini tree; ties go to the first feature and the lowest cut, which lies midway between two values."""
    value = float(y.mean()) if len(y) else 0.0
    if depth == 0 or len(y) < 2 * min_leaf or value in (0.0, 1.0):
        return Node(value)
    best = (len(y) * value * (1 - value) - 1e-9, -1, 0.0)
    for f in features if features is not None else range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, c = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        ok = (v[1:] > v[:-1]) & (n >= min_leaf) & (len(y) - n >= min_leaf)
        if not ok.any():
            continue
        left, right = c[:-1] / n, (c[-1] - c[:-1]) / (len(y) - n)
        cost = np.where(ok, n * left * (1 - left) + (len(y) - n) * right * (1 - right), np.inf)
        k = int(cost.argmin())
        if cost[k] < best[0]:
            best = (float(cost[k]), int(f), float((v[k] + v[k + 1]) / 2))
    if best[1] < 0:
        return Node(value)
    go = x[:, best[1]] <= best[2]
    return Node(value, best[1], best[2], grow(x[go], y[go], depth - 1, min_leaf, features), grow(x[~go], y[~go], depth - 1, min_leaf, features))


def predict(node: Node, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    stack = [(node, np.arange(len(x)))]
    while stack:
        n, at = stack.pop()
        if n.feature < 0:
            out[at] = n.value
        else:
            go = x[at, n.feature] <= n.at
            stack += [(n.left, at[go]), (n.right, at[~go])]
    return out


def paths(node: Node) -> list[tuple[tuple[int, str, float], ...]]:
    """Every path from the root to a node below it, as (feature, '<=' or '>', cut) conditions, merged by feature."""
    out: list[tuple[tuple[int, str, float], ...]] = []

    def walk(n: Node, conditions: dict[tuple[int, str], float]) -> None:
        if conditions:
            out.append(tuple((f, op, at) for (f, op), at in sorted(conditions.items())))
        if n.feature >= 0:
            le, gt = (n.feature, "<="), (n.feature, ">")
            walk(n.left, conditions | {le: min(n.at, conditions.get(le, np.inf))})
            walk(n.right, conditions | {gt: max(n.at, conditions.get(gt, -np.inf))})

    walk(node, {})
    return out
