"""Regression trees as plain values: forks and leaves, and arrays of nodes that score many rows at once."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Leaf:
    place: int
    value: float = 0.0


@dataclass(frozen=True)
class Fork:
    feature: int
    threshold: float
    left: Fork | Leaf
    right: Fork | Leaf
    gain: float = 0.0


@dataclass(frozen=True)
class Sums:
    """Count, residual sum and sum of squared residuals of some rows."""

    n: int = 0
    total: float = 0.0
    squares: float = 0.0

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.n + other.n, self.total + other.total, self.squares + other.squares)

    def error_after(self, step: float) -> float:
        """Sum of squared residuals once ``step`` is added to every prediction."""
        return self.squares - 2 * step * self.total + self.n * step * step


def read_tree(description: str, columns: Sequence[int]) -> Fork | Leaf:
    """Nodes of a tree in Spark's text form; ``columns`` are the places of its features."""
    places = itertools.count()
    lines = iter(line.strip() for line in description.splitlines()[1:])

    def node() -> Fork | Leaf:
        line = next(lines)
        fork = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
        if not fork:
            return Leaf(next(places), float(line.removeprefix("Predict: ")))
        left = node()
        next(lines)  # the line of the other branch
        return Fork(columns[int(fork[1])], float(fork[2]), left, node())

    return node()


def forks(tree: Fork | Leaf) -> Iterator[Fork]:
    if isinstance(tree, Fork):
        yield tree
        yield from forks(tree.left)
        yield from forks(tree.right)


def values_of_places(shape: Fork | Leaf, tree: Fork | Leaf) -> dict[int, float]:
    """Value of every leaf of the unfolded tree."""
    if isinstance(shape, Leaf):
        return {shape.place: tree.value}
    left, right = (tree, tree) if isinstance(tree, Leaf) else (tree.left, tree.right)
    return values_of_places(shape.left, left) | values_of_places(shape.right, right)


@dataclass(frozen=True)
class Nodes:
    """A tree as arrays of its nodes, the root first. A leaf leads to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The value of every row of ``x``."""
        at, rows = np.zeros(len(x), dtype=np.int32), np.arange(len(x))
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.value[at]


def nodes(tree: Fork | Leaf, value: Callable[[Leaf], float] = lambda leaf: leaf.value) -> Nodes:
    made: list[list] = []

    def add(node: Fork | Leaf) -> tuple[int, int]:
        at = len(made)
        if isinstance(node, Leaf):
            made.append([0, 0.0, at, at, value(node)])
            return at, 0
        made.append([node.feature, node.threshold, 0, 0, 0.0])
        (left, a), (right, b) = add(node.left), add(node.right)
        made[at][2:4] = left, right
        return at, 1 + max(a, b)

    _, depth = add(tree)
    feature, threshold, left, right, values = zip(*made)
    whole = (np.array(c, dtype=np.int32) for c in (feature, left, right))
    feature, left, right = whole
    return Nodes(feature, np.array(threshold), left, right, np.array(values), depth)
