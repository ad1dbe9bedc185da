"""Fitted trees of Spark ML as rules and as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Condition:
    feature: str
    below: bool      # feature <= threshold, else >
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value <= self.threshold if self.below else value > self.threshold


def _inner(node) -> bool:
    return node.subtreeDepth() > 0


def rules_of(tree, names: list[str]) -> list[tuple[Condition, ...]]:
    """The paths from the root to every other node, as conjunctions of conditions."""
    out = []

    def walk(node, path: tuple[Condition, ...]) -> None:
        if path:
            out.append(path)
        if _inner(node):
            split = node.split()
            name, at = names[split.featureIndex()], split.threshold()
            walk(node.leftChild(), (*path, Condition(name, True, at)))
            walk(node.rightChild(), (*path, Condition(name, False, at)))

    walk(tree._call_java("rootNode"), ())
    return out


def prediction(tree, names: list[str]) -> Column:
    """The value of a regression tree."""

    def walk(node) -> Column:
        if not _inner(node):
            return F.lit(float(node.prediction()))
        split = node.split()
        low = F.col(names[split.featureIndex()]) <= split.threshold()
        return F.when(low, walk(node.leftChild())).otherwise(walk(node.rightChild()))

    return walk(tree._call_java("rootNode"))


def boosted_score(model, names: list[str]) -> Column:
    """Probability of class 1 of a boosted classifier."""
    margin = F.lit(0.0)
    for weight, tree in zip(model.treeWeights, model.trees, strict=True):
        margin = margin + float(weight) * prediction(tree, names)
    return 1 / (1 + F.exp(-2 * margin))
