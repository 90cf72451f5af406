"""Models as column expressions: fitted trees as arrays of nodes, and formulas.

A tree model of Spark ML scores a table, so a forecast that feeds its own predictions back
needs a table per step. As arrays the trees fit into the same projection as the features,
and all steps of a series are one expression over its row.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TREE_MODELS = (DecisionTreeRegressionModel, GBTRegressionModel, RandomForestRegressionModel)
#: The lines of a model's printed form: a node's question, its other side, a leaf, and the next tree.
_IF = re.compile(r"\s*If \(feature (\d+) <= (\S+)\)")
_ELSE = re.compile(r"\s*Else \(feature \d+ > \S+\)")
_LEAF = re.compile(r"\s*Predict: (\S+)")
_TREE = re.compile(r"\s*Tree \d+")


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees one after another; a leaf has feature -1. ``inputs`` are the features' names."""

    inputs: list[str]
    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]
    roots: list[int]
    weights: list[float]
    depth: int

    def row(self, spark: SparkSession) -> DataFrame:
        """The trees as one row with the column ``_forest``."""
        import pyarrow as pa

        ints, doubles = pa.list_(pa.int32()), pa.list_(pa.float64())
        table = pa.table({"feature": pa.array([self.feature], ints), "threshold": pa.array([self.threshold], doubles),
                          "left": pa.array([self.left], ints), "right": pa.array([self.right], ints),
                          "value": pa.array([self.value], doubles), "roots": pa.array([self.roots], ints),
                          "weights": pa.array([self.weights], doubles)})
        return spark.createDataFrame(table).select(F.struct("*").alias("_forest"))

    def score(self, x: Column, forest: Column) -> Column:
        """The prediction for the array ``x`` of features."""
        def leaf(root: Column) -> Column:
            def down(node: Column, _: Column) -> Column:
                at = F.get(forest.feature, node)
                below = F.get(x, at) <= F.get(forest.threshold, node)
                return F.when(at < 0, node).when(below, F.get(forest.left, node)).otherwise(F.get(forest.right, node))

            return F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), root, down) if self.depth else root

        trees = F.arrays_zip(forest.roots.alias("root"), forest.weights.alias("weight"))
        return F.aggregate(trees, F.lit(0.0), lambda sum_, t: sum_ + t.weight * F.get(forest.value, leaf(t.root)))


@dataclass(frozen=True)
class Formula:
    """A model that is a formula of its features; ``text`` gets a function from a name to its column."""

    inputs: list[str]
    text: Callable[[Callable[[str], Column]], Column]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select("*", self.text(F.col).alias("predicted"))

    def score(self, x: Column, _: Column) -> Column:
        return self.text(lambda name: F.get(x, self.inputs.index(name))).cast("double")

    def row(self, spark: SparkSession) -> DataFrame:
        """A formula needs no data."""
        return spark.range(1).select(F.lit(None).cast("int").alias("_forest"))


def expression_of(model: PipelineModel | Formula) -> Forest | Formula | None:
    """The model in a form that fits into an expression; None if there is none."""
    return model if isinstance(model, Formula) else forest_of(model)


def forest_of(model: PipelineModel) -> Forest | None:
    """The trees of a pipeline of a ``VectorAssembler`` and a tree model with continuous splits; None for others."""
    stages = getattr(model, "stages", None) or []
    if len(stages) != 2 or not isinstance(stages[0], VectorAssembler) or not isinstance(stages[1], TREE_MODELS):
        return None
    inputs = [c.strip("`") for c in stages[0].getInputCols()]
    text = stages[1].toDebugString
    weights = list(getattr(stages[1], "treeWeights", [1.0]))
    if isinstance(stages[1], RandomForestRegressionModel):
        weights = [w / sum(weights) for w in weights]
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    # Questions whose other side is still to come, innermost last.
    open_: list[int] = []
    depth = 0

    def put(f: int, t: float, v: float) -> int:
        for column, x in ((feature, f), (threshold, t), (left, -1), (right, -1), (value, v)):
            column.append(x)
        return len(feature) - 1

    parent: tuple[list[int], int] | None = None
    for line in text.splitlines()[1:]:
        if _TREE.fullmatch(line.split(" (weight")[0].rstrip(":")):
            open_, parent = [], None
            continue
        question, leaf = _IF.fullmatch(line), _LEAF.fullmatch(line)
        if _ELSE.fullmatch(line):
            parent = (right, open_.pop())
            continue
        if not question and not leaf:
            return None  # a split by category
        node = put(int(question[1]), float(question[2]), 0.0) if question else put(-1, 0.0, float(leaf[1]))
        if parent is None:
            roots.append(node)
        else:
            parent[0][parent[1]] = node
        if question:
            open_.append(node)
            parent = (left, node)
    for root in roots:
        level, here = 0, [root]
        while here := [c for n in here if feature[n] >= 0 for c in (left[n], right[n])]:
            level += 1
        depth = max(depth, level)
    if len(roots) != len(weights):
        return None
    return Forest(inputs, feature, threshold, left, right, value, roots, weights, depth)
