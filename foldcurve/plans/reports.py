"""Tables about fitted models: features, coefficients, trees, expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcurve.operators.symbolic import depth, length, to_text
from foldcurve.plans.evaluate import FoldFit
from foldcurve.plans.stacked_trees import TreeModel


def selection_table(spark: SparkSession, fits: Sequence[FoldFit], names: Sequence[str]) -> DataFrame:
    """(fold_id, model, index, feature, selected): the support of the selection in each fold."""
    rows = [(f.fold_id, f.model, i, c, i in set(f.selected)) for f in fits for i, c in enumerate(names)]
    return spark.createDataFrame(rows, "fold_id int, model string, index int, feature string, selected boolean")


def selection_frequency(selection: DataFrame) -> DataFrame:
    """Share of the folds that select each feature."""
    return selection.groupBy("model", "index", "feature").agg(
        F.count_if("selected").alias("n_selected"), F.avg(F.col("selected").cast("double")).alias("frequency")
    )


def coefficient_table(spark: SparkSession, fits: Sequence[FoldFit]) -> DataFrame:
    """(fold_id, model, index, feature, coefficient) of logistic models."""
    rows = [
        (f.fold_id, f.model, i, f.names[i], float(w)) for f in fits for i, w in enumerate(f.fitted.coefficients)
    ]
    return spark.createDataFrame(rows, "fold_id int, model string, index int, feature string, coefficient double")


def expression_table(spark: SparkSession, fits: Sequence[FoldFit]) -> DataFrame:
    """(fold_id, model, text, fitness, depth, length) of symbolic models."""
    rows = [
        (f.fold_id, f.model, to_text(f.fitted.tree), float(f.fitted.fitness), depth(f.fitted.tree), length(f.fitted.tree))
        for f in fits
    ]
    return spark.createDataFrame(
        rows, "fold_id int, model string, text string, fitness double, depth int, length int"
    )


NODES = "fold_id int, model string, node_id int, left int, right int, feature int, threshold double"


def node_rows(fold_id: int, name: str, tree: Model) -> list[tuple]:
    """The nodes of one fitted tree, numbered in preorder from 0."""
    out: list[list] = []
    waiting = [(tree._call_java("rootNode"), None, None)]
    while waiting:
        node, parent, side = waiting.pop()
        number = len(out)
        if parent is not None:
            out[parent][side] = number
        split = node.getClass().getSimpleName() == "InternalNode"
        feature = node.split().featureIndex() if split else None
        out.append([fold_id, name, number, None, None, feature, node.split().threshold() if split else None])
        if split:
            waiting.append((node.rightChild(), number, 4))
            waiting.append((node.leftChild(), number, 3))
    return [tuple(r) for r in out]


def tree_table(spark: SparkSession, fits: Sequence[FoldFit]) -> DataFrame:
    """Node table of decision trees: (fold_id, model, node_id, left, right, feature, threshold). Features are numbered as in `names`."""
    rows = []
    for f in fits:
        if isinstance(f.fitted, TreeModel):
            rows += [(f.fold_id, f.model, n, left, right, None if x is None else f.selected.index(x), at) for n, left, right, x, at in f.fitted.tree.rows()]
        else:
            rows += node_rows(f.fold_id, f.model, f.fitted)
    return spark.createDataFrame(rows, NODES)


def tree_structure(nodes: DataFrame) -> DataFrame:
    """Add depth and leaf flag to the nodes of many trees, walking down level by level."""
    return nodes.sparkSession.sql(
        """
        with recursive walk (fold_id, model, node_id, depth) as (
          select fold_id, model, node_id, 0 from {nodes} where node_id = 0
          union all
          select n.fold_id, n.model, explode(array(n.left, n.right)), w.depth + 1
          from walk w join {nodes} n
            on n.fold_id = w.fold_id and n.model = w.model and n.node_id = w.node_id
          where n.left is not null)
        select n.*, w.depth, n.left is null as is_leaf
        from {nodes} n join walk w
          on n.fold_id = w.fold_id and n.model = w.model and n.node_id = w.node_id
        """,
        nodes=nodes,
    )


def node_text(structure: DataFrame) -> DataFrame:
    """One line of text per node, indented by its depth."""
    return structure.withColumn(
        "text",
        F.expr(
            "concat(repeat('  ', depth), '#', node_id, if(is_leaf, ': leaf', concat(': feature ', feature, ' up to ', threshold, ' -> #', left, ', above -> #', right)))"
        ),
    )
