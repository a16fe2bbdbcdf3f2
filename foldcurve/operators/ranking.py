"""Grids of parameters, their best cell, and rankings of features."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def grid_cells(values: Mapping[str, Sequence]) -> list[dict]:
    """All combinations of the value lists; the last name varies fastest."""
    return [dict(zip(values, combination)) for combination in itertools.product(*values.values())]


def grid_table(spark: SparkSession, values: Mapping[str, Sequence]) -> DataFrame:
    """(cell, params): the grid as a table, parameters as text."""
    rows = [(i, {k: str(v) for k, v in cell.items()}) for i, cell in enumerate(grid_cells(values))]
    return spark.createDataFrame(rows, "cell int, params map<string,string>")


def mean_scores(scores: DataFrame, keys: Sequence[str] = ("fold_id", "model"), cell: str = "cell", score: str = "auc") -> DataFrame:
    """Mean score of each grid cell over the inner folds."""
    return scores.groupBy(*keys, cell).agg(F.avg(score).alias("mean_score"))


def best_cell(means: DataFrame, keys: Sequence[str] = ("fold_id", "model"), cell: str = "cell", score: str = "mean_score") -> DataFrame:
    """The cell with the greatest score; the first in grid order on ties.

    An aggregation, not a ranking: partial results are one row per key.
    """
    # Negated cell number, so that the greatest struct is the earliest cell.
    best = F.max(F.struct(F.col(score), (-F.col(cell)).alias("order"))).alias("best")
    return means.groupBy(*keys).agg(best).select(
        *keys, (-F.col("best.order")).alias(cell), F.col(f"best.{score}").alias(score)
    )


def importance_rank(importances: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rank (index, value) rows: greatest value first, larger index first on ties; keep flag at the mean.

    One row per feature, so each group is small.
    """
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    return importances.select(
        "*",
        F.row_number().over(group.orderBy(F.desc("value"), F.desc("index"))).alias("rank"),
        F.avg("value").over(group).alias("mean_value"),
        (F.col("value") >= F.avg("value").over(group)).alias("selected"),
    )


def selected_features(ranked: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Indexes of the selected features, ascending, as a list and as text."""
    chosen = ranked.where("selected").groupBy(*keys).agg(F.sort_array(F.collect_list("index")).alias("features"))
    return chosen.withColumn("text", F.concat_ws(", ", F.col("features").cast("array<string>")))


def weakest(weights: Sequence[float]) -> int:
    """Position of the feature to drop: least squared weight, first on ties."""
    return min(range(len(weights)), key=lambda i: (weights[i] ** 2, i))
