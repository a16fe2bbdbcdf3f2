"""Putting pooled predictions of several models side by side."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcurve.operators.running import ordinal
from foldcurve.operators.scale import by_fold, fitted

ROW = ("fold_id", "row_id")


def pool(*parts: DataFrame) -> DataFrame:
    """All fold outputs together; duplicates stay."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def side_by_side(
    predictions: DataFrame, models: Sequence[str], value: str, rows: Sequence[str] = ROW, also: Sequence[str] = ()
) -> DataFrame:
    """One row per tested row, one column per model.

    The model list is given, so this is one aggregation on the row key, with no
    job to find the columns. `also` names columns that are equal for all models.
    """
    return predictions.groupBy(*rows).agg(
        *[F.max(F.when(F.col("model") == m, F.col(value))).alias(m) for m in models],
        *[F.max(c).alias(c) for c in also],
    )


def result_table(predictions: DataFrame, models: Sequence[str], rows: Sequence[str] = ROW) -> DataFrame:
    """Score of every model and the label, per tested row."""
    wide = side_by_side(predictions, models, "p", rows, also=["y"])
    return wide.select(*rows, *models, F.col("y").cast("double").alias("class"))


def class_table(predictions: DataFrame, models: Sequence[str], rows: Sequence[str] = ROW) -> DataFrame:
    """True label per model and tested row: equal columns if the models saw the same rows."""
    return side_by_side(predictions.withColumn("y", F.col("y").cast("double")), models, "y", rows)


def correct(predictions: DataFrame) -> DataFrame:
    """Add `correct`: 1.0 where label and predicted class agree, else 0.0."""
    return predictions.withColumn("correct", (F.col("y") == F.col("yhat")).cast("double"))


def correctness_table(predictions: DataFrame, models: Sequence[str], rows: Sequence[str] = ROW) -> DataFrame:
    return side_by_side(correct(predictions), models, "correct", rows)


def accuracy(predictions: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    return correct(predictions).groupBy(*keys).agg(
        F.sum(F.col("correct").cast("long")).alias("n_correct"),
        F.count(F.lit(1)).alias("n"),
        F.avg("correct").alias("accuracy"),
    )


def parameter_table(best: DataFrame, models: Sequence[str]) -> DataFrame:
    """Best parameters as JSON text: one row per fold, one column per model."""
    return side_by_side(best.withColumn("params", F.to_json("params")), models, "params", rows=["fold_id"])


def with_position(df: DataFrame, fold: str | None, key: str, name: str = "position") -> DataFrame:
    """Position of each row in pooled order: by fold, then key (a LONG), from 1.

    Folds are few, so their start positions are a few numbers.
    """
    if fold is None:
        return ordinal(df, [], key, name)
    counts = fitted(df.groupBy(fold).agg(F.count(F.lit(1)).alias("n")).orderBy(fold))
    starts = itertools.accumulate([r["n"] for r in counts], initial=0)
    placed = ordinal(df, [fold], key, "__in_fold")
    start = by_fold({r[fold]: n for r, n in zip(counts, starts)}, fold)
    return placed.withColumn(name, F.col("__in_fold") + start).drop("__in_fold")


def attach_by_position(
    results: DataFrame, baseline: DataFrame, columns: Sequence[str], fold: str | None, key: str, baseline_key: str
) -> DataFrame:
    """Join the rows of `baseline` to pooled results by position. Both tables must have the same number of rows."""
    n, m = results.count(), baseline.count()
    if n != m:
        raise ValueError(f"{n} results but {m} baseline rows")
    left = with_position(results, fold, key)
    right = with_position(baseline, None, baseline_key).select("position", *columns)
    return left.join(right, "position")


def to_long(wide: DataFrame, models: Sequence[str], label: str = "class", keep: Sequence[str] = ()) -> DataFrame:
    """Score table -> one row per model and row: the input of the ROC report."""
    return wide.unpivot([*keep, label], list(models), "model", "p").withColumnRenamed(label, "y")
