"""Standardising features by training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcurve.operators.folds import training_moments


def fitted(table: DataFrame) -> list:
    """Bring a table of fitted settings to the driver: one row per fold and column, as many as the caller's settings make."""
    return table.collect()


def by_fold(values: dict[int, float], fold: str) -> F.Column:
    """The value for the row's fold, from a literal map; one value only needs no lookup."""
    if len(values) == 1:
        return F.lit(next(iter(values.values())))
    return F.element_at(F.create_map(*[F.lit(x) for k, v in sorted(values.items()) for x in (k, v)]), F.col(fold))


def standardize(df: DataFrame, columns: Sequence[str], moments: DataFrame | None = None, fold: str = "part") -> DataFrame:
    """Replace each column by its distance from the training mean in training deviations.

    `moments` is (fold_id, column, mean, std); by default each row is scaled by
    the training rows of the fold that tests it. A column that is constant on
    the training rows is only centred. Applying is a projection: no join.
    """
    moments = training_moments(df, columns, fold) if moments is None else moments
    means: dict[str, dict] = {c: {} for c in columns}
    deviations: dict[str, dict] = {c: {} for c in columns}
    for r in fitted(moments):
        means[r["column"]][r["fold_id"]] = r["mean"]
        deviations[r["column"]][r["fold_id"]] = r["std"] or 1.0
    scaled = {c: (F.col(f"`{c}`") - by_fold(means[c], fold)) / by_fold(deviations[c], fold) for c in columns}
    return df.withColumns(scaled)
