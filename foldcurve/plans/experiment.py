"""One parameterised evaluation job: data set x experiment x variant.

It reads features with their outer folds, evaluates each model, pools the tested
rows, and writes the class, parameter, correctness, result and ROC tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcurve.operators.align import attach_by_position, pool, result_table
from foldcurve.operators.roc import LEVELS, roc_report
from foldcurve.plans.evaluate import FoldFit, evaluate
from foldcurve.plans.registry import (
    ALL_MODELS,
    FUZZY_GP_GRID,
    FUZZY_SELECT_SIZES,
    MODELS,
    SELECT_SIZES,
    ModelSpec,
)
from foldcurve.sources import sinks


@dataclass(frozen=True)
class Run:
    """`experiment` is "plain" or "selection", `variant` is "crisp" or "fuzzy"."""

    dataset: str
    experiment: str = "plain"
    variant: str = "crisp"
    models: Sequence[str] = tuple(ALL_MODELS)
    n_inner: int = 10
    n_sets: int = 3
    grids: Mapping[str, Mapping[str, Sequence]] = field(default_factory=dict)
    sizes: Sequence[int] | None = None

    def key(self) -> dict[str, str]:
        return dict(zip(sinks.RUN, (self.dataset, self.experiment, self.variant)))

    def spec(self, name: str) -> ModelSpec:
        if name in self.grids:
            return MODELS[name].with_grid(**self.grids[name])
        if name == "GP" and self.variant == "fuzzy":
            return MODELS[name].with_grid(**FUZZY_GP_GRID)
        return MODELS[name]

    def select(self) -> Sequence[int] | None:
        if self.experiment != "selection":
            return None
        return self.sizes or (FUZZY_SELECT_SIZES if self.variant == "fuzzy" else SELECT_SIZES)


def parts_from_folds(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows with the fold that tests them in `part`, from a fold table that tests every row once."""
    tested = folds.where("role = 'test'").select("row_id", F.col("fold_id").cast("int").alias("part"))
    return df.join(tested, "row_id")


def run_experiment(
    df: DataFrame,
    columns: Sequence[str],
    run: Run,
    folder: str,
    *,
    n_outer: int | None = None,
    folds: DataFrame | None = None,
    baseline: DataFrame | None = None,
    baseline_name: str = "BFP",
    parallelism: int = 1,
) -> tuple[DataFrame, list[FoldFit]]:
    """Evaluate and write all tables of one run; returns the ROC report and the fits.

    Outer folds are `n_outer` parts or a role table `folds`, as in `evaluate`.
    `baseline` has `row_id` and a score column named `baseline_name`.
    """
    evaluations = [
        evaluate(
            df,
            run.spec(name),
            columns,
            n_outer=n_outer,
            folds=folds,
            n_inner=run.n_inner,
            n_sets=run.n_sets if run.variant == "fuzzy" else None,
            select=run.select(),
            parallelism=parallelism,
        )
        for name in run.models
    ]
    # Written once and read by five tables; scoring is not repeated.
    predictions = pool(*[e.predictions for e in evaluations]).persist(StorageLevel.MEMORY_AND_DISK)
    best = pool(*[e.best() for e in evaluations])
    models, key = list(run.models), run.key()

    reported = predictions.select("model", "y", "p")
    scores = None
    if baseline is not None:
        first = predictions.where(F.col("model") == models[0])
        scores = first.select("fold_id", "row_id", "y").join(baseline.select("row_id", baseline_name), "row_id")
        reported = reported.unionByName(scores.select(F.lit(baseline_name).alias("model"), "y", F.col(baseline_name).alias("p")))
        scores = scores.select("fold_id", "row_id", baseline_name)
    report = roc_report(reported, ["model"], LEVELS)

    sinks.write_class(predictions, models, folder, key)
    sinks.write_params(best, models, folder, key)
    sinks.write_cc(predictions, models, folder, key)
    sinks.write_result(predictions, models, folder, key, scores)
    sinks.write_roc(report, folder, key)
    return report, [f for e in evaluations for f in e.fits]


def replay(results: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """The ROC report of stored scores, (model, y, p) rows from `read_results`."""
    return roc_report(results, ["model"], levels)


def results_with_baseline(predictions: DataFrame, models: Sequence[str], baseline: DataFrame, column: str, baseline_key: str) -> DataFrame:
    """Score table with a baseline column that matches the pooled rows by position only."""
    wide = result_table(predictions, models)
    return attach_by_position(wide, baseline, [column], "fold_id", "row_id", baseline_key)
