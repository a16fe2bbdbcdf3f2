"""Writers of the tables an evaluation makes.

All runs share one folder per kind of table, partitioned by data set, experiment
and variant, so that a report over some runs reads those runs only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcurve.operators.align import class_table, correctness_table, parameter_table, result_table

RUN = ("dataset", "experiment", "variant")


def write_run(df: DataFrame, folder: str, kind: str, run: Mapping[str, str], format: str = "parquet") -> str:
    """Write one run's table; a repeated run replaces its own partition only."""
    path = f"{folder}/{kind}"
    named = df.select("*", *[F.lit(run[c]).alias(c) for c in RUN])
    writer = named.write.mode("overwrite").partitionBy(*RUN).option("partitionOverwriteMode", "dynamic")
    if format == "csv":
        writer = writer.option("header", True)
    writer.format(format).save(path)
    return path


def write_class(predictions: DataFrame, models: Sequence[str], folder: str, run: Mapping[str, str], **how) -> str:
    return write_run(class_table(predictions, models), folder, "class", run, **how)


def write_params(best: DataFrame, models: Sequence[str], folder: str, run: Mapping[str, str], **how) -> str:
    return write_run(parameter_table(best, models), folder, "params", run, **how)


def write_cc(predictions: DataFrame, models: Sequence[str], folder: str, run: Mapping[str, str], **how) -> str:
    return write_run(correctness_table(predictions, models), folder, "cc", run, **how)


def write_result(predictions: DataFrame, models: Sequence[str], folder: str, run: Mapping[str, str], baseline: DataFrame | None = None, **how) -> str:
    """Scores of all models; `baseline` is a (fold_id, row_id, score) table joined on the row key."""
    wide = result_table(predictions, models)
    if baseline is not None:
        wide = wide.join(baseline, ["fold_id", "row_id"])
    return write_run(wide, folder, "result", run, **how)


def write_roc(report: DataFrame, folder: str, run: Mapping[str, str], **how) -> str:
    return write_run(report, folder, "roc", run, **how)
