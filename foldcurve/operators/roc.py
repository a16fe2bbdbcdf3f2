"""ROC curves and the statistics read from them, for many curves in one plan."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldcurve.functions.ordering import with_sortable_bits
from foldcurve.operators.running import CELL_ROWS, running_totals

LEVELS = (0.90, 0.75)
# The intervals of sensitivity and specificity use this rounded quantile.
SIMPLE_Z = 1.96
SPLIT = 20


def checked_label(label: str) -> Column:
    y = F.col(label).cast("long")
    return F.when(y.isNull() | y.isin(0, 1), y).otherwise(F.raise_error(F.concat(F.lit("a label is neither 0 nor 1: "), y.cast("string"))).cast("long"))


def roc_points(
    predictions: DataFrame,
    keys: Sequence[str] = ("model",),
    label: str = "y",
    score: str = "p",
    *,
    times: str | None = None,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """One row per distinct score and curve, by falling score, after the origin.

    With `times`, a row stands for as many equal ones as that column says.

    Columns: keys, threshold, pos, neg (rows at this score), tp, fp (rows at or
    above it), positives, negatives, tpr, fpr. Rows without score or label are
    on no curve; a label besides 0 and 1 fails the job. Equal scores are merged before anything is shuffled, so a score
    that many rows share costs one row per task.
    """
    keys = list(keys)
    known = predictions.select(
        *keys, checked_label(label).alias("__y"), F.col(score).cast("double").alias("threshold"), (F.col(times) if times else F.lit(1)).cast("long").alias("__n")
    ).where("__y is not null and threshold is not null")
    counts = (
        with_sortable_bits(known, "threshold", "__bits")
        .groupBy(*keys, "threshold", F.expr("-__bits as __order"))
        .agg(F.expr("sum(__n * __y) as pos"), F.expr("sum(__n * (1 - __y)) as neg"))
    )
    swept = running_totals(counts, keys, "__order", ["pos", "neg"], with_start=True, cell_rows=cell_rows)
    return swept.select(
        *keys,
        F.expr("if(__order is null, double('infinity'), threshold) as threshold"),
        F.expr("if(__order is null, 0L, pos) as pos"),
        F.expr("if(__order is null, 0L, neg) as neg"),
        F.expr("through_pos as tp"),
        F.expr("through_neg as fp"),
        F.expr("total_pos as positives"),
        F.expr("total_neg as negatives"),
        F.expr("try_divide(through_pos, total_pos) as tpr"),
        F.expr("try_divide(through_neg, total_neg) as fpr"),
    )


def _whole_sum(weight: str, factor: str, name: str) -> list[Column]:
    """sum(weight * factor) as two whole sums `<name>_hi`, `<name>_lo`.

    The plain sum passes 2**63 near 10**9 rows of each class. With the factor
    split at bit 20 both sums fit a LONG up to 10**12 rows of each class, and
    whole numbers add up the same in any order.
    """
    mask = (1 << SPLIT) - 1
    return [
        F.expr(f"sum({weight} * shiftright({factor}, {SPLIT})) as {name}_hi"),
        F.expr(f"sum({weight} * (({factor}) & {mask}L)) as {name}_lo"),
    ]


def _joined(name: str) -> str:
    return f"(double({name}_hi) * {1 << SPLIT} + double({name}_lo))"


def _area_sums() -> list[Column]:
    # Twice the area, in steps of one row of each class.
    return _whole_sum("neg", "2 * tp - pos", "__area")


# Division here is try_divide throughout: Spark may compute a shared sub-expression
# ahead of the test that guards it, and plain division by zero is an error.
AREA = f"try_divide({_joined('__area')}, 2.0d * double(positives) * double(negatives))"


def _counts() -> list[Column]:
    return [F.max("positives").alias("positives"), F.max("negatives").alias("negatives")]


def sensitivity_at(level: float) -> Column:
    """Aggregate: sensitivity at a fixed specificity, on the segment that holds 1 - level."""
    x = 1 - level
    if not 0 <= x <= 1:
        raise ValueError("a specificity level lies between 0 and 1")
    if x == 1:
        return F.max("tpr")
    x0, y0, at = "try_divide(fp - neg, negatives)", "try_divide(tp - pos, positives)", f"{x!r}d"
    return F.expr(
        f"max(case when positives > 0 and neg > 0 and {x0} <= {at} and fpr > {at}"
        f" then try_divide(tpr - {y0}, fpr - {x0}) * ({at} - {x0}) + {y0} end)"
    )


def best_point() -> Column:
    """Aggregate: the point nearest to the corner (0, 1); the highest threshold on ties."""
    distance = "sqrt((1 - tpr) * (1 - tpr) + fpr * fpr)"
    return F.expr(
        f"min(case when tpr is not null and fpr is not null then named_struct('distance', {distance},"
        " 'rank', -threshold, 'threshold', threshold, 'sensitivity', tpr, 'specificity', 1 - fpr) end)"
    )


def standard_error(auc: str = "AUC") -> str:
    """Standard error of an area under the curve (Hanley and McNeil, 1982), as SQL text."""
    square = f"({auc} * {auc})"
    return (
        f"sqrt(try_divide({auc} * (1 - {auc}) + (positives - 1) * ({auc} / (2 - {auc}) - {square})"
        f" + (negatives - 1) * (2 * {square} / (1 + {auc}) - {square}), double(positives) * double(negatives)))"
    )


def normal_quantile(alpha: float) -> float:
    return NormalDist().inv_cdf(1 - alpha / 2)


def share_half_width(share: str, rows: str) -> str:
    """Half of the simple asymptotic interval of a share seen over `rows` rows, as SQL text."""
    return f"{SIMPLE_Z}d * sqrt(try_divide({share} * (1 - {share}), {rows}))"


def _interval(center: str, half: str, name: str) -> list[str]:
    return [f"{center} - {half} as {name}_lo", f"{center} + {half} as {name}_hi"]


def auc(predictions: DataFrame, keys: Sequence[str] = ("model",), label: str = "y", score: str = "p", **how) -> DataFrame:
    """keys, positives, negatives, auc. Null where only one class is present."""
    points = roc_points(predictions, keys, label, score, **how)
    sums = points.groupBy(*keys).agg(*_counts(), *_area_sums())
    return sums.select(*keys, "positives", "negatives", F.expr(f"{AREA} as auc"))


def auc_interval(areas: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Add SE, AucCI_lo, AucCI_hi to rows with auc, positives, negatives."""
    rated = areas.withColumn("SE", F.expr(standard_error("auc")))
    return rated.selectExpr("*", *_interval("auc", f"{normal_quantile(alpha)!r}d * SE", "AucCI"))


def optimal_cutoff(predictions: DataFrame, keys: Sequence[str] = ("model",), label: str = "y", score: str = "p", **how) -> DataFrame:
    """keys, positives, negatives, sensitivity, specificity, threshold, distance."""
    points = roc_points(predictions, keys, label, score, **how)
    best = points.groupBy(*keys).agg(*_counts(), best_point().alias("best"))
    return best.select(
        *keys,
        "positives",
        "negatives",
        *[F.col(f"best.{c}") for c in ("sensitivity", "specificity", "threshold", "distance")],
    )


def share_intervals(cutoffs: DataFrame) -> DataFrame:
    """Add the intervals of sensitivity and specificity to the rows of `optimal_cutoff`."""
    return cutoffs.selectExpr(
        "*",
        *_interval("sensitivity", share_half_width("sensitivity", "positives"), "SenCI"),
        *_interval("specificity", share_half_width("specificity", "negatives"), "SpeCI"),
    )


def sensitivity_at_specificity(
    predictions: DataFrame,
    levels: Sequence[float] = LEVELS,
    keys: Sequence[str] = ("model",),
    label: str = "y",
    score: str = "p",
    **how,
) -> DataFrame:
    points = roc_points(predictions, keys, label, score, **how)
    return points.groupBy(*keys).agg(*[sensitivity_at(x).alias(f"SensLevel{i}") for i, x in enumerate(levels)])


def roc_report(
    predictions: DataFrame,
    keys: Sequence[str] = ("model",),
    levels: Sequence[float] = LEVELS,
    label: str = "y",
    score: str = "p",
    alpha: float = 0.05,
    **how,
) -> DataFrame:
    """All statistics of every curve, from one pass over its points."""
    keys = list(keys)
    points = roc_points(predictions, keys, label, score, **how)
    sums = points.groupBy(*keys).agg(
        *_counts(),
        *_area_sums(),
        best_point().alias("best"),
        *[sensitivity_at(x).alias(f"SensLevel{i}") for i, x in enumerate(levels)],
    )
    named = sums.select(
        "*", F.expr(f"{AREA} as AUC"), F.expr("best.sensitivity as OpSen"), F.expr("best.specificity as OpSpe")
    )
    rated = named.withColumn("SE", F.expr(standard_error()))
    columns = [
        *[f"SensLevel{i}" for i in range(len(levels))],
        "AUC",
        *_interval("AUC", f"{normal_quantile(alpha)!r}d * SE", "AucCI"),
        "SE",
        "OpSen",
        *_interval("OpSen", share_half_width("OpSen", "positives"), "SenCI"),
        "OpSpe",
        *_interval("OpSpe", share_half_width("OpSpe", "negatives"), "SpeCI"),
    ]
    return rated.select(*keys, *[F.expr(c) for c in columns])


def auc_rank_sum(predictions: DataFrame, keys: Sequence[str] = ("model",), label: str = "y", score: str = "p", **how) -> DataFrame:
    """The same area from average ranks, an independent formula."""
    points = roc_points(predictions, keys, label, score, **how)
    # Average rank from below of the rows at a score, doubled to stay whole.
    rank = "2 * (positives + negatives - tp - fp) + pos + neg + 1"
    sums = points.groupBy(*keys).agg(*_counts(), *_whole_sum("pos", rank, "__rank"))
    p, n = "double(positives)", "double(negatives)"
    area = f"try_divide({_joined('__rank')} - {p} * ({p} + 1), 2.0d * {p} * {n})"
    return sums.select(*keys, "positives", "negatives", F.expr(f"{area} as auc"))
