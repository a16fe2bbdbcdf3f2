"""Fold assignment, fold roles, and statistics learned on training rows only.

A fold table is long: (fold_id, <key>, role). A table of rows that carries its
own test fold in a column `part` stands for the k-fold case: fold i tests the
rows with part = i and trains on all others. That form needs no copy of a row
per fold, so it is the one to use on large tables.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldcurve.operators.running import CELL_ROWS, ordinal

TRAIN, VALID, TEST = "train", "valid", "test"
SEED = 7


def stratified_folds(
    df: DataFrame,
    n_folds: int,
    label: str = "y",
    key: str = "row_id",
    seed: int | None = SEED,
    name: str = "part",
    *,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Deal the rows out to `n_folds` folds, so that the sizes of folds and of their classes differ by one at most.

    A class is dealt on from the fold at which the classes before it ended.
    Rows are dealt in hash order of the key; with seed None in key order, which
    needs a LONG key. Every class may be large: positions come from running
    totals over cells, not from one window per class.
    """
    order = F.xxhash64(key, F.lit(seed)) if seed is not None else F.col(key).cast("long")
    placed = ordinal(df.withColumn("__deal", order), [label], "__deal", "__nth", ties=[key], cell_rows=cell_rows)
    # One row per class.
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(F.col(label).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(label).alias("__class"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    dealt = placed.join(starts, F.col(label).eqNullSafe(F.col("__class")))
    return dealt.withColumn(name, F.expr(f"int((__start + __nth - 1) % {n_folds})")).drop("__deal", "__nth", "__class", "__start")


def fold_roles(df: DataFrame, n_folds: int, part: str = "part", valid: bool = True) -> DataFrame:
    """Every fold sees every row with its role: one output row per fold and row.

    Fold i tests part i; with `valid` the part after it is the validation part.
    """
    each = df.withColumn("fold_id", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    role = F.when(F.col(part) == F.col("fold_id"), TEST)
    if valid:
        role = role.when(F.col(part) == (F.col("fold_id") + 1) % n_folds, VALID)
    return each.withColumn("role", role.otherwise(TRAIN))


def masks_to_rows(masks: DataFrame, fold: str = "fold_id") -> DataFrame:
    """(fold, train, valid, test) with 0/1 arrays by position -> (fold, row_id, role)."""
    ones = masks.select(
        fold, F.posexplode(F.arrays_zip(*[F.col(r) for r in (TRAIN, VALID, TEST)])).alias("row_id", "mask")
    )
    role = F.when(F.col(f"mask.{TEST}") == 1, TEST).when(F.col(f"mask.{VALID}") == 1, VALID)
    role = role.when(F.col(f"mask.{TRAIN}") == 1, TRAIN)
    return ones.select(fold, F.col("row_id").cast("long").alias("row_id"), role.alias("role")).where("role is not null")


# Fixed values of Spark's bitmap functions: bits in a block; positive ids count from 1, others run down from 0.
BLOCK_BITS = 32768


def rows_to_bitmaps(roles: DataFrame, key: str = "row_id") -> DataFrame:
    """(fold_id, <key>, role) -> (fold_id, role, block, bitmap): a bit for each row id, 4 KB for each 32768 ids.

    A fold's mask is as many rows as it has blocks, so no row of it grows with the table. Blocks are put together in
    the tasks first. Ids need not be dense; blocks without a row are not there.
    """
    return roles.groupBy("fold_id", "role", F.bitmap_bucket_number(key).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bitmap"))


def union_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """Masks from several sources, or of roles that have been merged, as one."""
    return bitmaps.groupBy("fold_id", "role", "block").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def bitmaps_to_rows(bitmaps: DataFrame, key: str = "row_id") -> DataFrame:
    """(fold_id, role, block, bitmap) -> (fold_id, <key>, role), block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fold, role, block, bitmap in zip(*[batch.column(c).to_pylist() for c in ("fold_id", "role", "block", "bitmap")]):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")).astype(np.int64)
                ids = (block - 1) * BLOCK_BITS + at + 1 if block > 0 else block * BLOCK_BITS - at
                if len(ids):
                    columns = [pa.array(np.full(len(ids), fold, np.int32)), pa.array(ids), pa.array([role] * len(ids))]
                    yield pa.RecordBatch.from_arrays(columns, ["fold_id", key, "role"])

    return bitmaps.select(F.col("fold_id").cast("int").alias("fold_id"), "role", "block", "bitmap").mapInArrow(run, f"fold_id int, {key} long, role string")


def merge_valid(roles: DataFrame) -> DataFrame:
    """Count validation rows as training rows."""
    return roles.withColumn("role", F.when(F.col("role") == VALID, TRAIN).otherwise(F.col("role")))


def with_roles(df: DataFrame, folds: DataFrame, key: str = "row_id") -> DataFrame:
    """Attach an external fold table to the rows. Both sides shuffle on the row key, which is unique per fold."""
    return df.join(folds, key)


def in_role(df: DataFrame, *roles: str) -> DataFrame:
    return df.where(F.col("role").isin(*roles))


def training_ranges(df: DataFrame, columns: Sequence[str], part: str = "part") -> DataFrame:
    """(fold_id, column, lo, hi): range of each column over the training rows of each fold."""
    per_part = df.groupBy(part).agg(
        *[f(c).alias(f"{f.__name__}_{i}") for i, c in enumerate(columns) for f in (F.min, F.max)]
    )
    long = per_part.select(
        part,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"), F.col(f"min_{i}").alias("lo"), F.col(f"max_{i}").alias("hi")
                    )
                    for i, c in enumerate(columns)
                ]
            )
        ),
    )
    return _other_parts(long, part).groupBy("fold_id", "column").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def training_moments(df: DataFrame, columns: Sequence[str], part: str = "part") -> DataFrame:
    """(fold_id, column, n, mean, std): population moments over the training rows of each fold.

    The rows are read once, grouped by their part; the moments of a fold are
    merged from those of the other parts.
    """
    per_part = df.groupBy(part).agg(
        *[F.count(c).alias(f"n_{i}") for i, c in enumerate(columns)],
        *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)],
        *[F.var_pop(c).alias(f"v_{i}") for i, c in enumerate(columns)],
    )
    long = per_part.select(
        part,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.col(f"n_{i}").alias("n"),
                        F.col(f"m_{i}").alias("m"),
                        F.col(f"v_{i}").alias("v"),
                    )
                    for i, c in enumerate(columns)
                ]
            )
        ),
    )
    merged = (
        _other_parts(long.where("n > 0"), part)
        .groupBy("fold_id", "column")
        .agg(F.sum("n").alias("n"), F.expr("sum(n * m) / sum(n) as mean"), F.collect_list(F.struct("n", "m", "v")).alias("each"))
    )
    spread = "aggregate(each, 0d, (a, x) -> a + x.n * (x.v + (x.m - mean) * (x.m - mean)))"
    return merged.selectExpr("fold_id", "column", "n", "mean", f"sqrt({spread} / n) as std")


def _other_parts(per_part: DataFrame, part: str) -> DataFrame:
    """Pair the statistics of each part with every fold that trains on it.

    `per_part` holds one row per part and column, so its size is set by the
    number of folds and columns, never by the rows.
    """
    folds = F.collect_set(part).over(Window.partitionBy("column"))
    listed = per_part.withColumn("__folds", folds).withColumn("fold_id", F.explode("__folds")).drop("__folds")
    return listed.where(F.col("fold_id") != F.col(part))
