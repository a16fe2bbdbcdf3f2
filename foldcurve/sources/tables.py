"""Readers: feature tables, baseline scores, fold tables, stored scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldcurve.operators.align import to_long
from foldcurve.operators.folds import bitmaps_to_rows, masks_to_rows
from foldcurve.operators.running import ordinal, running_totals

BOM = "﻿"
ROW = "__row"


def double_schema(columns: Sequence[str], label: str | None = None) -> T.StructType:
    fields = [T.StructField(c, T.DoubleType()) for c in columns]
    return T.StructType(fields + ([T.StructField(label, T.IntegerType())] if label else []))


def read_table(spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """A table in Parquet, ORC, JSON or CSV. CSV has a header and may begin with a byte-order mark."""
    reader = spark.read
    if format == "csv":
        reader = reader.option("header", True).option("encoding", "UTF-8")
        # Names in the header need not be compared with a given schema: the mark would differ.
        reader = reader.option("enforceSchema", True) if schema is not None else reader.option("inferSchema", True)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.format(format).load(path)
    return df.toDF(*[c.removeprefix(BOM) for c in df.columns])


def read_features(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    label: str = "class",
    key: str | None = None,
    format: str = "parquet",
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Feature columns, `y` and `row_id`.

    `row_id` is the table's own key column. Without one, rows of Parquet files are numbered by their place, file
    after file, and rows of other formats by a hash of the row and its turn among equal rows. Either way each row has
    an id of its own, which does not change while the files do not.
    """
    df = read_table(spark, path, format, schema)
    columns = feature_names(df, label, [key] if key else []) if columns is None else list(columns)
    if key:
        rows = df.withColumn(ROW, F.col(key).cast("long"))
    elif format == "parquet":
        rows = by_position(spark.read.schema(df.schema).parquet(path))
    else:
        rows = by_content(df)
    return rows.select(F.col(ROW).alias("row_id"), *[F.col(f"`{c}`") for c in columns], F.col(label).cast("int").alias("y"))


def by_position(df: DataFrame) -> DataFrame:
    """Rows of Parquet files with their number in all files. Files come in the order of a hash of their path; where each begins is a running total over files."""
    placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__index"))
    files = placed.groupBy("__file").agg((F.max("__index") + 1).alias("__size")).withColumn("__order", F.xxhash64("__file"))
    starts = running_totals(files, [], "__order", ["__size"], ties=["__file"]).select(F.col("__file").alias("__of"), F.expr("through___size - __size").alias("__start"))
    joined = placed.join(starts, F.col("__file") == F.col("__of"))
    return joined.withColumn(ROW, F.col("__start") + F.col("__index")).drop("__file", "__index", "__of", "__start")


def by_content(df: DataFrame) -> DataFrame:
    """Rows with a hash of what they hold and of their turn among equal rows, which are alike, so that any order of them will do."""
    hashed = df.withColumn("__hash", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).withColumn("__turn", F.monotonically_increasing_id())
    numbered = ordinal(hashed, ["__hash"], "__turn", "__nth")
    return numbered.withColumn(ROW, F.when(F.col("__nth") == 1, F.col("__hash")).otherwise(F.xxhash64("__hash", "__nth"))).drop("__hash", "__turn", "__nth")


def feature_names(df: DataFrame, label: str = "class", others: Sequence[str] = ()) -> list[str]:
    """All columns but the label and the other named ones, in table order."""
    return [c for c in df.columns if c != label and c not in others]


def features_and_label(df: DataFrame, columns: Sequence[str], label: str = "y") -> tuple[DataFrame, DataFrame]:
    """The feature columns and the label column as two projections."""
    return df.select(*[F.col(f"`{c}`") for c in columns]), df.select(label)


def read_baseline(spark: SparkSession, path: str, column: str = "BFP", label: str = "class", format: str = "csv", **how) -> DataFrame:
    """Externally made scores of one baseline model, with the label."""
    return read_table(spark, path, format, **how).select(column, label)


def read_folds(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Outer folds as (fold_id, row_id, role), from that form, from bitmaps by block, or from 0/1 mask arrays per fold."""
    df = read_table(spark, path, format)
    if "bitmap" in df.columns:
        return bitmaps_to_rows(df)
    if {"train", "valid", "test"} <= set(df.columns):
        return masks_to_rows(df)
    return df.select(F.col("fold_id").cast("int"), F.col("row_id").cast("long"), "role")


def fold_count(folds: DataFrame) -> int:
    return folds.select("fold_id").distinct().count()


def read_results(spark: SparkSession, path: str, models: Sequence[str] | None = None, label: str = "class", format: str = "parquet", keep: Sequence[str] = ()) -> DataFrame:
    """Stored scores, one column per model -> (keep, y, model, p): replays a report without training."""
    wide = read_table(spark, path, format)
    models = [c for c in wide.columns if c not in (label, "fold_id", "row_id", *keep)] if models is None else models
    return to_long(wide, models, label, keep)


def preview(df: DataFrame, rows: int = 5) -> tuple[list[str], list]:
    """Column names and the first rows, for a look at a source."""
    return df.columns, df.take(rows)
