"""Categories as sparse vectors for models, with the dictionary kept as a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldcurve.operators import fuzzy

VECTOR = T.StructType([T.StructField("v", VectorUDT())])
#: The parts of a sparse vector, as text has them.
PARTS = "v struct<size:int, indices:array<int>, values:array<double>>"


def category_dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, index, size): the categories of all columns over the complete rows, numbered from 0 on.

    Columns follow each other as in `columns`, categories of a column in text order. `size`
    is the number of all categories. The categories are sorted by range and never gathered.
    """
    numbers = fuzzy.category_numbers(df, columns)
    # One row per column from here on.
    sizes = numbers.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    listed = F.array(*[F.lit(c) for c in columns])
    order = Window.partitionBy(F.lit(0)).orderBy(F.array_position(listed, F.col("column")))
    starts = sizes.select(
        "column",
        (F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"),
        F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("size"),
    )
    placed = numbers.join(starts, "column")
    return placed.select("column", "value", (F.col("index") + F.col("start")).cast("int").alias("index"), F.col("size").cast("int").alias("size"))


def sparse_vector(indices: Column, size: Column) -> Column:
    """A vector with ones at the sorted indices. Spark reads vectors from text by itself, so no Python runs."""
    parts = F.struct(F.lit(0).alias("type"), size.alias("size"), indices.alias("indices"), F.transform(indices, lambda _: F.lit(1.0)).alias("values"))
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), VECTOR)["v"]


def active(vector: str) -> Column:
    """The indices of a sparse vector."""
    return F.from_json(F.to_json(F.struct(F.col(vector).alias("v"))), PARTS)["v"]["indices"]


def sparse_features(
    df: DataFrame, columns: Sequence[str], dictionary: DataFrame, key: str = "row_id", keep: Sequence[str] = (), features: str = "features"
) -> DataFrame:
    """(key, *keep, features): a sparse vector per complete row, with a one for the category of each column.

    Keys are unique: the job fails where two rows share one. A category that the dictionary
    does not have, as in rows it was not made from, has no place in the vector. Linear models
    keep such vectors sparse; MLlib's trees hold a bin of every feature for every row.
    """
    rows = fuzzy.complete_rows(df, columns)
    long = rows.select(
        F.col(f"`{key}`").alias("__key"),
        F.struct(*[F.col(f"`{c}`").alias(c) for c in keep]).alias("__keep") if keep else F.lit(None).alias("__keep"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])),
    )
    # The row is carried by its first column only.
    long = long.withColumn("__keep", F.when(F.col("column") == columns[0], F.col("__keep")))
    size = dictionary.agg(F.max("size")).scalar()
    found = long.join(dictionary.select("column", "value", "index"), ["column", "value"], "left")
    gathered = found.groupBy("__key").agg(
        F.count(F.lit(1)).alias("__n"), F.array_sort(F.collect_list("index")).alias("__indices"), F.first("__keep", ignorenulls=True).alias("__keep")
    )
    once = F.when(F.col("__n") == len(columns), F.col("__indices")).otherwise(F.raise_error(F.concat(F.lit("two rows share the key "), F.col("__key").cast("string"))))
    sized = gathered.select("__key", "__keep", once.alias("__indices"), size.alias("__size"))
    return sized.select(
        F.col("__key").alias(key), *[F.col(f"__keep.`{c}`").alias(c) for c in keep], sparse_vector(F.col("__indices"), F.col("__size")).alias(features)
    )
