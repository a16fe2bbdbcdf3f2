"""Fuzzy memberships of features, with a domain learned on training rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldcurve.operators.folds import training_ranges
from foldcurve.operators.scale import by_fold, fitted

REAL, CATEGORICAL = "real", "categorical"

DOMAIN = T.StructType(
    [
        T.StructField("fold_id", T.IntegerType()),
        T.StructField("column", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("lo", T.DoubleType()),
        T.StructField("hi", T.DoubleType()),
        T.StructField("n_categories", T.IntegerType()),
    ]
)


def column_kinds(df: DataFrame, columns: Sequence[str], kinds: Mapping[str, str] | None = None) -> dict[str, str]:
    """Floating point columns are real; text and whole numbers are categorical, unless `kinds` says otherwise."""
    found = {}
    for name in columns:
        given = (kinds or {}).get(name)
        dtype = df.schema[name].dataType
        if given is not None:
            found[name] = given
        elif isinstance(dtype, (T.DoubleType, T.FloatType)):
            found[name] = REAL
        elif isinstance(dtype, (T.StringType, T.IntegralType)):
            found[name] = CATEGORICAL
        else:
            raise ValueError(f"column {name} of type {dtype.simpleString()} is neither real nor categorical")
    return found


def is_missing(df: DataFrame, column: str) -> Column:
    """Null, or NaN in a column of floating point numbers."""
    value = F.col(f"`{column}`")
    floating = isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType))
    return value.isNull() | F.isnan(value) if floating else value.isNull()


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a missing value in the columns."""
    for c in columns:
        df = df.where(~is_missing(df, c))
    return df


def dropped_rows(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Keys of the rows that `complete_rows` leaves out, with the columns that are missing."""
    missing = F.filter(F.array(*[F.when(is_missing(df, c), F.lit(c)) for c in columns]), lambda c: c.isNotNull())
    return df.select(key, missing.alias("missing")).where(F.size("missing") > 0)


def without_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not listed."""
    return df.join(keys.select(key), key, "left_anti")


def categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, categories): the sorted distinct values of each column over all complete rows, as text and number.

    Values are made distinct before they are gathered. One row holds the values of
    a column: for columns with very many, `category_numbers` numbers them without a list.
    """
    long = complete_rows(df, columns).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.col(f"`{c}`").cast("string").alias("value"),
                        F.expr(f"try_cast(`{c}` as double)").alias("number")
                        if isinstance(df.schema[c].dataType, T.NumericType)
                        else F.lit(None).cast("double").alias("number"),
                    )
                    for c in columns
                ]
            )
        )
    )
    counted = long.distinct()
    return (
        counted.groupBy("column")
        .agg(F.sort_array(F.collect_list(F.struct("number", "value"))).alias("sorted"))
        .select("column", F.col("sorted.value").alias("categories"))
    )


def fuzzy_domain(
    df: DataFrame, columns: Sequence[str], part: str = "part", kinds: Mapping[str, str] | None = None
) -> DataFrame:
    """(fold_id, column, kind, lo, hi, n_categories).

    Ranges of real columns come from the training rows of each fold, category
    counts from all complete rows.
    """
    found = column_kinds(df, columns, kinds)
    real = [c for c in columns if found[c] == REAL]
    named = [c for c in columns if found[c] == CATEGORICAL]
    rows = complete_rows(df, columns)
    out = None
    if real:
        ranges = training_ranges(rows, real, part)
        out = ranges.select(
            F.col("fold_id").cast("int"),
            "column",
            F.lit(REAL).alias("kind"),
            F.col("lo").cast("double"),
            F.col("hi").cast("double"),
            F.lit(None).cast("int").alias("n_categories"),
        )
    if named:
        # Distinct first: a category held by most rows costs one row per task.
        values = rows.select(
            F.col(part).cast("int").alias("fold_id"),
            F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in named])),
        ).distinct()
        sizes = values.groupBy("column").agg(
            F.countDistinct("v").cast("int").alias("n_categories"), F.collect_set("fold_id").alias("folds")
        )
        listed = sizes.select(
            F.explode("folds").alias("fold_id"),
            "column",
            F.lit(CATEGORICAL).alias("kind"),
            F.lit(None).cast("double").alias("lo"),
            F.lit(None).cast("double").alias("hi"),
            "n_categories",
        )
        out = listed if out is None else out.unionByName(listed)
    return out


def memberships(value: Column, lo: Column, hi: Column, n_sets: int) -> list[Column]:
    """Triangular memberships of a value in `n_sets` evenly spaced sets over [lo, hi].

    Neighbouring sets cross at one half and add up to one. Values outside the
    domain belong fully to the set at that end.
    """
    width = (hi - lo) / (n_sets - 1)
    place = F.least(F.greatest(F.try_divide(value - lo, width), F.lit(0.0)), F.lit(float(n_sets - 1)))
    return [
        F.when(value <= lo, F.lit(1.0 if k == 0 else 0.0))
        .when(value >= hi, F.lit(1.0 if k == n_sets - 1 else 0.0))
        .when(value.isNotNull(), F.greatest(1 - F.abs(place - k), F.lit(0.0)))
        for k in range(n_sets)
    ]


def indicator(value: Column, category: str) -> Column:
    return (value.cast("string") == F.lit(category)).cast("double")


def check_sets(columns: Sequence[str], domain: list, n_sets: int | Sequence[int]) -> dict[str, int]:
    """Sets per column, or ValueError where the request does not fit the domain."""
    known = {r["column"]: r for r in domain}
    missing = [c for c in columns if c not in known]
    if missing or len(known) != len(columns):
        raise ValueError("the domain does not describe the same columns as the data")
    if isinstance(n_sets, int):
        if n_sets < 2:
            raise ValueError("a real column needs at least 2 sets")
        wanted = {c: known[c]["n_categories"] if known[c]["kind"] == CATEGORICAL else n_sets for c in columns}
    else:
        if len(n_sets) != len(columns):
            raise ValueError("give one number of sets per column")
        wanted = dict(zip(columns, n_sets))
    for c, n in wanted.items():
        if known[c]["kind"] == CATEGORICAL and n != known[c]["n_categories"]:
            raise ValueError(f"column {c} has {known[c]['n_categories']} categories, not {n}")
        if n < 2:
            raise ValueError(f"column {c} needs at least 2 sets")
    for r in domain:
        if r["kind"] == REAL and r["lo"] == r["hi"]:
            raise ValueError(f"column {r['column']} is constant on the training rows of fold {r['fold_id']}")
    return wanted


def fuzzify(
    df: DataFrame,
    columns: Sequence[str],
    domain: DataFrame,
    n_sets: int | Sequence[int] = 3,
    fold: str = "part",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Columns `{name}-{j}` for every set j of every column, after the columns in `keep`.

    Each row uses the domain of the fold in its `fold` column. The domain is a
    few numbers per fold and column, so it enters the plan as literals.
    """
    return complete_rows(df, columns).select(*keep, *fuzzy_columns(df, columns, fitted(domain), n_sets, fold))


def fuzzy_columns(df: DataFrame, columns: Sequence[str], settings: list, n_sets: int | Sequence[int], fold: str) -> list[Column]:
    """The memberships of `fuzzify`, from the rows of a domain."""
    sets = check_sets(columns, settings, n_sets)
    lo: dict[str, dict] = {c: {} for c in columns}
    hi: dict[str, dict] = {c: {} for c in columns}
    kind = {}
    for r in settings:
        kind[r["column"]] = r["kind"]
        lo[r["column"]][r["fold_id"]], hi[r["column"]][r["fold_id"]] = r["lo"], r["hi"]
    named = [c for c in columns if kind[c] == CATEGORICAL]
    values = {r["column"]: r["categories"] for r in categories(df, named).collect()} if named else {}

    out = []
    for c in columns:
        value = F.col(f"`{c}`")
        if kind[c] == CATEGORICAL:
            if len(values[c]) != sets[c]:
                raise ValueError(f"column {c} has {len(values[c])} categories, not {sets[c]}")
            grades = [indicator(value, v) for v in values[c]]
        else:
            grades = memberships(value.cast("double"), by_fold(lo[c], fold), by_fold(hi[c], fold), sets[c])
        out += [g.alias(f"{c}-{j}") for j, g in enumerate(grades)]
    return out


def _values(df: DataFrame, columns: Sequence[str], *more: Column) -> DataFrame:
    """(more, column, value): the complete rows in long form, values as text."""
    named = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return complete_rows(df, columns).select(*more, F.inline(named))


def category_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, index): the categories of each column, numbered from 0 in text order without being listed."""
    # Sorting by range keeps every task to its share; places are offsets of the ranges plus places inside them.
    values = _values(df, columns).distinct().repartitionByRange("column", "value")
    placed = values.sortWithinPartitions("column", "value").select("column", "value", F.spark_partition_id().alias("__task"))
    inside = F.row_number().over(Window.partitionBy("__task", "column").orderBy("value"))
    ranked = placed.withColumn("__inside", inside)
    sizes = ranked.groupBy("__task", "column").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("column").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__task", "column", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return ranked.join(starts, ["__task", "column"]).select("column", "value", (F.col("__start") + F.col("__inside") - 1).alias("index"))


def one_hot_sparse(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """(key, column, index): for each complete row and column the 0-based place of its category, by text order.

    The long form of one-hot, for any number of categories: they are numbered and
    joined, never listed.
    """
    long = _values(df, columns, F.col(f"`{key}`").alias(key))
    return long.join(category_numbers(df, columns), ["column", "value"]).select(key, "column", "index")


def fuzzy_label(df: DataFrame, label: str = "y", keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """(keep, {label}-0, {label}-1): the label as memberships of its two classes. ValueError where it is not 0 and 1."""
    rows = complete_rows(df, [label])
    if rows.where(~F.col(f"`{label}`").isin(0, 1)).limit(1).count():
        raise ValueError(f"label {label} has values other than 0 and 1")
    value = F.col(f"`{label}`")
    return rows.select(*keep, *[(value == k).cast("double").alias(f"{label}-{k}") for k in (0, 1)])
