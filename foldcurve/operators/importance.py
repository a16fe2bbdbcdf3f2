"""Importance of the features of any score, by what is lost when a feature is shuffled.

Every row gets a donor: the row a fixed number of places on, in an order by hash of the
key or by the key, the last rows taking the first. Places are running totals, and donors
come by one join on places, so no part holds the whole table. One scan then scores each
row as it is and once for each feature with the donor's value of that feature, and one
grouped job gives all areas. Features that the score does not use lose exactly nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldcurve.operators.folds import SEED
from foldcurve.operators.roc import auc
from foldcurve.operators.running import ordinal
from foldcurve.operators.symbolic import Expression, compile_expr, depth, length, to_text

#: Which feature is shuffled: none, for the score as it is.
WHOLE = ""


def with_donors(df: DataFrame, columns: Sequence[str], key: str = "row_id", shift: int = 1, seed: int | None = SEED) -> DataFrame:
    """`df` with `__donor`, a struct of the donor's columns. With `seed` None the order is that of a LONG key."""
    order = F.xxhash64(key, F.lit(seed)) if seed is not None else F.col(key).cast("long")
    placed = ordinal(df.withColumn("__order", order), [], "__order", "__place", ties=[key]).drop("__order")
    rows = df.count()
    if rows == 0:
        return df.withColumn("__donor", F.lit(None).cast(df.select(F.struct(*columns).alias("d")).schema["d"].dataType))
    wanted = F.pmod(F.col("__place") - 1 + shift, F.lit(rows)) + 1
    donors = placed.select(F.col("__place").alias("__at"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__donor"))
    return placed.withColumn("__from", wanted).join(donors, F.col("__from") == F.col("__at")).drop("__place", "__from", "__at")


def permutation_importance(
    df: DataFrame,
    score: Callable[[Mapping[str, Column]], Column],
    columns: Sequence[str],
    key: str = "row_id",
    label: str = "y",
    *,
    keys: Sequence[str] = (),
    shift: int = 1,
    seed: int | None = SEED,
) -> DataFrame:
    """(keys, feature, auc, importance): the area with the feature shuffled, and what it lacks to the area of the score as it is.

    `score` makes a column from a mapping of feature names to columns. Areas are those of each key group; donors come
    from all rows.
    """
    donated = with_donors(df, columns, key, shift, seed)
    own = {c: F.col(f"`{c}`") for c in columns}
    scored = [F.struct(F.lit(WHOLE).alias("feature"), score(own).alias("p"))]
    scored += [F.struct(F.lit(c).alias("feature"), score({**own, c: F.col("__donor")[c]}).alias("p")) for c in columns]
    areas = auc(donated.select(*keys, label, F.inline(F.array(*scored))), [*keys, "feature"], label)
    # A row for each feature and one for the whole score in every group.
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    whole = F.max(F.when(F.col("feature") == WHOLE, F.col("auc"))).over(group)
    rated = areas.select(*keys, "feature", "auc", (whole - F.col("auc")).alias("importance"))
    return rated.where(F.col("feature") != WHOLE)


def constructed_importance(df: DataFrame, trees: Mapping[str, Expression], columns: Sequence[str], key: str = "row_id", label: str = "y", **how) -> DataFrame:
    """(model, text, length, depth, feature, auc, importance) of expressions by name: what each column means to each of them."""
    out = None
    for name, tree in trees.items():
        def value(given: Mapping[str, Column], tree: Expression = tree) -> Column:
            return compile_expr(tree, {c: x.cast("double") for c, x in given.items()})

        about = [F.lit(name).alias("model"), F.lit(to_text(tree)).alias("text"), F.lit(length(tree)).alias("length"), F.lit(depth(tree)).alias("depth")]
        part = permutation_importance(df, value, columns, key, label, **how).select(*about, "feature", "auc", "importance")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no expressions")
    return out
