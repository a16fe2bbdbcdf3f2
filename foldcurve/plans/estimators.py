"""Estimators that MLlib lacks, and one way to score with any of them.

A model adds a class-1 probability and a predicted class to rows. MLlib models
do so through their probability column; the models here through `score`. Rows
have a vector column `features`, a label `y` and a key `row_id`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcurve.operators import neighbors
from foldcurve.operators.symbolic import compile_expr, logistic
from foldcurve.plans.search import Search, symbolic_search
from foldcurve.session import cut_lineage

FEATURES, LABEL, KEY = "features", "y", "row_id"
TINY = 2.220446049250313e-16


class ScoringModel(Model):
    """A fitted model that is not one of MLlib's."""

    def score(self, df: DataFrame, p: str, yhat: str) -> DataFrame:
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        scored = self.score(df, "__p", "prediction")
        return scored.withColumn("probability", array_to_vector(F.array(1 - F.col("__p"), F.col("__p")))).drop("__p")


def add_scores(model: Model, df: DataFrame, p: str = "p", yhat: str = "yhat") -> DataFrame:
    """Add the class-1 probability and the predicted class of any fitted classifier."""
    if isinstance(model, ScoringModel):
        return model.score(df, p, yhat)
    named = model.copy().setProbabilityCol(f"__{p}").setPredictionCol(yhat).setRawPredictionCol("")
    out = named.transform(df)
    return out.withColumns({p: vector_to_array(f"__{p}")[1], yhat: F.col(yhat).cast("int")}).drop(f"__{p}")


class Standardize(Estimator):
    """Columns -> one vector, scaled by mean and population deviation of the fitted rows."""

    def __init__(self, columns: Sequence[str]) -> None:
        super().__init__()
        self.columns = list(columns)

    def _fit(self, df: DataFrame) -> "StandardizeModel":
        row = df.agg(
            *[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(self.columns)],
            *[F.stddev_pop(f"`{c}`").alias(f"s{i}") for i, c in enumerate(self.columns)],
        ).first()
        size = range(len(self.columns))
        return StandardizeModel(self.columns, [row[f"m{i}"] for i in size], [row[f"s{i}"] or 1.0 for i in size])


class StandardizeModel(Model):
    def __init__(self, columns: list[str], means: list[float], deviations: list[float]) -> None:
        super().__init__()
        self.columns, self.means, self.deviations = columns, means, deviations

    def _transform(self, df: DataFrame) -> DataFrame:
        scaled = [
            (F.col(f"`{c}`").cast("double") - m) / s for c, m, s in zip(self.columns, self.means, self.deviations)
        ]
        return df.withColumn(FEATURES, array_to_vector(F.array(*scaled)))


class NeighborsClassifier(Estimator):
    """Manhattan neighbours with votes weighted by inverse distance."""

    def __init__(self, k: int) -> None:
        super().__init__()
        self.k = k

    def _fit(self, df: DataFrame) -> "NeighborsModel":
        return NeighborsModel(_as_arrays(df), self.k)


class NeighborsModel(ScoringModel):
    def __init__(self, train: DataFrame, k: int) -> None:
        super().__init__()
        self.train, self.k = train, k

    def score(self, df: DataFrame, p: str, yhat: str) -> DataFrame:
        found = neighbors.knn_scores(_as_arrays(df), self.train, self.k, KEY, LABEL)
        return df.join(found.select(KEY, F.col("p").alias(p), F.col("yhat").alias(yhat)), KEY)

    @staticmethod
    def score_all(train: DataFrame, df: DataFrame, sizes: Sequence[int]) -> DataFrame:
        """(cell, y, p) for several k from one search for the greatest."""
        near = neighbors.nearest_neighbors(_as_arrays(df), _as_arrays(train), max(sizes), KEY, FEATURES, LABEL)
        each = near.select("*", F.posexplode(F.array(*[F.lit(k) for k in sizes])).alias("cell", "k")).where("rank <= k")
        scored = neighbors.neighbor_probability(each, [KEY, "cell"], LABEL)
        return scored.join(df.select(KEY, LABEL), KEY).select("cell", LABEL, "p")


def _as_arrays(df: DataFrame) -> DataFrame:
    return df.select(KEY, LABEL, vector_to_array(FEATURES).alias(FEATURES))


class RbfClassifier(Estimator):
    """Support vector classifier with a Gaussian kernel, by random Fourier features.

    The kernel is approximated with `n_features` seeded cosines, then separated
    linearly. Probabilities come from a logistic fit on the margin; the class
    comes from the sign of the margin, so the two may differ near one half.
    """

    def __init__(self, C: float, gamma: float, n_features: int = 128, seed: int = 7, max_iter: int = 100) -> None:
        super().__init__()
        self.C, self.gamma, self.n_features, self.seed, self.max_iter = C, gamma, n_features, seed, max_iter

    def _fit(self, df: DataFrame) -> "RbfModel":
        size, rows = df.select(F.size(vector_to_array(FEATURES)).alias("size")).agg(F.max("size"), F.count(F.lit(1))).first()
        random = np.random.default_rng(self.seed)
        waves = random.normal(scale=np.sqrt(2 * self.gamma), size=(size, self.n_features))
        shifts = random.uniform(0, 2 * np.pi, self.n_features)
        mapped = fourier(df.select(LABEL, FEATURES), waves, shifts).drop(FEATURES).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            separator = LinearSVC(
                featuresCol="__waves", labelCol=LABEL, regParam=1.0 / (self.C * rows), standardization=False, maxIter=self.max_iter
            ).fit(mapped)
            margins = margin(separator, mapped)
            calibration = LogisticRegression(featuresCol="__margin", labelCol=LABEL).fit(
                margins.withColumn("__margin", array_to_vector(F.array("__margin")))
            )
        finally:
            mapped.unpersist()
        return RbfModel(waves, shifts, separator, float(calibration.coefficients[0]), float(calibration.intercept))


def fourier(df: DataFrame, waves: np.ndarray, shifts: np.ndarray) -> DataFrame:
    scale = np.sqrt(2.0 / len(shifts))

    @F.pandas_udf("array<double>")
    def cosines(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            points = np.array(rows.tolist(), dtype="float64").reshape(len(rows), len(waves))
            yield pd.Series(list(scale * np.cos(points @ waves + shifts)))

    return df.withColumn("__waves", array_to_vector(cosines(vector_to_array(FEATURES))))


def margin(separator: Model, df: DataFrame) -> DataFrame:
    named = separator.copy().setRawPredictionCol("__raw").setPredictionCol("__side")
    return named.transform(df).withColumn("__margin", vector_to_array("__raw")[1]).drop("__raw", "__side", "__waves")


class RbfModel(ScoringModel):
    def __init__(self, waves: np.ndarray, shifts: np.ndarray, separator: Model, slope: float, offset: float) -> None:
        super().__init__()
        self.waves, self.shifts, self.separator, self.slope, self.offset = waves, shifts, separator, slope, offset

    def score(self, df: DataFrame, p: str, yhat: str) -> DataFrame:
        out = margin(self.separator, fourier(df, self.waves, self.shifts))
        return out.withColumns(
            {p: logistic(self.slope * F.col("__margin") + self.offset), yhat: (F.col("__margin") > 0).cast("int")}
        ).drop("__margin")


class BoostedTrees(Estimator):
    """AdaBoost with real-valued votes (SAMME.R, Zhu et al. 2009) over balanced trees.

    Each round fits one tree on weighted rows, each split drawing from a square
    root of the features; weights fall where the tree is right. Rows and weights
    are written out every few rounds, so the plan does not grow with the rounds.
    """

    def __init__(self, depth: int, rounds: int, seed: int = 7, cut_every: int = 10) -> None:
        super().__init__()
        self.depth, self.rounds, self.seed, self.cut_every = depth, rounds, seed, cut_every

    def _fit(self, df: DataFrame) -> "BoostedModel":
        n, ones = df.agg(F.count(F.lit(1)), F.sum(LABEL)).first()
        # Balanced classes: both halves of the total weight.
        share = F.when(F.col(LABEL) == 1, F.lit(n / (2.0 * max(ones, 1)))).otherwise(F.lit(n / (2.0 * max(n - ones, 1))))
        rows = df.select(KEY, LABEL, FEATURES).withColumn("__w", F.lit(1.0))
        trees, held = [], None
        for i in range(self.rounds):
            tree = RandomForestClassifier(
                featuresCol=FEATURES, labelCol=LABEL, weightCol="__tree_w", numTrees=1, bootstrap=False,
                featureSubsetStrategy="sqrt", maxDepth=self.depth, seed=self.seed + i,
            ).fit(rows.withColumn("__tree_w", F.col("__w") * share))
            trees.append(tree)
            rated = log_odds(tree, rows, "__odds")
            total, wrong = rated.agg(
                F.sum("__w"), F.sum(F.when((F.col("__odds") > 0) != (F.col(LABEL) == 1), F.col("__w")).otherwise(0.0))
            ).first()
            if wrong <= 0 or total <= 0 or i + 1 == self.rounds:
                break
            moved = F.col("__w") * F.exp(-0.5 * (2 * F.col(LABEL) - 1) * F.col("__odds")) * (n / total)
            rows = rated.withColumn("__w", moved).drop("__odds")
            if (i + 1) % self.cut_every == 0:
                rows = cut_lineage(rows)
            rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
            rows.count()
            if held is not None:
                held.unpersist()
            held = rows
        if held is not None:
            held.unpersist()
        return BoostedModel(trees)


def log_odds(tree: Model, df: DataFrame, name: str) -> DataFrame:
    """Add log(p1 / p0) of one tree; leaves with one class only are clipped."""
    named = tree.copy().setProbabilityCol("__pair").setPredictionCol("").setRawPredictionCol("")
    pair = vector_to_array("__pair")
    clipped = [F.greatest(pair[i], F.lit(TINY)) for i in (0, 1)]
    return named.transform(df).withColumn(name, F.log(clipped[1]) - F.log(clipped[0])).drop("__pair")


class BoostedModel(ScoringModel):
    def __init__(self, trees: list[Model]) -> None:
        super().__init__()
        self.trees = trees

    def score(self, df: DataFrame, p: str, yhat: str) -> DataFrame:
        out = df.withColumn("__votes", F.lit(0.0))
        for tree in self.trees:
            out = log_odds(tree, out, "__odds").withColumn("__votes", F.col("__votes") + F.col("__odds")).drop("__odds")
        mean = F.col("__votes") / len(self.trees)
        return out.withColumns({p: logistic(mean), yhat: (mean > 0).cast("int")}).drop("__votes")


class SymbolicClassifier(Estimator):
    """The best expression found by a seeded search, as a classifier."""

    def __init__(self, names: Sequence[str], settings: Search) -> None:
        super().__init__()
        self.names, self.settings = list(names), settings

    def _fit(self, df: DataFrame) -> "SymbolicModel":
        rows = df.select(LABEL, vector_to_array(FEATURES).alias("__x")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            found = symbolic_search(rows, vector_columns(self.names), self.settings, LABEL)
        finally:
            rows.unpersist()
        return SymbolicModel(self.names, found.tree, found.fitness)


def vector_columns(names: Sequence[str]) -> dict[str, F.Column]:
    return {c: F.col("__x")[i] for i, c in enumerate(names)}


class SymbolicModel(ScoringModel):
    def __init__(self, names: list[str], tree, fitness: float) -> None:
        super().__init__()
        self.names, self.tree, self.fitness = names, tree, fitness

    def score(self, df: DataFrame, p: str, yhat: str) -> DataFrame:
        out = df.withColumn("__x", vector_to_array(FEATURES))
        out = out.withColumn(p, logistic(compile_expr(self.tree, vector_columns(self.names)))).drop("__x")
        return out.withColumn(yhat, (F.col(p) > 0.5).cast("int"))
