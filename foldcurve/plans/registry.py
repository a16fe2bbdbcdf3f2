"""The models of an evaluation, each with its parameter grid."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.ml import Estimator
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier

from foldcurve.operators.ranking import grid_cells
from foldcurve.plans.estimators import FEATURES, LABEL, BoostedTrees, NeighborsClassifier, RbfClassifier, SymbolicClassifier
from foldcurve.plans.search import Search

# The deepest tree MLlib grows.
DEEPEST = 30
SEED = 7
# Logistic fits stop at this relative gain, MLlib's default.
TOLERANCE = 1e-6


@dataclass(frozen=True)
class Fit:
    """What a model may need to know about the rows it will be fitted on."""

    rows: int
    names: Sequence[str]


@dataclass(frozen=True)
class ModelSpec:
    name: str
    make: Callable[[Mapping, Fit], Estimator]
    grid: Mapping[str, Sequence]

    def cells(self) -> list[dict]:
        """Grid cells in order. ValueError for a depth that MLlib does not grow."""
        cells = list(grid_cells(self.grid))
        for cell in cells:
            if isinstance(cell.get("depth"), int) and cell["depth"] > DEEPEST:
                raise ValueError(f"{self.name}: depth {cell['depth']} is above {DEEPEST}, the deepest tree MLlib grows")
        return cells

    def with_grid(self, **grid: Sequence) -> "ModelSpec":
        return replace(self, grid=grid)


# The grids of the evaluation, but for depths above DEEPEST, which MLlib does not grow.
TREES = [10, 30, 60, 100, 200, 400]
DEPTHS = [1, 2, 3, 4, 5, 10, 15, 30]
SVM_GRID = {"C": [1, 2, 5, 7, 10, 50, 100, 200, 400], "gamma": [0.001, 0.01, 0.05, 0.1, 1]}
KNN_GRID = {"k": [1, 3, 5, 7, 9, 11, 13]}
RF_GRID = {"trees": TREES, "depth": DEPTHS}
ADAB_GRID = {"depth": DEPTHS, "rounds": TREES}
GB_GRID = {"depth": DEPTHS, "trees": TREES}
# Logarithmic loss splits as entropy does.
DT_GRID = {"depth": [2, 3, 4, 5, 10, 30], "impurity": ["gini", "entropy"]}
LOGR_GRID = {"C": [0.001, 0.01, 0.1, 1, 2, 3, 5, 10]}
GP_GRID = {
    "start_depth": [(2, 2), (2, 6)],
    "population": [100, 300, 500, 1000, 3000],
    "tournament": [2, 7, 20],
    "generations": [5, 20, 50, 100, 200],
}
FUZZY_GP_GRID = {**GP_GRID, "generations": [20, 50, 100, 200]}
SELECT_SIZES = [4, 8, 12]
FUZZY_SELECT_SIZES = [12, 24, 36]


def _columns() -> dict[str, str]:
    return {"featuresCol": FEATURES, "labelCol": LABEL}


def logistic_regression(c: Mapping, fit: Fit) -> Estimator:
    """L2 penalty: C weighs the summed loss of all rows, regParam the penalty against the mean loss."""
    return LogisticRegression(
        **_columns(), regParam=1.0 / (c["C"] * fit.rows), elasticNetParam=0.0, standardization=False, tol=TOLERANCE
    )


MODELS = {
    m.name: m
    for m in (
        ModelSpec("SVM", lambda c, fit: RbfClassifier(c["C"], c["gamma"], seed=SEED), SVM_GRID),
        ModelSpec("KNN", lambda c, fit: NeighborsClassifier(c["k"]), KNN_GRID),
        ModelSpec("ADAB", lambda c, fit: BoostedTrees(c["depth"], c["rounds"], seed=SEED), ADAB_GRID),
        ModelSpec(
            "RF",
            lambda c, fit: RandomForestClassifier(**_columns(), numTrees=c["trees"], maxDepth=c["depth"], seed=SEED),
            RF_GRID,
        ),
        ModelSpec(
            "LGB",
            lambda c, fit: GBTClassifier(
                **_columns(), maxIter=c["trees"], maxDepth=c["depth"], stepSize=0.1, minInstancesPerNode=20, seed=SEED
            ),
            GB_GRID,
        ),
        ModelSpec(
            "XGB",
            lambda c, fit: GBTClassifier(**_columns(), maxIter=c["trees"], maxDepth=c["depth"], stepSize=0.3, seed=SEED),
            GB_GRID,
        ),
        ModelSpec(
            "DT",
            lambda c, fit: DecisionTreeClassifier(**_columns(), maxDepth=c["depth"], impurity=c["impurity"], seed=SEED),
            DT_GRID,
        ),
        ModelSpec("LOGR", logistic_regression, LOGR_GRID),
        ModelSpec("GP", lambda c, fit: SymbolicClassifier(fit.names, Search(**c, seed=SEED)), GP_GRID),
    )
}

ALL_MODELS = ["SVM", "KNN", "ADAB", "RF", "LGB", "XGB", "DT", "LOGR"]
