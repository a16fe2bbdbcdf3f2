"""Nested evaluation: outer folds for testing, inner folds for the choice of parameters.

The driver walks over folds and cells and starts fits; rows stay in Spark. All
cells of an inner fold score its held-out rows in one scan, and the areas of all
cells and inner folds come from one grouped job. Logistic models, decision trees and
symbolic searches do not walk: the fits of all outer folds, inner folds and cells go
together (plans/stacked.py, plans/stacked_trees.py, plans/stacked_search.py).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorSlicer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcurve.operators.folds import SEED, TEST, TRAIN, VALID, stratified_folds
from foldcurve.operators.fuzzy import CATEGORICAL, check_sets, column_kinds, complete_rows, dropped_rows, fuzzify, fuzzy_columns, fuzzy_domain
from foldcurve.operators.ranking import best_cell, mean_scores, weakest
from foldcurve.operators.roc import auc
from foldcurve.operators.scale import fitted
from foldcurve.plans.estimators import FEATURES, KEY, LABEL, NeighborsModel, Standardize, SymbolicModel, add_scores
from foldcurve.plans import stacked, stacked_neighbors, stacked_search, stacked_trees
from foldcurve.plans.registry import SEED as SEARCH_SEED
from foldcurve.plans.registry import TOLERANCE, Fit, ModelSpec
from foldcurve.plans.search import Found, Search
from foldcurve.plans.stacked_trees import Kind, Tree

TESTED = "__tested"

@dataclass
class FoldFit:
    """What one outer fold settled on."""

    fold_id: int
    model: str
    params: dict
    score: float | None
    names: list[str]
    selected: list[int]
    #: None for neighbours of a stack, which have no model but the table.
    fitted: Model | None


@dataclass
class Evaluation:
    """`predictions`: model, fold_id, row_id, y, p, yhat of every tested row. `dropped`: rows that were left out
    of all folds, with the columns that are missing in them."""

    predictions: DataFrame
    fits: list[FoldFit] = field(default_factory=list)
    dropped: DataFrame | None = None

    def best(self) -> DataFrame:
        """(fold_id, model, params, score)."""
        rows = [(f.fold_id, f.model, {k: str(v) for k, v in f.params.items()}, f.score) for f in self.fits]
        return self.predictions.sparkSession.createDataFrame(
            rows, "fold_id int, model string, params map<string,string>, score double"
        )


def eliminate(df: DataFrame, n_features: int, sizes: Sequence[int], C: float = 1.0) -> dict[int, list[int]]:
    """Recursive elimination: drop the feature with the least squared L1 weight until `min(sizes)` are left.

    One path serves all sizes. The loop is over features; each step is one fit.
    """
    kept, out = list(range(n_features)), {}
    wanted = sorted({min(s, n_features) for s in sizes}, reverse=True)
    rows = df.count()
    while True:
        if len(kept) in wanted:
            out[len(kept)] = list(kept)
        if len(kept) <= wanted[-1]:
            return {s: out[min(s, n_features)] for s in sizes}
        sliced = VectorSlicer(inputCol=FEATURES, outputCol="__kept", indices=kept).transform(df)
        fit = LogisticRegression(
            featuresCol="__kept", labelCol=LABEL, regParam=1.0 / (C * rows), elasticNetParam=1.0, standardization=False, tol=TOLERANCE
        ).fit(sliced)
        del kept[weakest(list(fit.coefficients))]


def keep_features(df: DataFrame, kept: Sequence[int] | None) -> DataFrame:
    if kept is None:
        return df
    sliced = VectorSlicer(inputCol=FEATURES, outputCol="__kept", indices=list(kept)).transform(df)
    return sliced.drop(FEATURES).withColumnRenamed("__kept", FEATURES)


def fit_cells(train: DataFrame, spec: ModelSpec, cells: Sequence[Mapping], fit: Fit, parallelism: int) -> list[Model]:
    """Fit every cell, several at a time if the cluster has room for more than one fit."""

    @inheritable_thread_target(train.sparkSession)
    def one(cell: Mapping) -> Model:
        return spec.make(cell, fit).fit(train)

    if parallelism == 1:
        return [spec.make(c, fit).fit(train) for c in cells]
    with ThreadPool(min(parallelism, len(cells))) as pool:
        return pool.map(one, cells)


def score_cells(models: Sequence[Model], hold: DataFrame) -> DataFrame:
    """(cell, y, p): all models score the held-out rows side by side, then the scores become rows."""
    out = hold.select(KEY, LABEL, FEATURES)
    for i, model in enumerate(models):
        out = add_scores(model, out, f"p{i}", f"yhat{i}").drop(f"yhat{i}")
    return out.select(F.posexplode(F.array(*[f"p{i}" for i in range(len(models))])).alias("cell", "p"), LABEL)


def inner_scores(
    train: DataFrame, spec: ModelSpec, cells: Sequence[Mapping], names: Sequence[str], n_inner: int, select: Sequence[int] | None, parallelism: int
) -> tuple[DataFrame, DataFrame]:
    """(inner, cell, auc), and the scores it is computed from, kept until the caller frees them. With `select`, the cell number runs over feature counts first, then over cells."""
    parts = []
    for j in range(n_inner):
        rows, hold = train.where(F.col("inner") != j), train.where(F.col("inner") == j)
        scaler = Standardize(names).fit(rows)
        rows, hold = scaler.transform(rows).persist(StorageLevel.MEMORY_AND_DISK), scaler.transform(hold)
        try:
            n = rows.count()
            sets = eliminate(rows, len(names), select) if select else {None: None}
            for s, kept in enumerate(sets.values()):
                fit = Fit(n, list(names) if kept is None else [names[i] for i in kept])
                some, held_out = keep_features(rows, kept), keep_features(hold, kept)
                if spec.name == "KNN":
                    scored = NeighborsModel.score_all(some, held_out, [c["k"] for c in cells])
                else:
                    scored = score_cells(fit_cells(some, spec, cells, fit, parallelism), held_out)
                parts.append(
                    scored.select(F.lit(j).alias("inner"), (F.col("cell") + s * len(cells)).alias("cell"), LABEL, "p")
                )
        finally:
            rows.unpersist()
    # Kept: the curves read their points several times, the models should score once.
    held = reduce(DataFrame.unionByName, parts).persist(StorageLevel.MEMORY_AND_DISK)
    return auc(held, ["inner", "cell"]), held


def fuzzy_rows(df: DataFrame, columns: Sequence[str], domain: DataFrame, n_sets: int) -> tuple[DataFrame, list[str]]:
    """The rows of one fold with memberships in its domain in place of the features."""
    keep = [KEY, LABEL, TESTED]
    out = fuzzify(df.withColumn("fold_id", F.lit(1)), columns, domain.where("fold_id = 1"), n_sets, "fold_id", keep)
    return out, [c for c in out.columns if c not in keep]


def fold_rows(rows: DataFrame, fold: int, folds: DataFrame | None) -> DataFrame:
    """The rows of one fold, with 1 in TESTED for those it tests and 0 for those it trains on.

    From a role table, validation rows train; a row that the fold tests never trains it, whatever other role it has
    there; rows in no role are left out. Without one, the fold tests its part and trains on all others.
    """
    if folds is None:
        return rows.withColumn(TESTED, (F.col("part") == fold).cast("int")).where(f"{TESTED} is not null").drop("part")
    mine = folds.where((F.col("fold_id") == fold) & F.col("role").isin(TRAIN, VALID, TEST))
    tested = mine.groupBy(KEY).agg(F.max((F.col("role") == TEST).cast("int")).alias(TESTED))
    return rows.join(tested, KEY)


def logistic_fits(table: stacked.Stack, wanted: Sequence[tuple[stacked.Fold, Mapping, tuple[int, ...] | None]], shared: dict) -> list[stacked.Solution]:
    problems = [stacked.Problem(fold, cell["C"], support=support) for fold, cell, support in wanted]
    return stacked.solve(table, problems, shared["scaling"])


def tree_fits(table: stacked.Stack, wanted: Sequence[tuple[stacked.Fold, Mapping, tuple[int, ...] | None]], shared: dict) -> list[Tree]:
    """Trees as deep as the deepest cell of their kind, in the order of `wanted`; equal kinds are one tree."""
    cuts = shared["cuts"] = shared["cuts"] or stacked_trees.cut_points(table)
    kinds = [Kind(fold, cell["impurity"], support) for fold, cell, support in wanted]
    grown = dict(zip(dict.fromkeys(kinds), stacked_trees.grow(table, list(dict.fromkeys(kinds)), max(cell["depth"] for _, cell, _ in wanted), cuts)))
    return [grown[k] for k in kinds]


def search_fits(table: stacked.Stack, wanted: Sequence[tuple[stacked.Fold, Mapping, tuple[int, ...] | None]], shared: dict) -> list[Found]:
    if any(support is not None for _, _, support in wanted):
        raise ValueError("a symbolic search chooses its own features; do not select for it")
    searches = [(fold, Search(**cell, seed=SEARCH_SEED)) for fold, cell, _ in wanted]
    return stacked_search.search_all(table, searches, shared["scaling"])[0]


def neighbor_fits(table: stacked.Stack, wanted: Sequence[tuple[stacked.Fold, Mapping, tuple[int, ...] | None]], shared: dict) -> list[int]:
    """Nothing to fit: the number of neighbours."""
    return [cell["k"] for _, cell, _ in wanted]


FITS = {"LOGR": logistic_fits, "DT": tree_fits, "GP": search_fits, "KNN": neighbor_fits}


def evaluate_stacked(table: stacked.Stack, numbers: Sequence[int], spec: ModelSpec, n_inner: int, select: Sequence[int] | None, search: bool, label_type: str) -> tuple[DataFrame, list[FoldFit]]:
    """All folds of a stack: one elimination, one grid of fits, one job for all areas, and one refit for all folds."""
    cells = spec.cells()
    settings = [(n, c) for n in (select or [None]) for c in cells]
    outer = [stacked.Fold(i) for i in range(table.n_outer)]
    inner = [stacked.Fold(f.outer, j) for f in outer for j in range(n_inner)] if search else []
    # Moments and thresholds of folds, kept between steps.
    shared: dict = {"scaling": {}, "cuts": None}
    kept = stacked.eliminate_all(table, [*outer, *inner], select, scaling=shared["scaling"]) if select else {}
    fits_of = FITS[spec.name]

    def wanted(fold: stacked.Fold, setting: int) -> tuple[stacked.Fold, Mapping, tuple[int, ...] | None]:
        size, cell = settings[setting]
        return fold, cell, kept[fold][size] if size else None

    chosen, scores = {f.outer: 0 for f in outer}, {}
    if search:
        grid = [(f, s) for f in inner for s in range(len(settings))]
        fits = fits_of(table, [wanted(f, s) for f, s in grid], shared)
        if spec.name == "LOGR":
            held = stacked.held_out_scores(table, fits, [s for _, s in grid])
        elif spec.name == "KNN":
            held = stacked_neighbors.held_out_scores(table, inner, [c["k"] for c in cells], shared["scaling"])
        elif spec.name == "GP":
            held = stacked_search.held_out_scores(table, [(f, s, fit.tree) for (f, s), fit in zip(grid, fits)], shared["scaling"])
        else:
            # A tree serves all depths of its kind: (depth, cell) of each.
            uses: dict[int, list[tuple[int, int]]] = {}
            for fit, (_, s) in zip(fits, grid):
                uses.setdefault(id(fit), []).append((settings[s][1]["depth"], s))
            trees = list({id(fit): fit for fit in fits}.values())
            held = stacked_trees.held_out_scores(table, trees, [uses[id(t)] for t in trees], shared["cuts"])
        held = held.persist(StorageLevel.MEMORY_AND_DISK)
        areas = auc(held, ["outer", "inner", "cell"], times="n" if "n" in held.columns else None)
        top = best_cell(mean_scores(areas, keys=["outer"]), keys=["outer"]).collect()
        held.unpersist()
        chosen, scores = {r.outer: r.cell for r in top}, {r.outer: r.mean_score for r in top}
    final = fits_of(table, [wanted(f, chosen[f.outer]) for f in outer], shared)
    if spec.name == "LOGR":
        tested = stacked.tested_scores(table, final)
        models: list[Model] = [stacked.LogisticModel(s) for s in final]
    elif spec.name == "KNN":
        tested = stacked_neighbors.tested_scores(table, {f.outer: k for f, k in zip(outer, final)}, shared["scaling"])
        models = [None] * len(final)
    elif spec.name == "GP":
        tested = stacked_search.tested_scores(table, {f.outer: fit.tree for f, fit in zip(outer, final)}, shared["scaling"])
        models = [SymbolicModel(table.names, fit.tree, fit.fitness) for fit in final]
    else:
        cut = [t.cut(settings[chosen[f.outer]][1]["depth"]) for f, t in zip(outer, final)]
        tested = stacked_trees.tested_scores(table, {f.outer: t for f, t in zip(outer, cut)}, shared["cuts"])
        models = [stacked_trees.TreeModel(t, table.names) for t in cut]
    number = F.element_at(F.array(*[F.lit(i) for i in numbers]), F.col("outer") + 1)
    out = tested.select(F.lit(spec.name).alias("model"), number.alias("fold_id"), KEY, F.col(LABEL).cast(label_type).alias(LABEL), "p", "yhat")
    done = []
    for f, model in zip(outer, models):
        size, cell = settings[chosen[f.outer]]
        selected = list(kept[f][size] if size else range(len(table.names)))
        params = dict(cell) if size is None else {**cell, "n_features": size}
        done.append(FoldFit(numbers[f.outer], spec.name, params, scores.get(f.outer), [table.names[i] for i in selected], selected, model))
    return out, done


def in_parallel(work: Callable, items: Sequence, parallelism: int, spark: SparkSession) -> list:
    if parallelism == 1 or len(items) < 2:
        return [work(i) for i in items]
    with ThreadPool(min(parallelism, len(items))) as pool:
        return pool.map(inheritable_thread_target(spark)(work), items, chunksize=1)


def evaluate(
    df: DataFrame,
    spec: ModelSpec,
    columns: Sequence[str],
    *,
    n_outer: int | None = None,
    folds: DataFrame | None = None,
    n_inner: int = 10,
    seed: int = SEED,
    n_sets: int | None = None,
    select: Sequence[int] | None = None,
    parallelism: int = 1,
    search: bool = True,
    kinds: Mapping[str, str] | None = None,
) -> Evaluation:
    """Test the rows of every outer fold with a model that never saw them.

    `df` has `row_id`, `y` and the feature columns. Outer folds are either `n_outer` parts, with the test fold of
    each row in `part`, or a role table `folds` (fold_id, row_id, role): train and valid rows train, test rows are
    tested, in as many folds as test them. `n_sets` replaces features by fuzzy memberships, `select` adds recursive
    elimination with these feature counts to the grid. `search=False` takes the first cell without inner folds.
    Domain, scaling, selection and search of a fold use its training rows alone. Rows with a missing value are
    left out and returned in `dropped`. `parallelism` outer folds are worked on at a time.
    """
    if (n_outer is None) == (folds is None):
        raise ValueError("give either n_outer or folds")
    cells = spec.cells()
    own = [KEY, LABEL, *(["part"] if folds is None else [])]
    wanted = df.select(*own, *[F.col(f"`{c}`") for c in columns])
    rows = complete_rows(wanted, wanted.columns)
    numbers = range(n_outer) if folds is None else sorted(r.fold_id for r in folds.select("fold_id").distinct().collect())

    def used_rows(i: int) -> tuple[DataFrame, list[str]]:
        """The rows of fold i and their features: memberships in a domain of its own, if there are sets."""
        used = fold_rows(rows, i, folds)
        if not n_sets:
            return used, list(columns)
        # Fold 1 of a domain learns from the rows that are not in part 1: the training rows.
        domain = fuzzy_domain(used, columns, TESTED, kinds).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return fuzzy_rows(used, columns, domain, n_sets)
        finally:
            domain.unpersist()

    def fold_stack(i: int) -> tuple[stacked.Stack, list[int]]:
        """The stack of one fold on features of its own."""
        used, names = used_rows(i)
        roles = used.select(F.lit(i).alias("fold_id"), KEY, F.when(F.col(TESTED) == 1, TEST).otherwise(TRAIN).alias("role"))
        return stacked.stack(used, names, folds=roles, n_inner=n_inner if search else 1, seed=seed, alone=parallelism == 1)

    def fuzzy_stack() -> tuple[stacked.Stack, list[int]]:
        """One stack of all parts; each fold sees memberships in a domain of its own training rows."""
        used = rows.where("part is not null")
        settings = fitted(fuzzy_domain(used, columns, "part", kinds))
        places: dict[str, int] = {}
        flat, views, names = [], [], []
        for i in range(n_outer):
            own = [r for r in settings if r["fold_id"] == i]
            shared = {c for c, kind in column_kinds(used, columns, kinds).items() if kind == CATEGORICAL}
            grades, names = fuzzy_columns(used.withColumn("fold_id", F.lit(i)), columns, own, n_sets, "fold_id"), []
            views.append([])
            for c, n in check_sets(columns, own, n_sets).items():
                for j in range(n):
                    # Categories are those of all rows, so all folds share their memberships.
                    name = f"{c}-{j}" if c in shared else f"{i}:{c}-{j}"
                    if name not in places:
                        places[name] = len(flat)
                        flat.append(grades[len(names)].alias(name))
                    views[-1].append(places[name])
                    names.append(f"{c}-{j}")
        dealt = used.select(KEY, LABEL, "part", *flat)
        return stacked.stack(dealt, list(places), n_outer=n_outer, n_inner=n_inner if search else 1, seed=seed, views=[np.array(v) for v in views], names=names)

    # Neighbour models are stacked where the table may go to every task: one search serves all folds. Else each fold is a search in blocks.
    if spec.name in FITS and (spec.name != "KNN" or not select and not n_sets and stacked_neighbors.held_by_tasks(rows.count(), len(columns))):
        label_type = rows.schema[LABEL].dataType.simpleString()

        def whole(i: int | None) -> tuple[DataFrame, list[FoldFit]]:
            if i is not None:
                table, own = fold_stack(i)
            elif n_sets:
                table, own = fuzzy_stack()
            else:
                table, own = stacked.stack(rows, columns, n_outer=n_outer, folds=folds, n_inner=n_inner if search else 1, seed=seed)
            return evaluate_stacked(table, own, spec, n_inner, select, search, label_type)

        # One stack of all folds. Memberships of a role table differ by rows too, so each fold of them is a stack.
        parts = in_parallel(whole, list(numbers) if n_sets and folds is not None else [None], parallelism, df.sparkSession)
        if not numbers:
            raise ValueError("no outer folds")
        return Evaluation(reduce(DataFrame.unionByName, [p[0] for p in parts]), [f for p in parts for f in p[1]], dropped_rows(wanted, wanted.columns, KEY))

    def one(i: int) -> tuple[DataFrame, FoldFit]:
        used, names = used_rows(i)
        outer = used.where(f"{TESTED} = 0")
        test = used.where(f"{TESTED} = 1")
        settings = [(n, c) for n in (select or [None]) for c in cells]
        chosen, score = 0, None
        train = stratified_folds(outer, n_inner, LABEL, KEY, seed, "inner") if search else outer
        train = train.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if search:
                scores, held = inner_scores(train, spec, cells, names, n_inner, select, 1)
                top = best_cell(mean_scores(scores, keys=[]), keys=[]).first()
                held.unpersist()
                chosen, score = top["cell"], top["mean_score"]
            size, cell = settings[chosen]
            scaler = Standardize(names).fit(train)
            scaled, n = scaler.transform(train), train.count()
            kept = eliminate(scaled, len(names), [size])[size] if size else None
            fit = Fit(n, names if kept is None else [names[k] for k in kept])
            model = spec.make(cell, fit).fit(keep_features(scaled, kept))
        finally:
            # A model that refers to its training rows reads them again from the source.
            train.unpersist()
        tested = add_scores(model, keep_features(scaler.transform(test), kept), "p", "yhat")
        out = tested.select(F.lit(spec.name).alias("model"), F.lit(i).alias("fold_id"), KEY, LABEL, "p", F.col("yhat").cast("int").alias("yhat"))
        params = dict(cell) if size is None else {**cell, "n_features": size}
        return out, FoldFit(i, spec.name, params, score, list(fit.names), list(range(len(names))) if kept is None else list(kept), model)

    done = in_parallel(one, list(numbers), parallelism, df.sparkSession)
    if not done:
        raise ValueError("no outer folds")
    return Evaluation(reduce(DataFrame.unionByName, [d[0] for d in done]), [d[1] for d in done], dropped_rows(wanted, wanted.columns, KEY))
