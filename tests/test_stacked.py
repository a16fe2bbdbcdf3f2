"""Stacked fits against MLlib and brute force, and every registered query next to its SQL."""

import math
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from foldcurve.functions import scalars
from foldcurve.operators import forest, symbolic
from foldcurve.operators.folds import stratified_folds
from foldcurve.plans import queries, reports, stacked, stacked_trees
from foldcurve.plans.estimators import Standardize, add_scores
from foldcurve.plans.evaluate import eliminate, evaluate
from foldcurve.plans.registry import MODELS
from foldcurve.plans.search import Search, Searches, symbolic_search
from foldcurve.plans.stacked import Fold, Problem

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
import compare  # noqa: E402

COLUMNS = ["x0", "x1", "x2", "x3"]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = []
    for i in range(120):
        y = i % 2
        x = rng.normal(size=4) * [1, 50, 1, 0.01] + np.array([1.0 * y, -40 * y, 0, 7])
        data.append((i, (i // 2) % 3, y, *map(float, x)))
    return spark.createDataFrame(data, "row_id long, part int, y int, x0 double, x1 double, x2 double, x3 double").cache()


@pytest.fixture(scope="module")
def table(rows):
    return stacked.stack(rows, COLUMNS, n_outer=3, n_inner=4)[0]


def train_of(table, fold):
    place = F.col("place")[fold.outer]
    kept = (place >= 0) if fold.inner is None else (place >= 0) & (place != fold.inner)
    return table.rows.where(kept).select("row_id", F.col("y").cast("int").alias("y"), *[F.col("x")[i].alias(c) for i, c in enumerate(COLUMNS)])


def test_places_are_dealt_as_folds_are(rows, table):
    got = {r.row_id: r.place for r in table.rows.collect()}
    for o in range(3):
        dealt = {r.row_id: r.inner for r in stratified_folds(rows.where(F.col("part") != o), 4, name="inner").collect()}
        assert all(place[o] == dealt.get(i, stacked.TESTED) for i, place in got.items())


def test_role_tables_may_leave_rows_out(spark, rows):
    roles = [(7, i, "test" if i % 5 == 0 else "train") for i in range(60)] + [(9, i, "test" if i < 40 else "valid") for i in range(30, 120)]
    table, numbers = stacked.stack(rows, COLUMNS, folds=spark.createDataFrame(roles, "fold_id int, row_id long, role string"), n_inner=2)
    assert numbers == [7, 9]
    places = {r.row_id: r.place for r in table.rows.collect()}
    assert set(places) == set(range(120))
    assert [places[0][0], places[0][1], places[35][1], places[110][0]] == [stacked.TESTED, stacked.OUTSIDE, stacked.TESTED, stacked.OUTSIDE]
    assert places[1][0] in (0, 1) and places[119][1] in (0, 1)


def test_logistic_fits_are_those_of_mllib(table):
    problems = [Problem(Fold(o, i), C) for o in range(3) for i in (None, 0, 3) for C in (0.01, 1.0, 10.0)]
    fits = stacked.solve(table, problems)
    for fit in (fits[0], fits[4], fits[13], fits[26]):
        train = train_of(table, fit.problem.fold)
        scaled = Standardize(COLUMNS).fit(train).transform(train)
        model = LogisticRegression(featuresCol="features", labelCol="y", regParam=1 / (fit.problem.C * train.count()), standardization=False, tol=1e-12, maxIter=500).fit(scaled)
        assert np.abs(np.array(model.coefficients) - fit.weights).max() < 1e-4 and abs(model.intercept - fit.intercept) < 1e-4
        ours = {r.row_id: r.p for r in add_scores(stacked.LogisticModel(fit), scaled).collect()}
        theirs = {r.row_id: r.p for r in add_scores(model, scaled).collect()}
        assert max(abs(ours[i] - theirs[i]) for i in ours) < 1e-4
    assert all(f.slope <= stacked.GRADIENT for f in fits) and max(f.passes for f in fits) < 20


def test_sparse_fits_meet_the_conditions_of_their_optimum(table):
    (fit,) = stacked.solve(table, [Problem(Fold(0), 0.2, l1=True)])
    data = train_of(table, Fold(0)).collect()
    x = (np.array([[r[c] for c in COLUMNS] for r in data]) - fit.mean) / fit.deviation
    slope = x.T @ (1 / (1 + np.exp(-(x @ fit.weights + fit.intercept))) - [r.y for r in data])
    for w, s in zip(fit.weights, slope):
        assert abs(s + np.sign(w) / 0.2) < 1e-4 if w else abs(s) <= 1 / 0.2 + 1e-4
    assert (fit.weights == 0).any() and (fit.weights != 0).any()


def test_elimination_in_all_folds_is_that_of_single_fits(table):
    kept = stacked.eliminate_all(table, [Fold(o, i) for o in range(3) for i in (None, 1)], [1, 2, 3])
    for fold in (Fold(0), Fold(2, 1)):
        train = train_of(table, fold)
        assert {s: list(k) for s, k in kept[fold].items()} == eliminate(Standardize(COLUMNS).fit(train).transform(train), 4, [1, 2, 3])


def test_a_separable_class_and_a_constant_column(spark):
    data = [(i, i % 2, int(i >= 20), float(i), 3.0) for i in range(40)]
    table, _ = stacked.stack(spark.createDataFrame(data, "row_id long, part int, y int, a double, b double"), ["a", "b"], n_outer=2, n_inner=2)
    fits = stacked.solve(table, [Problem(Fold(o), C) for o in range(2) for C in (1.0, 1000.0)])
    assert all(np.isfinite(f.weights).all() and f.weights[1] == 0 and f.slope <= stacked.GRADIENT for f in fits)


def greedy(x, y, cuts, kind, depth):
    """(feature, threshold, left, right) or the class counts, by trying every cut."""
    def impure(v):
        n, ones = len(v), sum(v)
        p = ones / n if n else 0
        return n * 2 * p * (1 - p) if kind == "gini" else -n * sum(q * math.log2(q) for q in (p, 1 - p) if q)

    best = None
    if depth and 0 < sum(y) < len(y):
        for f in range(x.shape[1]):
            for b, cut in enumerate(cuts[f]):
                left = x[:, f] <= cut
                if left.all() or not left.any():
                    continue
                gain = round((impure(y) - impure(y[left]) - impure(y[~left])) / len(y), 12)
                if gain > stacked_trees.GAIN and (best is None or gain > best[0]):
                    best = (gain, f, b)
    if best is None:
        return (int(len(y) - sum(y)), int(sum(y)))
    _, f, b = best
    left = x[:, f] <= cuts[f][b]
    return (f, float(cuts[f][b]), greedy(x[left], y[left], cuts, kind, depth - 1), greedy(x[~left], y[~left], cuts, kind, depth - 1))


def nested(tree, node=0):
    if tree.feature[node] < 0:
        return tree.counts[node]
    return (tree.feature[node], tree.threshold[node], nested(tree, tree.left[node]), nested(tree, tree.right[node]))


def test_trees_grown_together_are_greedy_trees(table):
    cuts = stacked_trees.cut_points(table)
    kinds = [stacked_trees.Kind(Fold(o, i), k, s) for o in range(3) for i in (None, 2) for k in stacked_trees.IMPURITIES for s in (None, (1, 2))]
    for tree in stacked_trees.grow(table, kinds, 4, cuts):
        data = train_of(table, tree.kind.fold).collect()
        x, y = np.array([[r[c] for c in COLUMNS] for r in data]), np.array([r.y for r in data])
        own = [c if tree.kind.support is None or f in tree.kind.support else [] for f, c in enumerate(cuts[tree.kind.fold.outer])]
        assert nested(tree) == greedy(x, y, own, tree.kind.impurity, 4)
        assert nested(tree.cut(2)) == greedy(x, y, own, tree.kind.impurity, 2)
        assert len(tree.cut(2).rows()) == len(tree.cut(2).feature)


@pytest.mark.parametrize("name, grid", [("LOGR", {"C": [0.01, 1]}), ("DT", {"depth": [1, 3], "impurity": ["gini", "entropy"]}), ("KNN", {"k": [1, 5]}), ("GP", {"start_depth": [(2, 2)], "population": [12, 15], "tournament": [3], "generations": [2]})])
def test_stacked_evaluation_tests_every_row_once(rows, name, grid):
    out = evaluate(rows, MODELS[name].with_grid(**grid), COLUMNS, n_outer=3, n_inner=2)
    data = out.predictions.collect()
    assert sorted(r.row_id for r in data) == list(range(120)) and all(r.fold_id == (r.row_id // 2) % 3 for r in data)
    assert all(0 <= r.p <= 1 and r.yhat == int(r.p > 0.5) for r in data)
    best = out.best().collect()
    assert len(best) == 3 and all(0.5 < r.score <= 1 and set(r.params) == set(grid) for r in best)


def test_stacked_evaluation_with_memberships_and_selection(rows):
    out = evaluate(rows, MODELS["LOGR"].with_grid(C=[1]), COLUMNS, n_outer=3, n_inner=2, n_sets=3, select=[4, 6], parallelism=2)
    assert sorted(r.row_id for r in out.predictions.collect()) == list(range(120))
    assert all(len(f.names) == f.params["n_features"] == len(f.fitted.coefficients) for f in out.fits)
    assert reports.coefficient_table(rows.sparkSession, out.fits).count() == sum(len(f.names) for f in out.fits)


def test_stacked_neighbors_are_those_of_single_folds(rows, table):
    from foldcurve.plans import stacked_neighbors
    from foldcurve.plans.estimators import NeighborsModel

    folds = [Fold(o, i) for o in range(3) for i in range(4)]
    got = stacked_neighbors.held_out_scores(table, folds, [1, 3, 7], {}).collect()
    for fold in (Fold(0, 1), Fold(2, 3)):
        train = train_of(table, fold)
        hold = table.rows.where(F.col("place")[fold.outer] == fold.inner).select("row_id", F.col("y").cast("int").alias("y"), *[F.col("x")[i].alias(c) for i, c in enumerate(COLUMNS)])
        scaler = Standardize(COLUMNS).fit(train)
        want = sorted((r.cell, r.y, round(r.p, 9)) for r in NeighborsModel.score_all(scaler.transform(train), scaler.transform(hold), [1, 3, 7]).collect())
        assert sorted((r.cell, r.y, round(r.p, 9)) for r in got if (r.outer, r.inner) == (fold.outer, fold.inner)) == want
    assert not stacked_neighbors.fits(1 << 16, 2) and not stacked_neighbors.fits(1 << 14, 1 << 10)


def test_zero_distance_decides_alone_in_a_stack():
    from foldcurve.plans.stacked_neighbors import votes

    p = votes(np.array([[0.0, 0.0, 0.5], [1.0, 2.0, np.inf]]), np.array([1.0, 0.0, 0.0]), [2, 3])
    assert p[0].tolist() == [0.5, 0.5] and p[1].tolist() == [pytest.approx(1 / 1.5)] * 2


def test_nearest_are_the_first_of_a_stable_sort():
    from foldcurve.plans.stacked_neighbors import nearest

    rng = np.random.default_rng(2)
    for shape, k, levels in [((40, 90), 13, 5), ((40, 90), 13, 10**6), ((5, 7), 7, 3), ((5, 7), 9, 3), ((4, 1), 1, 2), ((0, 9), 3, 2)]:
        distance = rng.integers(0, levels, shape).astype(float)
        distance[rng.random(shape) < 0.1] = np.inf
        distance[:1, :-1] = np.nan
        assert (nearest(distance, k) == distance.argsort(axis=1, kind="stable")[:, :k]).all()


def test_stacked_rows_lie_in_tasks_for_all_cores(spark):
    """Small rows reach few tasks after a join; passes over them should use all cores."""
    data = spark.range(5000).selectExpr("id as row_id", "int(id % 3) as part", "int(id % 2) as y", "double(id % 7) as a")
    table, _ = stacked.stack(data.coalesce(1), ["a"], n_outer=3, n_inner=2)
    held = table.rows.select("row_id", F.spark_partition_id().alias("task")).collect()
    assert len({r.task for r in held}) >= 4 and sorted(r.row_id for r in held) == list(range(5000))


def test_leaves_are_counted_in_one_pass(table):
    kinds = [stacked_trees.Kind(Fold(o), k) for o in range(3) for k in stacked_trees.IMPURITIES]
    trees = stacked_trees.grow(table, kinds, 4)
    first = next(n for n, f in enumerate(trees[1].feature) if f < 0)
    trees[1].counts[first] = (trees[1].counts[first][0] + 1, trees[1].counts[first][1])
    for r in stacked_trees.leaf_matches(table, trees).collect():
        data = [(row.x, row.y) for row in table.rows.collect() if row.place[trees[r.tree].kind.fold.outer] >= 0]
        assert r.same == ((r.tree, r.leaf) != (1, first)) and r.n == sum(trees[r.tree].counts[r.leaf]) - ((r.tree, r.leaf) == (1, first))
        assert sum(x.n for x in stacked_trees.leaf_matches(table, [trees[r.tree]]).collect()) == len(data) if r.leaf == first else True


# --- expressions


def test_functions_on_numbers_equal_those_on_columns(spark):
    values = [-2.0, -0.0005, 0.0, 0.0005, 0.7, 3.0, math.nan, math.inf]
    df = spark.createDataFrame([(a, b) for a in values for b in values], "a double, b double")
    rows = df.collect()
    x = np.array([[r.a, r.b] for r in rows])
    own = forest.Forest(["a", "b"])
    trees = [(n, *["b", "a", 0.25][: f.operands]) if f.operands == 1 else (n, *["a", "b", 0.25][: f.operands]) for n, f in scalars.FUNCTIONS.items()]
    roots = [own.add(t) for t in trees]
    got = own.needed(roots).values(x, roots)
    want = df.select(*[symbolic.compile_expr(t, ["a", "b"]).alias(f"v{i}") for i, t in enumerate(trees)]).collect()
    for i, t in enumerate(trees):
        assert np.allclose(got[:, i], [r[i] for r in want], equal_nan=True, rtol=1e-15), t


def test_equal_subtrees_are_one_node():
    own = forest.Forest(["a", "b"])
    shared = ("mul", "a", ("add", "b", 1.0))
    first, second = own.add(("sub", shared, shared)), own.add(("add", shared, "a"))
    assert len(own.nodes) == 7 and own.add(("sub", shared, shared)) == first
    assert sorted(own.needed([second]).nodes) == sorted(set(range(7)) - {first})
    for bad in ("c", ("nope", "a"), ("add", "a")):
        with pytest.raises(ValueError):
            own.add(bad)


def test_expressions_are_scored_once(rows):
    settings = Search(population=40, generations=4, tournament=3, stop_at=None, crossover=0.3)
    searches, jobs = Searches(COLUMNS, {"a": settings, "b": settings}), []

    def score(plans):
        jobs.append({g: list(roots) for g, (_, roots) in plans.items()})
        return {(g, r): 1 / (1 + r) for g, (_, roots) in plans.items() for r in roots}

    found = searches.run(score)
    assert found["a"] == found["b"] and len(jobs) == 4
    for g in "ab":
        asked = [r for job in jobs for r in job.get(g, [])]
        assert len(asked) == len(set(asked))
    # Most of a generation are copies here.
    assert searches.scored == sum(len(r) for job in jobs for r in job.values()) < searches.asked


def test_search_agrees_with_columns(rows):
    """A function without an array form takes the way over columns; equal functions find the same expression."""
    columns = {c: F.col(c) for c in COLUMNS}
    settings = Search(population=12, generations=3, tournament=3, stop_at=None)
    by_arrays = symbolic_search(rows, columns, settings)
    plus = scalars.FUNCTIONS["add"]
    scalars.register(scalars.Named("add", 2, plus.apply))
    try:
        by_columns = symbolic_search(rows, columns, settings)
    finally:
        scalars.register(plus)
    assert by_arrays.tree == by_columns.tree and by_arrays.fitness == pytest.approx(by_columns.fitness, abs=1e-12)
    random.seed(1)


def test_permutation_importance_by_hand(rows):
    from foldcurve.operators import importance

    donated = {r.row_id: r["__donor"] for r in importance.with_donors(rows, COLUMNS, shift=3).collect()}
    own = {r.row_id: tuple(r[c] for c in COLUMNS) for r in rows.collect()}
    assert sorted(map(tuple, donated.values())) == sorted(own.values()) and all(tuple(donated[i]) != own[i] for i in own)
    out = {r.feature: r for r in importance.permutation_importance(rows, lambda x: x["x0"] - x["x1"], COLUMNS, shift=3).collect()}
    y = {r.row_id: r.y for r in rows.collect()}

    def area(p):
        pairs = [(p[i], p[j]) for i in y for j in y if y[i] > y[j]]
        return sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)

    whole = area({i: v[0] - v[1] for i, v in own.items()})
    assert out["x0"].auc == pytest.approx(area({i: donated[i].x0 - v[1] for i, v in own.items()}))
    assert out["x1"].importance == pytest.approx(whole - area({i: v[0] - donated[i].x1 for i, v in own.items()}))
    assert out["x2"].importance == 0 == out["x3"].importance and out["x1"].importance > 0
    assert importance.with_donors(rows.where("false"), COLUMNS).count() == 0
    grouped = importance.permutation_importance(rows, lambda x: x["x1"], COLUMNS, keys=["part"]).collect()
    assert len(grouped) == 12 and all(r.importance == 0 for r in grouped if r.feature != "x1")


# --- all registered queries


@pytest.fixture(scope="module")
def connection():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(n for n in queries.SQL if n not in ("pipeline",) and not n.startswith("op")))
def test_registered_query_equals_its_sql(spark, connection, name):
    result = compare.compare(spark, connection, SF, name)
    assert result.startswith("same"), result


def test_memberships_of_all_parts_are_one_stack(rows, monkeypatch):
    """The same scores as a stack of each fold gives, from one table that all folds read."""
    made, plain = [], stacked.stack

    def counted_stack(*args, **how):
        made.append(1)
        return plain(*args, **how)

    monkeypatch.setattr(stacked, "stack", counted_stack)
    spec, how = MODELS["DT"].with_grid(depth=[3], impurity=["gini"]), {"search": False, "n_sets": 3, "select": [11]}
    got = evaluate(rows, spec, COLUMNS, n_outer=3, **how)
    assert len(made) == 1
    roles = rows.select(F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("fold_id"), "row_id", "part").selectExpr("fold_id", "row_id", "if(part = fold_id, 'test', 'train') as role")
    want = evaluate(rows.drop("part"), spec, COLUMNS, folds=roles, parallelism=3, **how)
    assert len(made) == 4
    by = [{(r.fold_id, r.row_id): r for r in e.predictions.collect()} for e in (got, want)]
    assert by[0].keys() == by[1].keys()
    assert all(r.yhat == by[1][k].yhat and r.p == pytest.approx(by[1][k].p, abs=1e-9) for k, r in by[0].items())
    assert [(f.fold_id, f.names, f.params) for f in got.fits] == [(f.fold_id, f.names, f.params) for f in want.fits]


@pytest.mark.parametrize("range_rows", [1 << 20, 40])
def test_areas_of_packed_values_are_those_of_all_pairs(spark, range_rows):
    """Ties, both zeros, infinities and NaN (above all numbers); a task sends two lists for an expression, not a row for each value."""
    special = [0.0, -0.0, math.inf, -math.inf, math.nan, 1e-310, -2.5]
    data = [(i % 2 if i % 7 else 1, [special[i % 7] if i % 3 == 0 else math.sin(i), float(i % 5)]) for i in range(300)]
    df = spark.createDataFrame(data, "y int, x array<double>").repartition(3)
    own = forest.Forest(["a", "b"])
    roots = [own.add(t) for t in ("a", "b", ("add", "a", "b"), ("div", "b", "a"), 1.0)]

    def rows_of(batch, group):
        return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), batch.column("y").to_numpy(zero_copy_only=False)

    plans = {0: (own.needed(roots), roots)}
    got = forest.areas(df, plans, rows_of, lambda g: (g,), ("search",), "y", range_rows)
    x, y = np.array([r[1] for r in data]), np.array([r[0] for r in data])
    values = plans[0][0].values(x, roots)
    for c, root in enumerate(roots):
        rank = [(math.isnan(v), 0.0 if math.isnan(v) else v) for v in values[:, c]]
        pos, neg = [r for r, l in zip(rank, y) if l], [r for r, l in zip(rank, y) if not l]
        want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
        assert got[(0, root)] == pytest.approx(want, abs=1e-12)
    lists = forest.value_lists(df, plans, rows_of, ("search",), lambda g: (g,), "y", {0: np.empty((len(roots), 0), np.uint64)})
    assert lists.count() <= 2 * 3 * len(roots)
    one = forest.areas(df.where("y = 1"), plans, rows_of, lambda g: (g,), ("search",), "y")
    assert all(area is None for area in one.values())
