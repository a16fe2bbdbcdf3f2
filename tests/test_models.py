"""Neighbours, expressions, searches, fits and the whole job, on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from foldcurve.functions import scalars
from foldcurve.operators import neighbors, symbolic
from foldcurve.plans import model_queries, reports
from foldcurve.plans.estimators import BoostedTrees, NeighborsModel, RbfClassifier, Standardize, SymbolicClassifier, add_scores
from foldcurve.plans.evaluate import eliminate, evaluate, fit_cells
from foldcurve.plans.experiment import Run, parts_from_folds, replay, run_experiment
from foldcurve.plans.registry import ALL_MODELS, MODELS, Fit
from foldcurve.plans.search import Breeder, Search, nodes, symbolic_search
from foldcurve.session import cut_lineage
from foldcurve.sources.tables import read_results

COLUMNS = ["x0", "x1", "x2", "x3"]


@pytest.fixture(scope="module")
def rows(spark):
    """x0 and x1 tell the class, x2 and x3 are noise."""
    rng = np.random.default_rng(3)
    data = []
    for i in range(90):
        y = i % 2
        x = rng.normal(size=4) + np.array([2.0 * y, -1.5 * y, 0, 0])
        data.append((i, (i // 2) % 3, y, *map(float, x)))
    df = spark.createDataFrame(data, "row_id long, part int, y int, x0 double, x1 double, x2 double, x3 double")
    return df.coalesce(1).cache()


@pytest.fixture(scope="module")
def scaled(rows):
    return Standardize(COLUMNS).fit(rows).transform(rows).cache()


def brute_neighbors(data, k, apart):
    out = {}
    for i, p, x, _ in data:
        found = sorted((sum(abs(a - b) for a, b in zip(x, z)), j) for j, q, z, _ in data if not apart or p != q)
        out[i] = found[:k]
    return out


@pytest.mark.parametrize(
    "pivots, block, apart, crowded", [(1, 1000, True, 0.25), (9, 16, True, 2.0), (9, 16, False, -1.0), (9, 40, True, -1.0), (500, 7, True, 2.0)]
)
def test_neighbors_equal_brute_force(spark, monkeypatch, pivots, block, apart, crowded):
    """With cells searched one by one (a share above 1) and together (below 0)."""
    monkeypatch.setattr(neighbors, "CROWDED", crowded)
    random.seed(pivots)
    # Half of the rows are copies of a few points: crowded cells and many ties.
    data = [(i, i % 4, [float(i % 3), 1.0] if i % 2 else [random.gauss(0, 5), random.gauss(0, 5)], i % 5 % 2) for i in range(150)]
    df = spark.createDataFrame(data, "row_id long, part int, features array<double>, y int")
    found = neighbors.nearest_neighbors(df, df, 4, part="part" if apart else None, n_pivots=pivots, block=block).collect()
    want = brute_neighbors(data, 4, apart)
    assert len(found) == sum(map(len, want.values()))
    for i, near in want.items():
        mine = sorted((r["rank"], r.distance, r.neighbor) for r in found if r.row_id == i)
        assert [m[2] for m in mine] == [j for _, j in near]
        assert [m[1] for m in mine] == pytest.approx([d for d, _ in near])


def test_neighbor_tasks_hold_few_pairs_at_once(spark, monkeypatch):
    """Rows of a batch are placed, counted and routed a few at a time, whatever the number of cells."""
    whole, most = neighbors.manhattan, 64 * 8

    def checked(left, right):
        if len(left) * len(right) > most:
            raise ValueError("too many pairs at once")
        return whole(left, right)

    monkeypatch.setattr(neighbors, "PAIRS", most, raising=False)
    monkeypatch.setattr(neighbors, "NUMBERS", 6, raising=False)
    monkeypatch.setattr(neighbors, "manhattan", checked)
    random.seed(5)
    data = [(i, i % 4, [random.gauss(0, 5), random.gauss(0, 5)], i % 2) for i in range(150)]
    df = spark.createDataFrame(data, "row_id long, part int, features array<double>, y int")
    found = neighbors.nearest_neighbors(df, df, 4, part="part", n_pivots=64).collect()
    want = brute_neighbors(data, 4, True)
    assert all([r.neighbor for r in sorted(found, key=lambda r: r["rank"]) if r.row_id == i] == [j for _, j in near] for i, near in want.items())


@pytest.mark.parametrize("features", [1, 2, 64, 200])
def test_rounded_filter_equals_brute_force(features):
    """Also with ties, constant features, features of very different size, and excluded pairs."""
    rng = np.random.default_rng(features)
    scale = 10.0 ** rng.integers(-6, 7, features)
    points = np.round(rng.normal(size=(300, features)), 1) * scale + scale
    points[:, 0] = 4.0
    points[100:200] = points[:100]
    asks = np.concatenate([points[::7], rng.normal(size=(20, features)) * scale])
    allowed = rng.random((len(asks), len(points))) < 0.8
    allowed[3] = False
    allowed[4, 2:] = False
    for k in (1, 5, 299, 300, 400):
        exact = np.where(allowed, neighbors.manhattan(asks, points), np.inf)
        want = exact.argsort(axis=1, kind="stable")[:, :k]
        bound = np.sort(exact, axis=1)[:, min(k, 300) - 1]
        for limit in (None, bound):
            ask, point, distance, _ = neighbors.nearest_in_block(asks, points, k, allowed, limit)
            for i in range(len(asks)):
                mine = [j for j in want[i] if np.isfinite(exact[i, j])]
                assert point[ask == i].tolist() == mine
                assert distance[ask == i].tolist() == exact[i, mine].tolist()


def test_rounded_filter_leaves_few_exact_comparisons():
    """Unrelated features, where no pivot excludes anything."""
    rng = np.random.default_rng(5)
    asks, points = rng.normal(size=(200, 64)), rng.normal(size=(2048, 64))
    assert neighbors.nearest_in_block(asks, points, 5)[3] < 0.05 * 200 * 2048


def test_filter_of_extreme_numbers():
    """Where no range is a finite number, all pairs are compared; a distance that is none has no pair."""
    points = np.array([[1e308, 0.0], [-1e308, 0.0], [1e308, 1e308], [0.0, 1.0]])
    ask, point, distance, compared = neighbors.nearest_in_block(points, points, 2)
    assert compared == 16 and point[ask == 3].tolist()[0] == 3 and np.isfinite(distance).all()
    empty = np.empty((0, 2))
    assert all(len(x) == 0 for x in neighbors.nearest_in_block(points, empty, 2)[:3])
    assert all(len(x) == 0 for x in neighbors.nearest_in_block(empty, points, 2)[:3])


def test_few_training_rows_are_all_found(spark):
    df = spark.createDataFrame([(i, i % 2, [float(i)], 1) for i in range(4)], "row_id long, part int, features array<double>, y int")
    assert neighbors.nearest_neighbors(df, df, 9, part="part").count() == 8


def test_zero_distance_decides_alone(spark):
    near = spark.createDataFrame(
        [(1, 0.0, 1.0), (1, 0.0, 0.0), (1, 0.5, 0.0), (2, 1.0, 1.0), (2, 2.0, 0.0)], "row_id long, distance double, y double"
    )
    p = {r.row_id: r.p for r in neighbors.neighbor_probability(near, ["row_id"]).collect()}
    assert p == {1: 0.5, 2: pytest.approx(1 / 1.5)}


PYTHON = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: a / b if abs(b) > 0.001 else 1.0,
    "sqrt": lambda b: math.sqrt(abs(b)),
    "neg": lambda b: -b,
    "abs": abs,
    "WA": lambda a, b, x: x * a + (1 - x) * b,
    "OWA": lambda a, b, x: x * max(a, b) + (1 - x) * min(a, b),
    "min": min,
    "max": max,
    "dilator": lambda b: b**0.5 if b >= 0 else math.nan,
    "concentrator": lambda b: b**2,
}


@pytest.mark.parametrize("name", sorted(PYTHON))
def test_scalar_functions(spark, name):
    values = [-2.0, -0.0005, 0.0, 0.0005, 0.7, 3.0]
    df = spark.createDataFrame([(a, b) for a in values for b in values], "a double, b double")
    n = scalars.FUNCTIONS[name].operands
    tree = (name, *["b", "a", 0.25][:n]) if n == 1 else (name, *["a", "b", 0.25][:n])
    got = df.select("a", "b", symbolic.compile_expr(tree, ["a", "b"]).alias("v")).collect()
    for r in got:
        args = (r.b,) if n == 1 else (r.a, r.b, 0.25)[:n]
        want = PYTHON[name](*args)
        assert r.v == pytest.approx(want, nan_ok=True)


def test_nan_operands(spark):
    df = spark.createDataFrame([(1.0, math.nan)], "a double, b double")
    get = lambda tree: df.select(symbolic.compile_expr(tree, ["a", "b"])).first()[0]
    assert math.isnan(get(("min", "a", "b"))) and math.isnan(get(("max", "b", "a")))
    assert get(("div", "a", "b")) == 1.0


def test_expression_errors_and_text(spark):
    tree = ("sub", "R4-R20", ("mul", "S", 0.5))
    assert symbolic.to_text(tree) == "sub(R4-R20, mul(S, 0.5))"
    assert (symbolic.depth(tree), symbolic.length(tree)) == (2, 5)
    for bad in ("nope", ("nope", 1.0), ("add", 1.0)):
        with pytest.raises(ValueError):
            symbolic.compile_expr(bad, ["S"])
    scalars.register(scalars.Named("half", 1, lambda a, b, x: b / 2))
    assert spark.range(1).select(symbolic.compile_expr(("half", 3.0), [])).first()[0] == 1.5
    del scalars.FUNCTIONS["half"]


def test_population_chunks_agree(rows):
    trees = ["x0", ("neg", "x0"), ("sub", "x0", "x1"), ("add", "x2", "x3"), ("div", "x0", "x2")]
    whole = {r.candidate: r.fitness for r in symbolic.population_auc(rows, trees, COLUMNS).collect()}
    split = {r.candidate: r.fitness for r in symbolic.population_auc(rows, trees, COLUMNS, chunk=2).collect()}
    assert whole == split and len(whole) == 5
    assert whole[0] == pytest.approx(1 - whole[1])


def test_search_is_seeded_and_bred_trees_are_valid(rows):
    settings = Search(population=12, generations=2, tournament=3, stop_at=None)
    columns = {c: F.col(c) for c in COLUMNS}
    found = symbolic_search(rows, columns, settings)
    assert found == symbolic_search(rows, columns, settings)
    assert found.fitness > 0.6 and found.generation == 1
    breeder = Breeder(COLUMNS, settings)
    people = [breeder.start() for _ in range(30)]
    for _ in range(40):
        child = breeder.child(lambda: breeder.random.choice(people))
        for tree in (child, breeder.hoist(child), breeder.points(child)):
            assert symbolic.depth(tree) <= 17
            assert all(n[0] in settings.functions if isinstance(n, tuple) else n in COLUMNS or -1 <= n <= 1 for _, n in nodes(tree))


def area(df):
    from foldcurve.operators.roc import auc

    return auc(df.withColumn("model", F.lit("m"))).first().auc


def test_own_estimators_learn(scaled):
    for estimator in (
        RbfClassifier(C=1, gamma=0.1, n_features=64, max_iter=20),
        BoostedTrees(depth=1, rounds=3, cut_every=2),
        SymbolicClassifier(COLUMNS, Search(population=15, generations=1)),
    ):
        model = estimator.fit(scaled)
        assert area(add_scores(model, scaled)) > 0.8
        out = model.transform(scaled)
        assert {"probability", "prediction"} <= set(out.columns)


def test_standardize_vector(rows, scaled):
    from pyspark.ml.functions import vector_to_array

    first = scaled.select(vector_to_array("features")[0].alias("v"))
    r = first.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).first()
    assert r.m == pytest.approx(0, abs=1e-12) and r.s == pytest.approx(1)


def test_elimination_keeps_the_telling_features(scaled):
    kept = eliminate(scaled, 4, [2, 3])
    assert kept[2] == [0, 1] and set(kept[2]) < set(kept[3])


def test_logistic_fit_is_a_minimum(scaled):
    """At the optimum the gradient of summed loss plus penalty vanishes."""
    n, C = 90, 2.0
    model = MODELS["LOGR"].make({"C": C}, Fit(n, COLUMNS)).fit(scaled)
    w, b = np.array(model.coefficients), model.intercept
    data = scaled.select("features", "y").collect()
    x, y = np.array([r.features.toArray() for r in data]), np.array([r.y for r in data])
    residual = 1 / (1 + np.exp(-(x @ w + b))) - y
    assert np.abs(C * (x.T @ residual) + w).max() < 0.05 and abs(residual.sum()) < 0.05


def test_grids():
    assert set(MODELS) == {*ALL_MODELS, "GP"}
    sizes = {m: len(MODELS[m].cells()) for m in MODELS}
    # Depths above 30 are clipped, so the forests lose 6 repeated cells and the tree none.
    assert sizes == {"SVM": 45, "KNN": 7, "ADAB": 48, "RF": 48, "LGB": 48, "XGB": 48, "DT": 12, "LOGR": 8, "GP": 150}


def test_several_neighbor_sizes_from_one_search(scaled):
    train, hold = scaled.where("part <> 0"), scaled.where("part = 0")
    both = NeighborsModel.score_all(train, hold, [1, 5])
    assert both.groupBy("cell").count().orderBy("cell").collect() == [(0, 30), (1, 30)]
    one = MODELS["KNN"].make({"k": 5}, Fit(60, COLUMNS)).fit(train)
    assert area(both.where("cell = 1")) == pytest.approx(area(add_scores(one, hold)))


def test_parallel_fits(scaled):
    models = fit_cells(scaled, MODELS["DT"], [{"depth": 1, "impurity": "gini"}, {"depth": 2, "impurity": "gini"}], Fit(90, COLUMNS), 2)
    assert [m.getMaxDepth() for m in models] == [1, 2]


def test_nested_evaluation_tests_every_row_once(rows):
    spec = MODELS["DT"].with_grid(depth=[1, 2], impurity=["gini"])
    out = evaluate(rows, spec, COLUMNS, n_outer=3, n_inner=2, select=[1, 2])
    data = out.predictions.collect()
    assert sorted(r.row_id for r in data) == list(range(90))
    assert all(r.fold_id == (r.row_id // 2) % 3 for r in data)
    best = out.best().collect()
    assert len(best) == 3 and all(0.5 < r.score <= 1 and set(r.params) == {"depth", "impurity", "n_features"} for r in best)
    table = reports.selection_table(rows.sparkSession, out.fits, COLUMNS)
    shares = {r.feature: r.frequency for r in reports.selection_frequency(table).collect()}
    assert shares["x0"] == 1.0


def test_tree_report(spark, scaled):
    fitted = DecisionTreeClassifier(featuresCol="features", labelCol="y", maxDepth=3).fit(scaled)
    nodes = spark.createDataFrame(reports.node_rows(0, "DT", fitted), reports.NODES)
    text = reports.node_text(reports.tree_structure(nodes)).orderBy("node_id").collect()
    assert len(text) == fitted.numNodes and max(r.depth for r in text) == fitted.depth
    assert text[0].text.startswith("#0: feature ") and text[0].text.endswith(f"-> #{text[0].right}")
    assert all(r.is_leaf == (r.left is None) for r in text)
    assert sum(r.is_leaf for r in text) == (fitted.numNodes + 1) // 2


def test_whole_job_writes_all_tables(spark, rows, tmp_path):
    folds = rows.select("row_id", F.col("part").alias("fold_id"), F.lit("test").alias("role"))
    df = parts_from_folds(rows.drop("part"), folds)
    run = Run("sa", "plain", "fuzzy", models=("DT",), n_inner=2, grids={"DT": {"depth": [2], "impurity": ["gini"]}})
    baseline = rows.select("row_id", F.col("x0").alias("BFP"))
    report, fits = run_experiment(df, COLUMNS, run, str(tmp_path), n_outer=3, baseline=baseline)
    assert len(fits) == 3
    got = {r.model: r for r in report.collect()}
    assert set(got) == {"DT", "BFP"} and all(0.5 < r.AUC <= 1 for r in got.values())
    for kind, n in (("class", 90), ("cc", 90), ("result", 90), ("params", 3), ("roc", 2)):
        assert spark.read.parquet(f"{tmp_path}/{kind}").count() == n
    stored = read_results(spark, f"{tmp_path}/result", ["BFP", "DT"])
    again = {r.model: r for r in replay(stored).collect()}
    assert {m: r.AUC for m, r in again.items()} == {m: r.AUC for m, r in got.items()}


def test_checkpoint_folder(spark):
    assert cut_lineage(spark.range(5)).count() == 5
    assert spark.sparkContext.getCheckpointDir() is not None


MODEL_QUERIES = {
    "adaboost_scores": "ADAB", "gbt_scores": "XGB", "gbt_slow_scores": "LGB", "search_scores": "GP", "expression_table": "GP",
    "nested_eval": "DT", "nested_eval_knn": "KNN", "nested_best_params": "LOGR",
}


@pytest.mark.parametrize("name", MODEL_QUERIES)
def test_registered_models_do_the_whole_job(name, monkeypatch):
    """Ten folds of both kinds, the whole grid where one is searched, and no size below the grid's least."""

    class Asked(Exception):
        pass

    def asked(rows, spec, columns, **how):
        raise Asked(spec, how)

    monkeypatch.setattr(model_queries, "document_rows", lambda *_: None)
    monkeypatch.setattr(model_queries, "cut_lineage", lambda rows: rows)
    monkeypatch.setattr(model_queries, "evaluate", asked)
    with pytest.raises(Asked) as caught:
        getattr(model_queries, name)(None, "")
    spec, how = caught.value.args
    whole = MODELS[MODEL_QUERIES[name]]
    assert spec.name == whole.name and how["n_outer"] == 10
    if how.get("search", True):
        assert how["n_inner"] == 10 and spec.cells() == whole.cells()
    else:
        (cell,) = spec.cells()
        assert all(cell[k] >= min(v) for k, v in whole.grid.items())
        assert cell.get("rounds", 30) > BoostedTrees(1, 1).cut_every
        assert cell.get("stop_at") is None


def test_registered_search_breeds(rows):
    """With the settings that are registered, but for the population, the last generation is reached."""
    settings = Search(**{**model_queries.SEARCH, "population": 8})
    assert symbolic_search(rows, {c: F.col(c) for c in COLUMNS}, settings).generation == 4
