"""One neighbour search for all folds of a table that is too large to compare all rows."""

import numpy as np
import pytest

from foldcurve.operators import neighbors
from foldcurve.plans import evaluate as evaluation
from foldcurve.plans import stacked, stacked_neighbors
from foldcurve.plans.evaluate import evaluate
from foldcurve.plans.registry import MODELS
from foldcurve.plans.stacked import Fold

COLUMNS = ["a", "b", "c"]


def tables(spark, kind):
    """Unrelated rows, with a few far ones; copies of few rows, which are more than any list of near rows; one value only."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 3)) * [1, 10, 0.1] + (rng.random((400, 1)) < 0.02) * 300
    if kind == "copies":
        x[:250] = x[[0, 1]][np.arange(250) % 2]
        x[250:330] = x[250]
    if kind == "equal":
        x[:] = 1.0
    data = [(i, i * 7 % 3, int(rng.random() < 0.5), *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(data, "row_id long, part int, y int, a double, b double, c double")


@pytest.mark.parametrize("kind", ["far", "copies", "equal"])
def test_one_search_for_all_folds_is_that_of_each_fold(spark, monkeypatch, kind):
    table, _ = stacked.stack(tables(spark, kind), COLUMNS, n_outer=3, n_inner=4)
    folds, sizes, tested = [Fold(o, i) for o in range(3) for i in range(4)], [1, 3, 7], {0: 7, 1: 1, 2: 3}

    def scores():
        held = stacked_neighbors.held_out_scores(table, folds, sizes, {}).collect()
        last = stacked_neighbors.tested_scores(table, tested, {}).collect()
        return sorted((*r[:4], round(r.p, 12)) for r in held), sorted((*r[:3], round(r.p, 12), r.yhat) for r in last)

    want = scores()
    monkeypatch.setattr(stacked_neighbors, "ROWS", 100)
    monkeypatch.setattr(stacked_neighbors, "LEAF", 16, raising=False)
    monkeypatch.setattr(stacked_neighbors, "LEAVES", 2, raising=False)
    assert not stacked_neighbors.fits(400, 3) and scores() == want
    assert len(want[0]) == 400 * 2 * 3 and len(want[1]) == 400


def test_many_rows_are_searched_once_and_not_by_each_fold(spark, monkeypatch):
    def never(*_):
        raise AssertionError("a search for each fold")

    monkeypatch.setattr(stacked_neighbors, "ROWS", 100)
    monkeypatch.setattr(evaluation, "inner_scores", never)
    out = evaluate(tables(spark, "far"), MODELS["KNN"].with_grid(k=[1, 5]), COLUMNS, n_outer=3, n_inner=2)
    assert sorted(r.row_id for r in out.predictions.collect()) == list(range(400)) and len(out.fits) == 3


def test_a_row_behind_equal_ones_in_every_fold_is_not_searched():
    rng = np.random.default_rng(2)
    x, place = np.repeat(rng.normal(size=(3, 2)), [200, 1, 30], axis=0), rng.integers(-1, 3, size=(231, 2))
    folds = [Fold(o, i) for o in range(2) for i in (None, 0, 1, 2)]
    kept = stacked_neighbors.needed(x, place, folds, 4)
    want = set()
    for fold in folds:
        trained = np.flatnonzero(stacked.trains(place, [fold])[:, 0])
        for low, high in ((0, 200), (200, 201), (201, 231)):
            want |= set(trained[(trained >= low) & (trained < high)][:4].tolist())
    assert set(kept.tolist()) - {200} == want - {200} and len(kept) < 100


def test_a_crowded_search_copies_no_row_for_a_block(spark, monkeypatch):
    """Blocks meet in tasks that read them; several parts of the training rows, ties, a label that is missing."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 5)).astype("float32").astype(float)
    x[200:260] = x[5]
    x[260:] += 0.1
    data = [(i, i % 4, [float(v) for v in r], None if i == 5 else i % 2) for i, r in enumerate(x)]
    rows = spark.createDataFrame(data, "row_id long, part int, features array<double>, y int").repartition(9)
    monkeypatch.setattr(neighbors, "CROWDED", -1.0)
    for read, apart in ((1 << 23, None), (300, "part")):
        monkeypatch.setattr(neighbors, "READ", read, raising=False)
        near = neighbors.nearest_neighbors(rows, rows, 4, part=apart, block=32)
        plan = near._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "FlatMapCoGroups" not in plan
        got = {}
        for r in near.collect():
            got.setdefault(r.row_id, []).append((r["rank"], r.neighbor, r.distance, r.y))
        away = neighbors.manhattan(x, x)
        for i in range(300):
            far = np.where(np.arange(300) % 4 != i % 4, away[i], np.inf) if apart else away[i]
            want = far.argsort(kind="stable")[:4]
            assert [g[1:] for g in sorted(got[i])] == [(j, far[j], data[j][3]) for j in want.tolist()]


def test_a_bound_of_the_search_excludes_rows_without_their_ranks():
    rng = np.random.default_rng(3)
    asks, points = rng.normal(size=(50, 64)), rng.normal(size=(500, 64))
    exact = neighbors.manhattan(asks, points)
    bound = np.sort(exact, axis=1)[:, 2]
    ask, point, distance, compared = neighbors.nearest_in_block(asks, points, 5, None, bound)
    assert compared < 0.05 * exact.size
    assert {(a, p) for a, p in zip(*np.nonzero(exact <= bound[:, None]))} <= set(zip(ask.tolist(), point.tolist()))


def test_scores_of_a_crowded_search_are_votes_of_the_nearest(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(120, 6)), rng.integers(0, 2, 120)
    rows = spark.createDataFrame([(i, i % 5, [float(v) for v in r], int(y[i])) for i, r in enumerate(x)], "row_id long, part int, features array<double>, y int")
    monkeypatch.setattr(neighbors, "CROWDED", -1.0)
    monkeypatch.setattr(neighbors, "READ", 200, raising=False)
    scores = neighbors.knn_scores(rows, rows, 5, part="part", block=16)
    assert "Generate" not in scores._jdf.queryExecution().optimizedPlan().toString()
    got = {r.row_id: (r.p, r.yhat) for r in scores.collect()}
    away = np.where(np.arange(120)[:, None] % 5 != np.arange(120) % 5, neighbors.manhattan(x, x), np.inf)
    for i in range(120):
        near = away[i].argsort()[:5]
        p = (y[near] / away[i, near]).sum() / (1 / away[i, near]).sum()
        assert got[i] == (pytest.approx(p), int(p > 0.5))
