"""Held-out scores of trees as counts."""

import random

from foldcurve.operators.roc import auc
from foldcurve.plans import stacked, stacked_trees


def test_scores_of_trees_are_counted_by_node(spark):
    draw = random.Random(12)
    data = []
    for i in range(900):
        x = [float(draw.randrange(5)) for _ in range(3)]
        data.append((i, i % 3, int(x[0] + x[1] + draw.random() * 4 > 6), *x))
    rows = spark.createDataFrame(data, "row_id long, part int, y int, a double, b double, c double").repartition(3)
    table, _ = stacked.stack(rows, ["a", "b", "c"], n_outer=3, n_inner=4)
    cuts = stacked_trees.cut_points(table)
    kinds = [stacked_trees.Kind(stacked.Fold(o, j), "gini") for o in range(3) for j in range(4)]
    trees = stacked_trees.grow(table, kinds, 3, cuts)
    held = stacked_trees.held_out_scores(table, trees, [[(1, 0), (3, 1)]] * len(trees), cuts)
    got = held.collect()
    # A row of each fold, cell and leaf of a task, not of each held-out row.
    assert len(got) < 900 and sum(r.n for r in got) == 900 * 2 * 2
    areas = {(r.outer, r.inner, r.cell): r for r in auc(held, ["outer", "inner", "cell"], times="n").collect()}
    points = {(r.outer, r.inner, r.cell): ([], []) for r in got}
    for r in got:
        points[r.outer, r.inner, r.cell][r.y].extend([r.p] * r.n)
    assert len(areas) == 24
    for key, (zeros, ones) in points.items():
        want = sum((p > q) + (p == q) / 2 for p in ones for q in zeros) / (len(ones) * len(zeros))
        assert abs(areas[key].auc - want) < 1e-12
        assert (areas[key].positives, areas[key].negatives) == (len(ones), len(zeros))
