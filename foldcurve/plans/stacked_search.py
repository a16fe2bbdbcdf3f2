"""Symbolic searches of all outer folds, inner folds and grid cells, a generation of all of them in one scan."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foldcurve.operators import forest
from foldcurve.operators.symbolic import Expression
from foldcurve.plans.estimators import KEY, LABEL
from foldcurve.plans.search import Found, Search, Searches
from foldcurve.plans.stacked import TESTED, Fold, Stack, arrays, moments, trains, viewed


class Scaled:
    """The rows of a batch as each fold scales them: by the moments of its training rows."""

    def __init__(self, table: Stack, folds: Sequence[Fold], scaling: dict) -> None:
        new = [f for f in dict.fromkeys(folds) if f not in scaling]
        if new:
            for f, n, mean, deviation in zip(new, *moments(table, new)):
                scaling[f] = (n, mean, deviation)
        self.centre, self.scale, self.views = table.centre, table.scale, table.views
        self.moments = {f: scaling[f][1:] for f in folds}

    def rows(self, batch: pa.RecordBatch, fold: Fold, which) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled columns, labels and numbers of the rows whose places `which` selects."""
        x, y, place = arrays(batch, self.centre, self.scale)
        at = np.flatnonzero(which(place))
        mean, deviation = self.moments[fold]
        return (viewed(self.views, x[at], fold.outer)[:, 1:] - mean) / deviation, y[at], at


def search_all(table: Stack, wanted: Sequence[tuple[Fold, Search]], scaling: dict) -> tuple[list[Found], Searches]:
    """The search of every (fold, settings) over the fold's training rows; fitness is the area under the curve."""
    scaled = Scaled(table, [f for f, _ in wanted], scaling)
    folds = [f for f, _ in wanted]

    def rows_of(batch: pa.RecordBatch, group: int) -> tuple[np.ndarray, np.ndarray]:
        fold = folds[group]
        return scaled.rows(batch, fold, lambda place: trains(place, [fold])[:, 0])[:2]

    def score(plans) -> dict:
        if not plans:
            return {}
        return forest.areas(table.rows.select(LABEL, "x", "place"), plans, rows_of, lambda g: (g,), ("search",), LABEL)

    searches = Searches(table.names, {i: s for i, (_, s) in enumerate(wanted)})
    found = searches.run(score)
    return [found[i] for i in range(len(wanted))], searches


def held_out_scores(table: Stack, fits: Sequence[tuple[Fold, int, Expression]], scaling: dict) -> DataFrame:
    """(outer, inner, cell, y, p): each row scored by the expressions whose inner fold holds it out. `fits`: (fold, cell, tree)."""
    scaled, plans = Scaled(table, [f for f, _, _ in fits], scaling), {}
    for i, (_, _, tree) in enumerate(fits):
        own = forest.Forest(table.names)
        root = own.add(tree)
        plans[i] = (own.needed([root]), [root])

    def rows_of(batch: pa.RecordBatch, group: int) -> tuple[np.ndarray, np.ndarray]:
        fold = fits[group][0]
        return scaled.rows(batch, fold, lambda place: place[:, fold.outer] == fold.inner)[:2]

    keys = [(f.outer, f.inner, cell) for f, cell, _ in fits]
    return forest.scores(table.rows, plans, rows_of, lambda g: keys[g], ("outer", "inner", "cell"), LABEL).drop("candidate")


def tested_scores(table: Stack, trees: Mapping[int, Expression], scaling: dict) -> DataFrame:
    """(outer, row_id, y, p, yhat): the rows that each outer fold tests, by its expression."""
    scaled = Scaled(table, [Fold(o) for o in trees], scaling)
    plans = {}
    for outer, tree in trees.items():
        own = forest.Forest(table.names)
        root = own.add(tree)
        plans[outer] = (own.needed([root]), root)
    key = table.rows.schema[KEY].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for outer, (plan, root) in plans.items():
                x, y, at = scaled.rows(batch, Fold(outer), lambda place: place[:, outer] == TESTED)
                if len(at):
                    with np.errstate(over="ignore"):
                        p = 1 / (1 + np.exp(-plan.values(x, [root])[:, 0]))
                    columns = [pa.array(np.full(len(at), outer, np.int32)), batch.column(KEY).take(pa.array(at)), pa.array(y.astype(np.int32)), pa.array(p), pa.array((p > 0.5).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["outer", KEY, LABEL, "p", "yhat"])

    return table.rows.mapInArrow(run, f"outer int, {KEY} {key}, {LABEL} int, p double, yhat int")
