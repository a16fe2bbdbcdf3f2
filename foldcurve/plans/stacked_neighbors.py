"""Neighbour models of all outer folds, inner folds and grid cells over a table that fits in a task.

A table of at most `VALUES` numbers, counted before, goes to every task as arrays, and one
pass scores all folds and all numbers of neighbours. Up to `ROWS` rows, each fold measures all
of its distances. Above, one search serves all folds: they differ in scale and in the rows
that they leave out, so a row takes its nearest rows by a distance that is least in every fold,
measures those in each of its folds, and takes more of them until the k-th distance of the
fold is below all that was not measured. Larger tables take the way of plans/evaluate.py, one
blocked search for each fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from foldcurve.operators.neighbors import SLACK, manhattan
from foldcurve.plans.estimators import KEY, LABEL
from foldcurve.plans.stacked import OUTSIDE, TESTED, Fold, Stack, arrays, moments, trains

#: Rows that are compared with all others, and rows times columns that may go to every task: 32 MB.
ROWS, VALUES = 1 << 15, 1 << 22
#: Distances held at once in a task.
PAIRS = 1 << 22
#: Rows of a leaf, leaves measured at a time, and rows and near rows held at once in a task.
LEAF, LEAVES, NEAR = 128, 16, 1 << 20


def fits(rows: int, columns: int) -> bool:
    return rows <= ROWS and held_by_tasks(rows, columns)


def held_by_tasks(rows: int, columns: int) -> bool:
    return rows * columns <= VALUES


def nearest(distance: np.ndarray, k: int) -> np.ndarray:
    """The k least of each row, nearest first, equal distances by their place: only these are sorted."""
    rows, columns = distance.shape
    if k >= columns:
        return distance.argsort(axis=1, kind="stable")
    limit = np.partition(distance, k - 1, axis=1)[:, k - 1, None]
    if np.isnan(limit).any():
        return distance.argsort(axis=1, kind="stable")[:, :k]
    # As many of the rows at the limit as are left, the first ones: key order decides ties.
    below = distance < limit
    at_limit = distance == limit
    for row in np.flatnonzero(below.sum(axis=1) + at_limit.sum(axis=1) > k):
        tied = np.flatnonzero(at_limit[row])
        at_limit[row, tied[k - int(below[row].sum()) :]] = False
    top = np.nonzero(below | at_limit)[1].reshape(rows, k)
    order = np.take_along_axis(distance, top, axis=1).argsort(axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1)


def votes(distance: np.ndarray, labels: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    """Share of class 1 for each row and number of neighbours: votes by inverse distance, rows at distance 0 alone where there are any.

    Labels are those of the columns, or of each row's own ones.
    """
    out = np.empty((len(distance), len(sizes)))
    top = nearest(distance, max(sizes))
    near = np.take_along_axis(distance, top, axis=1)
    y = np.where(np.isfinite(near), labels[top] if labels.ndim == 1 else np.take_along_axis(labels, top, axis=1), 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = np.where(near > 0, 1 / near, 0.0)
        for c, k in enumerate(sizes):
            same = (near[:, :k] == 0).sum(axis=1)
            by_same = (y[:, :k] * (near[:, :k] == 0)).sum(axis=1) / same
            by_distance = (y[:, :k] * weight[:, :k]).sum(axis=1) / weight[:, :k].sum(axis=1)
            out[:, c] = np.where(same > 0, by_same, by_distance)
    return out


def leaves(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Numbers of the rows in groups of `most` at most, cut at the median of the feature that is spread most."""
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        some, half = x[rows], len(rows) // 2
        order = np.argpartition(some[:, np.abs(some - some.mean(axis=0)).sum(axis=0).argmax()], half)
        todo += [rows[order[half:]], rows[order[:half]]]
    return out


def needed(x: np.ndarray, place: np.ndarray, folds: Sequence[Fold], k: int) -> np.ndarray:
    """Numbers of the rows that may be among k neighbours: not those behind k equal rows in every fold that they train."""
    _, group, size = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    often = np.flatnonzero(size[group] > k)
    order = often[np.argsort(group[often], kind="stable")]
    _, first, at = np.unique(group[order], return_index=True, return_inverse=True)
    used = np.zeros(len(order), bool)
    for fold in folds:
        trained = trains(place[order], [fold])[:, 0]
        so_far = np.cumsum(trained)
        used |= trained & (so_far - (so_far - trained)[first][at] <= k)
    keep = np.ones(len(x), bool)
    keep[order] = used
    return np.flatnonzero(keep)


class Neighbors:
    """The whole table as arrays in key order, and the scale of each fold."""

    def __init__(self, table: Stack, folds: Sequence[Fold], scaling: dict) -> None:
        held = table.rows.select(KEY, LABEL, "x", "place").orderBy(KEY).toArrow().combine_chunks()
        n = held.num_rows
        if not held_by_tasks(n, len(table.names)):
            raise ValueError(f"{n} rows are too many for every task")
        new = [f for f in folds if f not in scaling]
        if new:
            for f, count, mean, deviation in zip(new, *moments(table, new)):
                scaling[f] = (count, mean, deviation)
        self.deviation = {f: scaling[f][2] for f in folds}
        self.centre, self.scale = table.centre, table.scale
        x, place = (pc.list_flatten(held.column(c)).to_numpy().reshape(n, size) for c, size in (("x", len(table.names)), ("place", table.n_outer)))
        self.x = (x - table.centre) / table.scale
        self.y = held.column(LABEL).to_numpy().astype(float)
        self.place = place.astype(np.int16)
        self.key = held.column(KEY).combine_chunks()

    def scored(self, batch: pa.RecordBatch, fold: Fold, held_out: int, sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers and labels of the rows that the fold holds out, and their shares of class 1."""
        x, y, place = arrays(batch, self.centre, self.scale)
        at = np.flatnonzero(place[:, fold.outer] == held_out)
        known = np.flatnonzero(trains(self.place, [fold])[:, 0])
        p = np.empty((len(at), len(sizes)))
        step = max(1, PAIRS // max(1, len(known)))
        scale = self.deviation[fold]
        for a in range(0, len(at), step):
            distance = manhattan(x[at[a : a + step], 1:] / scale, self.x[known] / scale)
            p[a : a + step] = votes(distance, self.y[known], sizes)
        return at, y[at], p


class Searched:
    """The table in leaves of near rows, each with the least and greatest number of every feature.

    Numbers are divided by the greatest scale of all folds, so no fold has a smaller distance. `k` neighbours serve all sizes.
    """

    def __init__(self, own: Neighbors, folds: Sequence[Fold], k: int) -> None:
        if not np.isfinite(own.x).all():
            raise ValueError("a feature is missing or not a finite number")
        self.x, self.y, self.place, self.key, self.folds, self.k = own.x, own.y, own.place, own.key, list(folds), k
        self.deviation = np.array([own.deviation[f] for f in folds])
        self.all = own.x / self.deviation.max(axis=0)
        asks = leaves(self.all, LEAF)
        self.asks, self.asked = np.concatenate(asks), np.cumsum([0, *map(len, asks)])
        # Equal rows beyond the first of them in every fold are no one's neighbours.
        rows = needed(own.x, own.place, folds, k)
        groups = leaves(self.all[rows], LEAF)
        self.rows, self.size = rows[np.concatenate(groups)], np.array([len(g) for g in groups])
        self.start = np.cumsum(self.size) - self.size
        x = self.all[self.rows]
        self.low, self.high = np.minimum.reduceat(x, self.start), np.maximum.reduceat(x, self.start)
        # The number of the fold that holds a row out, by outer fold and place; the place that each fold leaves out.
        self.left_out = np.array([OUTSIDE if f.inner is None else f.inner for f in folds])
        self.held_out = np.array([TESTED if f.inner is None else f.inner for f in folds])

    def holders(self, rows: np.ndarray) -> dict[int, np.ndarray]:
        """For each outer fold, the number of the fold that holds out each row, or -1."""
        out = {f.outer: np.full(len(rows), -1) for f in self.folds}
        for n, f in enumerate(self.folds):
            out[f.outer][self.place[rows, f.outer] == self.held_out[n]] = n
        return out

    def near(self, asks: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the `count` rows nearest to each of some near points, ascending, and the distance that no other row is below."""
        if count >= len(self.rows):
            return np.broadcast_to(np.sort(self.rows), (len(asks), len(self.rows))), np.full(len(asks), np.inf)
        gap = np.zeros((len(asks), len(self.size)))
        for j in range(asks.shape[1]):
            gap += np.maximum(np.maximum(self.low[:, j] - asks[:, j, None], asks[:, j, None] - self.high[:, j]), 0.0)
        order = gap.mean(axis=0).argsort(kind="stable")
        found, away = np.full((len(asks), count), -1), np.full((len(asks), count), np.inf)
        for some in np.split(order, range(LEAVES, len(order), LEAVES)):
            reached = gap[:, some] <= away.max(axis=1)[:, None] * (1 + SLACK)
            some, on = some[reached.any(axis=0)], np.flatnonzero(reached.any(axis=1))
            if not len(on):
                continue
            at = np.concatenate([self.rows[self.start[g] : self.start[g] + self.size[g]] for g in some])
            distance = np.concatenate([away[on], manhattan(asks[on], self.all[at])], axis=1)
            number = np.concatenate([found[on], np.broadcast_to(at, (len(on), len(at)))], axis=1)
            top = np.argpartition(distance, count - 1, axis=1)[:, :count]
            found[on], away[on] = np.take_along_axis(number, top, axis=1), np.take_along_axis(distance, top, axis=1)
        return np.sort(found, axis=1), away.max(axis=1)

    def scored(self, rows: np.ndarray, sizes: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(number of a fold, number of a row that it holds out, shares of class 1)."""
        wanted, count = self.holders(rows), min(2 * self.k + 6, len(self.rows))
        while True:
            left = np.flatnonzero(np.any([w >= 0 for w in wanted.values()], axis=0))
            if not len(left):
                return
            step = max(1, NEAR // max(1, count))
            for some in np.split(left, range(step, len(left), step)):
                near, beyond = self.near(self.all[rows[some]], count)
                for outer, holds in wanted.items():
                    own = np.flatnonzero(holds[some] >= 0)
                    fold, asks, at = holds[some[own]], rows[some[own]], near[own]
                    distance = np.zeros(at.shape)
                    for j in range(self.x.shape[1]):
                        scale = self.deviation[fold, j][:, None]
                        distance += np.abs(self.x[asks, j][:, None] / scale - self.x[at, j] / scale)
                    place = self.place[at, outer]
                    distance[(place < 0) | (place == self.left_out[fold][:, None])] = np.inf
                    sure = np.isinf(beyond[own])
                    if self.k <= count:
                        sure |= np.partition(distance, self.k - 1, axis=1)[:, self.k - 1] * (1 + SLACK) < beyond[own]
                    if sure.any():
                        yield fold[sure], asks[sure], votes(distance[sure], self.y[at[sure]], sizes)
                        holds[some[own[sure]]] = -1
            count = min(4 * count, len(self.rows))

    def each(self, spark: SparkSession, sizes: Sequence[int], columns: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
        """The columns that are made of the scores of all rows, a leaf at a time."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for leaf in batch.column("id").to_pylist():
                    for scores in self.scored(self.asks[self.asked[leaf] : self.asked[leaf + 1]], sizes):
                        yield columns(*scores)

        n = len(self.asked) - 1
        return spark.range(0, n, 1, max(1, min(n, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, schema)


def held_out_scores(table: Stack, folds: Sequence[Fold], sizes: Sequence[int], scaling: dict) -> DataFrame:
    """(outer, inner, cell, y, p): each row scored, for all numbers of neighbours, by the inner folds that hold it out."""
    own = Neighbors(table, folds, scaling)
    names, schema = ["outer", "inner", "cell", LABEL, "p"], f"outer int, inner int, cell int, {LABEL} int, p double"

    def columns(outer: np.ndarray, inner: np.ndarray, y: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
        each = [np.repeat(c.astype(np.int32), len(sizes)) for c in (outer, inner, y)]
        cell = np.tile(np.arange(len(sizes), dtype=np.int32), len(y))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (each[0], each[1], cell, each[2], p.reshape(-1))], names)

    if not fits(len(own.y), len(table.names)):
        search, outers, inners = Searched(own, folds, max(sizes)), np.array([f.outer for f in folds]), np.array([f.inner for f in folds])
        labels = own.y
        return search.each(table.rows.sparkSession, sizes, lambda fold, row, p: columns(outers[fold], inners[fold], labels[row], p), schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fold in folds:
                at, y, p = own.scored(batch, fold, fold.inner, sizes)
                if len(at):
                    yield columns(np.full(len(at), fold.outer), np.full(len(at), fold.inner), y, p)

    return table.rows.mapInArrow(run, schema)


def tested_scores(table: Stack, sizes: dict[int, int], scaling: dict) -> DataFrame:
    """(outer, row_id, y, p, yhat): the rows that each outer fold tests, with its number of neighbours."""
    folds = [Fold(o) for o in sizes]
    own = Neighbors(table, folds, scaling)
    key = table.rows.schema[KEY].dataType.simpleString()
    names, schema = ["outer", KEY, LABEL, "p", "yhat"], f"outer int, {KEY} {key}, {LABEL} int, p double, yhat int"

    def columns(outer: np.ndarray, keys: pa.Array, y: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(outer.astype(np.int32)), keys, pa.array(y.astype(np.int32)), pa.array(p), pa.array((p > 0.5).astype(np.int32))], names)

    if not fits(len(own.y), len(table.names)):
        different = sorted(set(sizes.values()))
        search, outers, own_size = Searched(own, folds, different[-1]), np.array(list(sizes)), np.array([different.index(k) for k in sizes.values()])
        labels, keys = own.y, own.key
        return search.each(
            table.rows.sparkSession, different,
            lambda fold, row, p: columns(outers[fold], keys.take(pa.array(row)), labels[row], p[np.arange(len(row)), own_size[fold]]), schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for outer, k in sizes.items():
                at, y, p = own.scored(batch, Fold(outer), TESTED, [k])
                if len(at):
                    yield columns(np.full(len(at), outer), batch.column(KEY).take(pa.array(at)), y, p[:, 0])

    return table.rows.mapInArrow(run, schema)
