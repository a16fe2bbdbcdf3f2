"""Logistic models of all outer folds, inner folds and grid cells, fitted together.

Rows are written once with their place in every outer fold: the inner fold that holds
them out, or TESTED, or OUTSIDE. A fit is a row of a parameter matrix with the fold
it trains on, its penalty and the features it may use. One pass over the rows gives
loss, gradient and curvature of all fits that have not converged: in a task these
are matrix products of an Arrow batch, and tasks send one row of sums per fit, which
Spark adds up. The driver takes a Newton step in each fit (with an L1 penalty, by
coordinate descent on the quadratic model), and halves a step that raised the loss. So
the whole nested grid takes about as many jobs as one fit, and what moves between jobs
is fits x features^2 numbers, whatever the rows.

Every fit is scaled by the moments of its own training rows. Scaling is an affine map of
the raw columns, so passes run on the raw columns and the driver maps the sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcurve.operators.folds import SEED, TEST, TRAIN, VALID
from foldcurve.operators.ranking import weakest
from foldcurve.operators.running import ordinal
from foldcurve.operators.symbolic import logistic
from foldcurve.plans.estimators import FEATURES, KEY, LABEL, ScoringModel
from foldcurve.session import cut_lineage, spread

#: Places that are no inner fold.
TESTED, OUTSIDE = -1, -2
#: Largest gradient at an optimum, as a share of the rows, and the most passes.
GRADIENT, PASSES = 1e-9, 100
#: Rows whose products are held at once in a task, times fits.
CELLS = 1 << 21


@dataclass(frozen=True)
class Fold:
    """The training rows of an outer fold (inner None), or those that one of its inner folds leaves."""

    outer: int
    inner: int | None = None


@dataclass(frozen=True)
class Problem:
    """Sum of the losses + |w|^2 / 2C, or + |w|_1 / C with `l1`, over the features in `support` (None: all)."""

    fold: Fold
    C: float = 1.0
    l1: bool = False
    support: tuple[int, ...] | None = None


@dataclass
class Solution:
    problem: Problem
    weights: np.ndarray
    intercept: float
    mean: np.ndarray
    deviation: np.ndarray
    #: Largest slope of the objective at the solution, over the rows.
    slope: float
    passes: int

    def raw(self) -> np.ndarray:
        """Intercept and weights for raw columns."""
        w = self.weights / self.deviation
        return np.concatenate([[self.intercept - w @ self.mean], w])


class LogisticModel(ScoringModel):
    """A solution as a model of vectors that are scaled already."""

    def __init__(self, solution: Solution) -> None:
        super().__init__()
        support = solution.problem.support
        kept = range(len(solution.weights)) if support is None else support
        self.coefficients = [float(solution.weights[i]) for i in kept]
        self.intercept, self.solution = solution.intercept, solution

    def score(self, df: DataFrame, p: str, yhat: str) -> DataFrame:
        x = vector_to_array(FEATURES)
        margin = sum((F.lit(w) * x[i] for i, w in enumerate(self.coefficients)), F.lit(self.intercept))
        return df.withColumns({p: logistic(margin), yhat: (margin > 0).cast("int")})


@dataclass
class Stack:
    """Rows (row_id, y, x, place) of all folds, with the centre and scale that keep sums small."""

    rows: DataFrame
    names: list[str]
    n_outer: int
    centre: np.ndarray
    scale: np.ndarray
    #: Where outer folds have features of their own: the places in x of each fold's `names`.
    views: list[np.ndarray] | None = None

    def places_of(self, outer: int) -> np.ndarray:
        return np.arange(len(self.names)) if self.views is None else self.views[outer]


def outer_rows(rows: DataFrame, n_outer: int | None, folds: DataFrame | None) -> DataFrame:
    """(outer, row_id, y, tested) of every row in every outer fold that it takes part in."""
    if folds is None:
        each = F.explode(F.sequence(F.lit(0), F.lit(n_outer - 1)))
        return rows.where("part is not null").select(each.alias("outer"), KEY, LABEL, "part").withColumn("tested", F.col("part") == F.col("outer")).drop("part")
    mine = folds.where(F.col("role").isin(TRAIN, VALID, TEST)).groupBy(F.col("fold_id").alias("outer"), KEY).agg(F.max(F.col("role") == TEST).alias("tested"))
    return mine.join(rows.select(KEY, LABEL), KEY).select("outer", KEY, LABEL, "tested")


def places(each: DataFrame, numbers: Sequence[int], n_inner: int, seed: int = SEED) -> DataFrame:
    """(row_id, place): for each outer fold in `numbers` the inner fold of a row, dealt as `stratified_folds` deals it."""
    train = each.where("not tested").withColumn("__deal", F.xxhash64(KEY, F.lit(seed)))
    placed = ordinal(train, ["outer", LABEL], "__deal", "__nth", ties=[KEY])
    counts = train.groupBy("outer", LABEL).agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.selectExpr(
        "outer as __outer", f"{LABEL} as __class", f"coalesce(sum(__n) over (partition by outer order by {LABEL} rows between unbounded preceding and 1 preceding), 0) as __start"
    )
    dealt = placed.join(starts, (F.col("outer") == F.col("__outer")) & F.col(LABEL).eqNullSafe(F.col("__class")))
    inner = dealt.select("outer", KEY, F.expr(f"int((__start + __nth - 1) % {max(n_inner, 1)})").alias("place"))
    tested = each.where("tested").select("outer", KEY, F.lit(TESTED).alias("place"))
    held = inner.unionByName(tested).groupBy(KEY).agg(F.map_from_entries(F.collect_list(F.struct("outer", "place"))).alias("held"))
    listed = F.array(*[F.coalesce(F.try_element_at("held", F.lit(i)), F.lit(OUTSIDE)) for i in numbers])
    return held.select(F.col(KEY).alias("__key"), listed.alias("place"))


def viewed(views: list[np.ndarray] | None, x: np.ndarray, outer: int) -> np.ndarray:
    """The leading 1 and the features of an outer fold."""
    return x if views is None else x[:, np.concatenate([[0], 1 + views[outer]])]


def by_view(views: list[np.ndarray] | None, outers: Sequence[int]) -> list[tuple[int, np.ndarray]]:
    """(outer fold, numbers of its items); one group where all folds have the same features."""
    if views is None:
        return [(0, np.arange(len(outers)))]
    return [(o, np.flatnonzero(np.array(outers) == o)) for o in dict.fromkeys(outers)]


def stack(
    rows: DataFrame, columns: Sequence[str], *, n_outer: int | None = None, folds: DataFrame | None = None, n_inner: int = 10, seed: int = SEED, alone: bool = True,
    views: list[np.ndarray] | None = None, names: Sequence[str] | None = None,
) -> tuple[Stack, list[int]]:
    """The table that all fits read, and the numbers of the outer folds that its places follow. `rows` are complete.

    A stack that is worked on `alone` lies in tasks for all cores. With `views`, each outer fold sees the `columns` at
    its places there, as `names`.
    """
    numbers = list(range(n_outer)) if folds is None else sorted(r.fold_id for r in folds.select("fold_id").distinct().collect())
    placed = places(outer_rows(rows, n_outer, folds), numbers, n_inner, seed)
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    held = cut_lineage(rows.join(placed, F.col(KEY) == F.col("__key")).select(KEY, F.col(LABEL).cast("double").alias(LABEL), x.alias("x"), "place"))
    held = spread(held, KEY) if alone else held
    size = range(len(columns))
    row = held.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in size], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in size]).first()
    centre = np.array([row[f"m{i}"] or 0.0 for i in size])
    scale = np.array([row[f"s{i}"] or 1.0 for i in size])
    return Stack(held, list(names or columns), len(numbers), centre, scale, views), numbers


def arrays(batch: pa.RecordBatch, centre: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns with a leading 1, labels and places of a batch."""
    n = batch.num_rows
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, len(centre))
    place = batch.column("place").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    return np.concatenate([np.ones((n, 1)), (x - centre) / scale], axis=1), batch.column(LABEL).to_numpy(zero_copy_only=False), place


def trains(place: np.ndarray, folds: Sequence[Fold]) -> np.ndarray:
    """Whether each row trains in each fold."""
    return np.stack([(place[:, f.outer] >= 0) & (place[:, f.outer] != (OUTSIDE if f.inner is None else f.inner)) for f in folds], axis=1)


def added(parts: DataFrame) -> dict[int, np.ndarray]:
    """(fit, sums) of all tasks, added up."""
    cells = parts.select("fit", F.posexplode("sums").alias("at", "x")).groupBy("fit", "at").agg(F.sum("x").alias("x"))
    table = cells.groupBy("fit").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda c: c["x"]).alias("sums"))
    return {r.fit: np.array(r.sums) for r in table.collect()}


def batch_of(sums: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(np.arange(0, sums.size + 1, max(1, sums.shape[1]), dtype=np.int32), pa.array(sums.reshape(-1)))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), lists], ["fit", "sums"])


def moments(table: Stack, folds: Sequence[Fold]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, means and population deviations (1 where there is none) of each fold, of the centred columns."""
    centre, scale, views, d = table.centre, table.scale, table.views, len(table.names)
    groups = by_view(views, [f.outer for f in folds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(folds), 1 + 2 * d))
        for batch in batches:
            x, _, place = arrays(batch, centre, scale)
            used = trains(place, folds).astype(float)
            for outer, own in groups:
                seen = viewed(views, x, outer)
                sums[own] += used[:, own].T @ np.concatenate([seen, seen[:, 1:] ** 2], axis=1)
        yield batch_of(sums)

    found = added(table.rows.mapInArrow(run, "fit int, sums array<double>"))
    sums = np.stack([found.get(i, np.zeros(1 + 2 * d)) for i in range(len(folds))])
    n = sums[:, :1]
    mean = sums[:, 1 : d + 1] / np.maximum(n, 1)
    spread = sums[:, d + 1 :] / np.maximum(n, 1) - mean**2
    return n[:, 0], mean, np.sqrt(np.where(spread > 1e-12, spread, 1.0))


def slopes(table: Stack, folds: Sequence[Fold], fold_of: np.ndarray, betas: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Loss, gradient and curvature of each fit, by its parameters for the centred columns."""
    centre, scale, views = table.centre, table.scale, table.views
    size = betas.shape[1]
    left, right = np.triu_indices(size)
    groups = by_view(views, [folds[k].outer for k in fold_of])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(betas), 1 + size + len(left)))
        step = max(1, CELLS // len(betas))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                x, y, place = arrays(batch.slice(at, step), centre, scale)
                trained = trains(place, folds)[:, fold_of]
                for outer, own in groups:
                    seen, used = viewed(views, x, outer), trained[:, own]
                    margin = seen @ betas[own].T
                    p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
                    loss = np.logaddexp(0, margin) - y[:, None] * margin
                    sums[own, 0] += np.where(used, loss, 0).sum(axis=0)
                    sums[own, 1 : size + 1] += np.where(used, p - y[:, None], 0).T @ seen
                    sums[own, size + 1 :] += np.where(used, p * (1 - p), 0).T @ (seen[:, left] * seen[:, right])
        yield batch_of(sums)

    found = added(table.rows.mapInArrow(run, "fit int, sums array<double>"))
    out = []
    for i in range(len(betas)):
        sums = found.get(i, np.zeros(1 + size + len(left)))
        curve = np.zeros((size, size))
        curve[left, right] = sums[size + 1 :]
        out.append((float(sums[0]), sums[1 : size + 1], curve + np.triu(curve, 1).T))
    return out


def sparse_step(beta: np.ndarray, gradient: np.ndarray, curve: np.ndarray, weight: float) -> np.ndarray:
    """The minimum of the quadratic model with an L1 penalty, coordinate by coordinate; the first coordinate is free."""
    new, slope = beta.copy(), gradient.copy()
    for _ in range(1000):
        largest = 0.0
        for j in range(len(beta)):
            bend = curve[j, j]
            if bend <= 1e-12:
                continue
            free = new[j] - slope[j] / bend
            moved = free if j == 0 else np.sign(free) * max(0.0, abs(free) - weight / bend)
            if moved != new[j]:
                change = moved - new[j]
                slope += curve[:, j] * change
                new[j] = moved
                largest = max(largest, abs(change))
        if largest < 1e-12:
            break
    return new


class _State:
    """One fit between passes, in its own scaling and support."""

    def __init__(self, problem: Problem, rows: float, mean: np.ndarray, deviation: np.ndarray) -> None:
        self.problem, self.rows, self.mean, self.deviation = problem, rows, mean, deviation
        d = len(mean)
        support = range(d) if problem.support is None else problem.support
        self.at = np.array([0, *[i + 1 for i in support]])
        # Row j of the map gives scaled column j from the centred columns.
        self.map = np.zeros((len(self.at), d + 1))
        self.map[0, 0] = 1
        for row, i in enumerate(support, 1):
            self.map[row, 0], self.map[row, i + 1] = -mean[i] / deviation[i], 1 / deviation[i]
        self.beta = np.zeros(len(self.at))
        self.best, self.loss, self.slope, self.passes, self.done = None, np.inf, np.inf, 0, rows == 0

    def seen(self, loss: float, gradient: np.ndarray, curve: np.ndarray) -> None:
        """Take the sums at `beta` and move it."""
        self.passes += 1
        w, C = self.beta[1:], self.problem.C
        total = loss + (np.abs(w).sum() / C if self.problem.l1 else w @ w / (2 * C))
        if total > self.loss + 1e-12 * abs(self.loss) and self.best is not None:
            if np.abs(self.beta - self.best).max() < 1e-13:
                self.beta, self.done = self.best, True
            else:
                self.beta = (self.beta + self.best) / 2
            return
        self.best, self.loss = self.beta.copy(), total
        g, h = self.map @ gradient, self.map @ curve @ self.map.T
        if self.problem.l1:
            away = np.where(w != 0, np.abs(g[1:] + np.sign(w) / C), np.maximum(0, np.abs(g[1:]) - 1 / C))
            self.slope = max(abs(g[0]), away.max(initial=0)) / self.rows
            new = sparse_step(self.beta, g, h, 1 / C)
        else:
            g[1:] += w / C
            h[np.arange(1, len(h)), np.arange(1, len(h))] += 1 / C
            self.slope = np.abs(g).max() / self.rows
            h[0, 0] += 1e-12
            new = self.beta - np.linalg.solve(h, g)
        if self.slope <= GRADIENT:
            self.done = True
        else:
            self.beta = new

    def solution(self, table: Stack) -> Solution:
        d = len(table.names)
        beta = self.beta if self.best is None else self.best
        own = table.places_of(self.problem.fold.outer)
        weights, mean, deviation = np.zeros(d), self.mean * table.scale[own] + table.centre[own], self.deviation * table.scale[own]
        weights[self.at[1:] - 1] = beta[1:]
        return Solution(self.problem, weights, float(beta[0]), mean, deviation, float(self.slope), self.passes)


def solve(table: Stack, problems: Sequence[Problem], scaling: dict | None = None) -> list[Solution]:
    """All problems, one pass over the rows for each common step. `scaling` keeps the moments of folds between calls."""
    scaling = {} if scaling is None else scaling
    new = [f for f in dict.fromkeys(p.fold for p in problems) if f not in scaling]
    if new:
        for f, n, mean, deviation in zip(new, *moments(table, new)):
            scaling[f] = (n, mean, deviation)
    states = [_State(p, *scaling[p.fold]) for p in problems]
    for _ in range(PASSES):
        open_states = [s for s in states if not s.done]
        if not open_states:
            break
        folds = list(dict.fromkeys(s.problem.fold for s in open_states))
        fold_of = np.array([folds.index(s.problem.fold) for s in open_states])
        betas = np.stack([s.map.T @ s.beta for s in open_states])
        for state, sums in zip(open_states, slopes(table, folds, fold_of, betas)):
            state.seen(*sums)
    return [s.solution(table) for s in states]


def eliminate_all(table: Stack, folds: Sequence[Fold], sizes: Sequence[int], C: float = 1.0, scaling: dict | None = None) -> dict[Fold, dict[int, tuple[int, ...]]]:
    """Recursive elimination in all folds at once: each step is one stacked L1 fit, after which every fold drops its weakest feature."""
    d, scaling = len(table.names), {} if scaling is None else scaling
    least = min(min(sizes), d)
    kept = {f: list(range(d)) for f in folds}
    out: dict[Fold, dict[int, tuple[int, ...]]] = {f: {} for f in folds}
    for left in range(d, least - 1, -1):
        for f in folds:
            out[f].update({s: tuple(kept[f]) for s in sizes if min(s, d) == left})
        if left > least:
            for solution in solve(table, [Problem(f, C, True, tuple(kept[f])) for f in folds], scaling):
                own = kept[solution.problem.fold]
                del own[weakest([solution.weights[i] for i in own])]
    return out


def held_out_scores(table: Stack, solutions: Sequence[Solution], cells: Sequence[int]) -> DataFrame:
    """(outer, inner, cell, y, p): each row scored by all fits whose inner fold holds it out."""
    by: dict[tuple[int, int], list[int]] = {}
    for i, s in enumerate(solutions):
        by.setdefault((s.problem.fold.outer, s.problem.fold.inner), []).append(i)
    raw, number = np.stack([s.raw() for s in solutions]), np.array(cells, np.int32)
    views, width = table.views, len(table.centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, place = arrays(batch, np.zeros(width), np.ones(width))
            for (outer, inner), own in by.items():
                at = np.flatnonzero(place[:, outer] == inner)
                if not len(at):
                    continue
                p = 1 / (1 + np.exp(-np.clip(viewed(views, x[at], outer) @ raw[own].T, -700, 700)))
                n = p.size
                columns = [np.full(n, outer, np.int32), np.full(n, inner, np.int32), np.tile(number[own], len(at)), np.repeat(y[at], len(own)).astype(np.int32), p.reshape(-1)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["outer", "inner", "cell", LABEL, "p"])

    return table.rows.mapInArrow(run, f"outer int, inner int, cell int, {LABEL} int, p double")


def tested_scores(table: Stack, solutions: Sequence[Solution]) -> DataFrame:
    """(outer, row_id, y, p, yhat): the rows that each outer fold tests, by its fit."""
    raw = {s.problem.fold.outer: s.raw() for s in solutions}
    views, width = table.views, len(table.centre)
    key = table.rows.schema[KEY].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, place = arrays(batch, np.zeros(width), np.ones(width))
            for outer, beta in raw.items():
                at = np.flatnonzero(place[:, outer] == TESTED)
                if len(at):
                    margin = viewed(views, x[at], outer) @ beta
                    p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
                    columns = [pa.array(np.full(len(at), outer, np.int32)), batch.column(KEY).take(pa.array(at)), pa.array(y[at].astype(np.int32)), pa.array(p), pa.array((margin > 0).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["outer", KEY, LABEL, "p", "yhat"])

    return table.rows.mapInArrow(run, f"outer int, {KEY} {key}, {LABEL} int, p double, yhat int")
