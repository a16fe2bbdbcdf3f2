"""Decision trees of all outer folds, inner folds and grid cells, grown together.

A tree of a smaller depth is the top of a deeper one, so one tree per fold, impurity
and feature set serves all depths of a grid. All trees grow by one level in one pass: a
task routes its rows down the trees so far and counts classes by (tree, node, feature,
bin); Spark adds the counts up, runs over the bins of a feature, and keeps the split of
greatest gain of every node, the first feature and bin on ties. The driver gets one row
per node. Counts are whole numbers, so a task that is run again changes nothing.

Bins are cut at approximate quantiles of a feature over the training rows of the outer
fold, one aggregation for all folds.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcurve.plans.estimators import FEATURES, KEY, LABEL, ScoringModel
from foldcurve.plans.stacked import TESTED, Fold, Stack, arrays, trains, viewed

BINS = 32
#: Nodes that are counted in one pass, and the least gain that splits one.
NODES, GAIN = 1 << 14, 1e-9
#: Features of folds whose quantiles one pass finds.
QUANTILES = 128
IMPURITIES = ("gini", "entropy")


@dataclass(frozen=True)
class Kind:
    """What sets one tree apart: its training rows, impurity, and features (None: all)."""

    fold: Fold
    impurity: str = "gini"
    support: tuple[int, ...] | None = None


@dataclass
class Tree:
    """Nodes in the order in which they were made; node 0 is the root. A leaf has feature -1."""

    kind: Kind
    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    counts: list[tuple[int, int]] = field(default_factory=lambda: [(0, 0)])

    def split(self, node: int, feature: int, at: int, threshold: float, left: tuple[int, int], right: tuple[int, int]) -> list[int]:
        """Turn a leaf into a split; the numbers of its children."""
        self.feature[node], self.bin[node], self.threshold[node] = feature, at, threshold
        made = []
        for counts in (left, right):
            made.append(len(self.feature))
            for column, value in ((self.feature, -1), (self.bin, 0), (self.threshold, 0.0), (self.left, 0), (self.right, 0), (self.depth, self.depth[node] + 1), (self.counts, counts)):
                column.append(value)
        self.left[node], self.right[node] = made
        return made

    def table(self) -> tuple[np.ndarray, ...]:
        """feature, bin, threshold, left, right, share of class 1."""
        counts = np.array(self.counts, float)
        share = np.divide(counts[:, 1], counts.sum(axis=1), out=np.zeros(len(counts)), where=counts.sum(axis=1) > 0)
        return np.array(self.feature), np.array(self.bin), np.array(self.threshold), np.array(self.left), np.array(self.right), share

    def cut(self, depth: int) -> "Tree":
        """The top of the tree; deeper nodes go, and so do the numbers they had."""
        kept = [i for i, at in enumerate(self.depth) if at <= depth]
        number = {old: new for new, old in enumerate(kept)}
        inner = [self.feature[i] >= 0 and self.depth[i] < depth for i in kept]
        return Tree(
            self.kind,
            [self.feature[i] if s else -1 for i, s in zip(kept, inner)],
            [self.bin[i] if s else 0 for i, s in zip(kept, inner)],
            [self.threshold[i] if s else 0.0 for i, s in zip(kept, inner)],
            [number[self.left[i]] if s else 0 for i, s in zip(kept, inner)],
            [number[self.right[i]] if s else 0 for i, s in zip(kept, inner)],
            [self.depth[i] for i in kept],
            [self.counts[i] for i in kept],
        )

    def rows(self) -> list[tuple[int, int | None, int | None, int | None, float | None]]:
        """(node, left, right, feature, threshold) in preorder, as the reports number nodes."""
        order, waiting = [], [0]
        while waiting:
            node = waiting.pop()
            order.append(node)
            if self.feature[node] >= 0:
                waiting += [self.right[node], self.left[node]]
        number = {node: i for i, node in enumerate(order)}
        return [
            (number[n], number[self.left[n]], number[self.right[n]], self.feature[n], self.threshold[n]) if self.feature[n] >= 0 else (number[n], None, None, None, None)
            for n in order
        ]


class TreeModel(ScoringModel):
    """A tree as a model of vectors of the raw columns: trees need no scaling."""

    def __init__(self, tree: Tree, names: Sequence[str]) -> None:
        super().__init__()
        self.tree, self.names = tree, list(names)

    def score(self, df: DataFrame, p: str, yhat: str) -> DataFrame:
        tree, x = self.tree, vector_to_array(FEATURES)
        feature, _, threshold, left, right, share = tree.table()

        def at(node: int):
            if feature[node] < 0:
                return F.lit(float(share[node]))
            return F.when(x[int(feature[node])] <= float(threshold[node]), at(int(left[node]))).otherwise(at(int(right[node])))

        return df.withColumn(p, at(0)).withColumn(yhat, (F.col(p) > 0.5).cast("int"))


def cut_points(table: Stack) -> list[list[np.ndarray]]:
    """Ascending thresholds of each feature, by outer fold, over its training rows."""
    shares = [i / BINS for i in range(1, BINS)]
    aggregates = [
        F.percentile_approx(F.when(F.col("place")[o] >= 0, F.col("x")[int(at)]), shares, 10_000).alias(f"q{o}_{f}")
        for o in range(table.n_outer)
        for f, at in enumerate(table.places_of(o))
    ]
    # Folds with features of their own ask for many more quantiles, and each keeps a sample of its values.
    row = {}
    for start in range(0, len(aggregates), QUANTILES):
        row |= table.rows.agg(*aggregates[start : start + QUANTILES]).first().asDict()
    return [[np.unique(np.array(row[f"q{o}_{f}"] or [], float)) for f in range(len(table.names))] for o in range(table.n_outer)]


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """The number of thresholds below each value: value <= threshold b exactly if its bin is at most b."""
    return np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)


def routed(tables: tuple[np.ndarray, ...], bins: np.ndarray, steps: int) -> Iterator[np.ndarray]:
    """Nodes of the rows after 0, 1, ... `steps` steps down a tree."""
    feature, at, _, left, right, _ = tables
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    yield node
    for _ in range(steps):
        f = feature[node]
        down = np.where(bins[rows, np.maximum(f, 0)] <= at[node], left[node], right[node])
        node = np.where(f >= 0, down, node)
        yield node


def counted(table: Stack, trees: Sequence[Tree], open_nodes: Mapping[int, Sequence[int]], cuts) -> DataFrame:
    """(tree, node, feature, bin, n0, n1) of the open nodes."""
    zero, one, d, views = np.zeros(len(table.centre)), np.ones(len(table.centre)), len(table.names), table.views
    folds = [trees[t].kind.fold for t in open_nodes]
    tables = {t: trees[t].table() for t in open_nodes}
    steps = max(trees[t].depth[n] for t, own in open_nodes.items() for n in own)
    slots = {t: np.full(len(trees[t].feature), -1) for t in open_nodes}
    for t, own in open_nodes.items():
        slots[t][list(own)] = np.arange(len(own))
    supports = {t: np.arange(d) if trees[t].kind.support is None else np.array(trees[t].kind.support) for t in open_nodes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {t: np.zeros(len(own) * len(supports[t]) * BINS * 2, np.int64) for t, own in open_nodes.items()}
        for batch in batches:
            x, y, place = arrays(batch, zero, one)
            used = trains(place, folds)
            bins = {o: binned(viewed(views, x, o)[:, 1:], cuts[o]) for o in {f.outer for f in folds}}
            for k, t in enumerate(open_nodes):
                at = np.flatnonzero(used[:, k])
                own = bins[folds[k].outer][at]
                for node in routed(tables[t], own, steps):
                    pass
                slot = slots[t][node]
                at, own, slot = at[slot >= 0], own[slot >= 0], slot[slot >= 0]
                cell = (slot[:, None] * len(supports[t]) + np.arange(len(supports[t]))) * BINS + own[:, supports[t]]
                sums[t] += np.bincount((2 * cell + y[at].astype(np.int64)[:, None]).reshape(-1), minlength=len(sums[t]))
        for t, own in open_nodes.items():
            both = sums[t].reshape(-1, 2)
            cell = np.flatnonzero(both.any(axis=1))
            place_of, bin_of = np.divmod(cell, BINS)
            slot, f = np.divmod(place_of, len(supports[t]))
            columns = [np.full(len(cell), t, np.int32), np.array(own, np.int32)[slot], supports[t][f].astype(np.int32), bin_of.astype(np.int32), both[cell, 0], both[cell, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["tree", "node", "feature", "bin", "n0", "n1"])

    return table.rows.mapInArrow(run, "tree int, node int, feature int, bin int, n0 long, n1 long")


def impurity(kind: str, a: str, b: str) -> str:
    """SQL of rows x impurity of a node with counts `a` and `b`."""
    n = f"({a} + {b})"
    if kind == "gini":
        return f"({n} - ({a} * {a} + {b} * {b}) / double({n}))"
    return f"-(if({a} > 0, {a} * log2({a} / double({n})), 0d) + if({b} > 0, {b} * log2({b} / double({n})), 0d))"


def best_splits(counts: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(tree, node, n0, n1, best) with best = (gain per row, feature, bin, l0, l1), null where no split gains."""
    cells = counts.groupBy("tree", "node", "feature", "bin").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    group = "partition by tree, node, feature"
    run = f"over ({group} order by bin rows between unbounded preceding and current row)"
    sides = cells.selectExpr("tree", "node", "feature", "bin", f"sum(n0) {run} as l0", f"sum(n1) {run} as l1", f"sum(n0) over ({group}) as n0", f"sum(n1) over ({group}) as n1")
    which = F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("tree") + 1)
    gains = [
        f"({impurity(k, 'n0', 'n1')} - {impurity(k, 'l0', 'l1')} - if(l0 + l1 < n0 + n1, {impurity(k, '(n0 - l0)', '(n1 - l1)')}, 0d)) / (n0 + n1)" for k in IMPURITIES
    ]
    scored = sides.withColumn("gain", F.when(which == IMPURITIES[0], F.expr(gains[0])).otherwise(F.expr(gains[1])))
    # Negated, so that the greatest struct is the first feature and bin. Gains are rounded so that ties are ties.
    best = F.max(F.when((F.col("l0") + F.col("l1") < F.col("n0") + F.col("n1")) & (F.col("gain") > GAIN), F.struct(F.round("gain", 12).alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("bin")).alias("bin"), "l0", "l1")))
    return scored.groupBy("tree", "node").agg(F.max("n0").alias("n0"), F.max("n1").alias("n1"), best.alias("best"))


def grow(table: Stack, kinds: Sequence[Kind], depth: int, cuts=None) -> list[Tree]:
    """A tree for each kind, to `depth` at most."""
    cuts = cut_points(table) if cuts is None else cuts
    trees = [Tree(k) for k in kinds]
    waiting = [(t, 0) for t in range(len(trees))]
    while waiting:
        now, waiting = waiting[:NODES], waiting[NODES:]
        open_nodes: dict[int, list[int]] = {}
        for t, node in now:
            open_nodes.setdefault(t, []).append(node)
        for r in best_splits(counted(table, trees, open_nodes, cuts), [k.impurity for k in kinds]).collect():
            tree = trees[r.tree]
            tree.counts[r.node] = (r.n0, r.n1)
            if r.best is None or tree.depth[r.node] >= depth:
                continue
            f, b, l0, l1 = -r.best.feature, -r.best.bin, r.best.l0, r.best.l1
            left, right = (l0, l1), (r.n0 - l0, r.n1 - l1)
            made = tree.split(r.node, f, b, float(cuts[tree.kind.fold.outer][f][b]), left, right)
            if tree.depth[made[0]] < depth:
                waiting += [(r.tree, n) for n, side in zip(made, (left, right)) if min(side)]
    return trees


def leaf_matches(table: Stack, trees: Sequence[Tree]) -> DataFrame:
    """(tree, leaf, n, same) of the leaves that training rows reach by the thresholds, and whether the counts are those of the tree.

    One pass routes the rows down all trees.
    """
    zero, one, views = np.zeros(len(table.centre)), np.ones(len(table.centre)), table.views
    tables, folds, counts = [t.table() for t in trees], [t.kind.fold for t in trees], [np.array(t.counts, np.int64) for t in trees]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(c), 2), np.int64) for c in counts]
        for batch in batches:
            x, y, place = arrays(batch, zero, one)
            used = trains(place, folds)
            for t, (feature, _, threshold, left, right, _) in enumerate(tables):
                at, seen = np.flatnonzero(used[:, t]), viewed(views, x, folds[t].outer)
                node = np.zeros(len(at), np.int64)
                while (inner := np.flatnonzero(feature[node] >= 0)).size:
                    from_node = node[inner]
                    down = seen[at[inner], 1 + feature[from_node]] <= threshold[from_node]
                    node[inner] = np.where(down, left[from_node], right[from_node])
                sums[t] += np.bincount(2 * node + y[at].astype(np.int64), minlength=sums[t].size).reshape(-1, 2)
        for t, own in enumerate(sums):
            leaf = np.flatnonzero(own.any(axis=1))
            columns = [np.full(len(leaf), t, np.int32), leaf.astype(np.int32), own[leaf, 0], own[leaf, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["tree", "leaf", "n0", "n1"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree, leaf, n0, n1 = (batch.column(c).to_numpy() for c in ("tree", "leaf", "n0", "n1"))
            same = [bool((counts[t][node] == (a, b)).all()) for t, node, a, b in zip(tree, leaf, n0, n1)]
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("leaf"), pa.array(n0 + n1), pa.array(same, pa.bool_())], ["tree", "leaf", "n", "same"])

    summed = table.rows.mapInArrow(run, "tree int, leaf int, n0 long, n1 long").groupBy("tree", "leaf").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return summed.mapInArrow(compare, "tree int, leaf int, n long, same boolean")


def held_out_scores(table: Stack, trees: Sequence[Tree], cells: Sequence[Sequence[tuple[int, int]]], cuts) -> DataFrame:
    """(outer, inner, cell, y, p, n): how many rows of a label have a score from the trees whose inner fold holds them out.

    A tree has few scores, so a task counts rows by node and not a row of a fold for each cell. `cells`: (depth, cell) of each tree.
    """
    zero, one, views = np.zeros(len(table.centre)), np.ones(len(table.centre)), table.views
    tables, folds = [t.table() for t in trees], [t.kind.fold for t in trees]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x, y, place = arrays(batch, zero, one)
            if not np.isin(y, (0, 1)).all():
                raise ValueError("a label is neither 0 nor 1")
            bins = {o: binned(viewed(views, x, o)[:, 1:], cuts[o]) for o in {f.outer for f in folds}}
            for k, (t, fold, own) in enumerate(zip(tables, folds, cells)):
                at = np.flatnonzero(place[:, fold.outer] == fold.inner)
                if not len(at):
                    continue
                wanted = dict(own)
                for step, node in enumerate(routed(t, bins[fold.outer][at], max(wanted))):
                    if step in wanted:
                        if (k, step) not in counts:
                            counts[k, step] = np.zeros(2 * len(t[0]), np.int64)
                        counts[k, step] += np.bincount(2 * node + y[at].astype(np.int64), minlength=2 * len(t[0]))
        for (k, step), found in counts.items():
            code = np.flatnonzero(found)
            fold, m = folds[k], len(code)
            columns = [np.full(m, fold.outer, np.int32), np.full(m, fold.inner, np.int32), np.full(m, dict(cells[k])[step], np.int32), (code % 2).astype(np.int32), tables[k][5][code // 2], found[code]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["outer", "inner", "cell", LABEL, "p", "n"])

    return table.rows.mapInArrow(run, f"outer int, inner int, cell int, {LABEL} int, p double, n long")


def tested_scores(table: Stack, trees: Mapping[int, Tree], cuts) -> DataFrame:
    """(outer, row_id, y, p, yhat): the rows that each outer fold tests, by its tree."""
    zero, one, views = np.zeros(len(table.centre)), np.ones(len(table.centre)), table.views
    tables = {o: (t.table(), max(t.depth)) for o, t in trees.items()}
    key = table.rows.schema[KEY].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, place = arrays(batch, zero, one)
            for outer, (t, steps) in tables.items():
                at = np.flatnonzero(place[:, outer] == TESTED)
                if len(at):
                    for node in routed(t, binned(viewed(views, x[at], outer)[:, 1:], cuts[outer]), steps):
                        pass
                    p = t[5][node]
                    columns = [pa.array(np.full(len(at), outer, np.int32)), batch.column(KEY).take(pa.array(at)), pa.array(y[at].astype(np.int32)), pa.array(p), pa.array((p > 0.5).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["outer", KEY, LABEL, "p", "yhat"])

    return table.rows.mapInArrow(run, f"outer int, {KEY} {key}, {LABEL} int, p double, yhat int")
