"""Many expressions as one graph in which every different subtree is one node.

Expressions that are bred from each other share most of their subtrees. A forest gives
each different subtree a number, so that equal trees have equal numbers (over all
generations too) and a row's value of a shared subtree is computed once. Values are
arrays over an Arrow batch; nothing is compiled, whatever the size of the forest.

Areas of many expressions need every value in its order, but no row for each value: a task
sends, for each expression and class, its sorted values as one packed list, cut into
ranges of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcurve.functions.scalars import FUNCTIONS, Named
from foldcurve.operators.symbolic import Expression

#: Values that a task holds at once: rows of a batch times nodes.
VALUES = 1 << 22
#: Rows whose values are sorted and packed at once, rows of one range of an expression's values, and rows that place the ranges.
PACKED_ROWS, RANGE_ROWS, PLACING = 1 << 16, 1 << 20, 1 << 12
CODEC = "zstd"
COLUMN, NUMBER = "column", "number"


class Forest:
    """Different subtrees in an order in which operands come first. Each is (column, i), (number, x) or (function, operand, ...)."""

    def __init__(self, names: Sequence[str]) -> None:
        self.names = {c: i for i, c in enumerate(names)}
        self.nodes: list[tuple] = []
        self.number: dict[tuple, int] = {}

    def add(self, tree: Expression) -> int:
        """The number of `tree`, new or known. ValueError for unknown names."""
        if isinstance(tree, tuple):
            if tree[0] not in FUNCTIONS:
                raise ValueError(f"no function {tree[0]}")
            node = (tree[0], *[self.add(o) for o in tree[1:]])
            if len(node) - 1 != FUNCTIONS[tree[0]].operands:
                raise ValueError(f"{tree[0]} takes {FUNCTIONS[tree[0]].operands} operands, not {len(node) - 1}")
        elif isinstance(tree, str):
            if tree not in self.names:
                raise ValueError(f"no column {tree} in this table")
            node = (COLUMN, self.names[tree])
        else:
            node = (NUMBER, float(tree))
        found = self.number.get(node)
        if found is None:
            found = self.number[node] = len(self.nodes)
            self.nodes.append(node)
        return found

    def needed(self, roots: Iterable[int]) -> "Plan":
        """The part of the forest that the roots stand on, to be sent to tasks."""
        wanted, waiting = set(), list(roots)
        while waiting:
            n = waiting.pop()
            if n not in wanted:
                wanted.add(n)
                node = self.nodes[n]
                if node[0] not in (COLUMN, NUMBER):
                    waiting += node[1:]
        functions = {self.nodes[n][0]: FUNCTIONS[self.nodes[n][0]] for n in wanted if self.nodes[n][0] not in (COLUMN, NUMBER)}
        return Plan({n: self.nodes[n] for n in sorted(wanted)}, functions)


@dataclass(frozen=True)
class Plan:
    nodes: Mapping[int, tuple]
    functions: Mapping[str, Named]

    def values(self, x: np.ndarray, roots: Sequence[int]) -> np.ndarray:
        """A column for each root, a row for each row of x."""
        out = np.empty((len(x), len(roots)))
        if not roots:
            return out
        step = max(1, VALUES // len(self.nodes))
        with np.errstate(all="ignore"):
            for at in range(0, len(x), step):
                rows = x[at : at + step]
                held: dict[int, np.ndarray | float] = {}
                for n, (kind, *operands) in self.nodes.items():
                    if kind == COLUMN:
                        held[n] = rows[:, operands[0]]
                    elif kind == NUMBER:
                        held[n] = np.full(len(rows), operands[0])
                    else:
                        held[n] = self.functions[kind].of_numbers(*[held[o] for o in operands])
                for c, r in enumerate(roots):
                    out[at : at + step, c] = held[r]
        return out


def takes(names: Iterable[str]) -> bool:
    """Whether all these functions work on arrays."""
    return all(FUNCTIONS[n].numbers is not None for n in names)


Rows = Callable[[pa.RecordBatch, object], tuple[np.ndarray, np.ndarray] | None]


def scores(df: DataFrame, plans: Mapping[object, tuple[Plan, Sequence[int]]], rows_of: Rows, keys: Callable[[object], Sequence[int]], names: Sequence[str], label: str) -> DataFrame:
    """(names, candidate, label, p): value of every root of every group on the rows that `rows_of` gives for the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, (plan, roots) in plans.items():
                x, y = rows_of(batch, group)
                if not len(x):
                    continue
                p = plan.values(x, roots)
                own = [np.full(p.size, k, np.int32) for k in keys(group)]
                columns = [*own, np.tile(np.array(roots, np.int32), len(x)), np.repeat(y.astype(np.int32), len(roots)), p.reshape(-1)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*names, "candidate", label, "p"])

    return df.mapInArrow(run, "".join(f"{n} int, " for n in names) + f"candidate int, {label} int, p double")


def ordered(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values: equal values (0.0 and -0.0, all NaN) have equal ones, NaN comes last."""
    bits = (values + 0.0).view(np.int64)
    whole = np.where(bits < 0, ~bits, bits | np.int64(-1 << 63)).view(np.uint64)
    return np.where(np.isnan(values), np.uint64(2**64 - 1), whole)


def packed(sorted_values: np.ndarray) -> tuple[int, bytes]:
    """The number of different values, and these with their counts: steps between them, byte by byte, compressed."""
    first = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.empty(0, np.int64)
    values = sorted_values[first]
    steps = np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    counts = np.diff(first, append=len(sorted_values)).astype(np.uint32).view(np.uint8).reshape(-1, 4)
    return len(values), pa.compress(steps.T.tobytes() + counts.T.tobytes(), codec=CODEC, asbytes=True)


def unpacked(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The different values and their counts."""
    raw = np.frombuffer(pa.decompress(data, decompressed_size=12 * n, codec=CODEC, asbytes=True), np.uint8)
    steps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.uint64).reshape(-1)
    return np.cumsum(steps, dtype=np.uint64), np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view(np.uint32).reshape(-1).astype(np.int64)


def merged(parts: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Values of all parts in order, with their counts. Equal values may stay apart."""
    values, counts = np.concatenate([v for v, _ in parts]), np.concatenate([c for _, c in parts])
    if (counts == 1).all():
        return np.sort(values), counts
    order = np.argsort(values, kind="stable")
    return values[order], counts[order]


def won(above: tuple[np.ndarray, np.ndarray], below: tuple[np.ndarray, np.ndarray]) -> int:
    """Twice the pairs in which a value of `above` is greater, plus the pairs of equal values."""
    through = np.concatenate([[0], np.cumsum(below[1])])
    pairs = through[np.searchsorted(below[0], above[0], "left")] + through[np.searchsorted(below[0], above[0], "right")]
    # Counts of one range: their products are far below 2**63, but for values that very many rows share.
    return int(pairs @ above[1]) if int(above[1].sum()) * int(through[-1]) < 1 << 61 else sum(int(a) * int(b) for a, b in zip(pairs, above[1]))


def value_lists(df: DataFrame, plans: Mapping[object, tuple[Plan, Sequence[int]]], rows_of: Rows, names: Sequence[str], keys: Callable[[object], Sequence[int]], label: str, cuts: Mapping[object, np.ndarray]) -> DataFrame:
    """(names, candidate, range, positive, n, list): the values of every root on many rows at once, sorted and packed by class.

    `cuts` holds for each group the ascending inner limits of the ranges of every root, a row for each root.
    """

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACKED_ROWS:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in together(batches):
            for group, (plan, roots) in plans.items():
                x, y = rows_of(batch, group)
                y = y.astype(np.int32)
                if len(wrong := y[(y != 0) & (y != 1)]):
                    raise ValueError(f"a label is neither 0 nor 1: {wrong[0]}")
                if not len(x):
                    continue
                p = plan.values(x, roots)
                for start in range(0, len(roots), 16):  # a few lists leave at a time
                    out = []
                    for c, root in enumerate(roots[start : start + 16], start):
                        value, limits = ordered(np.ascontiguousarray(p[:, c])), cuts[group][c]
                        for positive in (0, 1):
                            own = np.sort(value[y == positive])
                            ends = [0, *np.searchsorted(own, limits, "right").tolist(), len(own)]
                            for piece, (a, b) in enumerate(zip(ends, ends[1:])):
                                if b > a:
                                    out.append((root, piece, positive, *packed(own[a:b])))
                    own_keys = [np.full(len(out), k, np.int32) for k in keys(group)]
                    columns = [*own_keys, *(np.array([o[i] for o in out], np.int32) for i in range(4))]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array([o[4] for o in out], pa.binary())], [*names, "candidate", "range", "positive", "n", "list"])

    return df.mapInArrow(run, "".join(f"{n} int, " for n in names) + "candidate int, range int, positive int, n int, list binary")


def areas(df: DataFrame, plans: Mapping[object, tuple[Plan, Sequence[int]]], rows_of: Rows, keys: Callable[[object], Sequence[int]], names: Sequence[str], label: str, range_rows: int = RANGE_ROWS) -> dict[tuple, float | None]:
    """{(names..., candidate): area under the curve} of every root of every group; None where only one class is present.

    Ranges of a root's values are placed by a few rows and hold about `range_rows` of them, so no task holds a root's values
    whole; where they are cut changes no result. The driver gets one row for each root and range.
    """
    n_ranges = -(-df.count() // range_rows)
    cuts = {g: np.empty((len(roots), 0), np.uint64) for g, (_, roots) in plans.items()}
    if n_ranges > 1:
        hashed = F.xxhash64(*df.columns)
        placing = pa.Table.from_batches(df.orderBy(hashed).limit(PLACING).toArrow().to_batches()).combine_chunks().to_batches()[0]
        for g, (plan, roots) in plans.items():
            x, _ = rows_of(placing, g)
            if len(x):
                value = np.sort(ordered(plan.values(x, roots)), axis=0)
                cuts[g] = np.ascontiguousarray(value[np.arange(1, n_ranges) * len(value) // n_ranges].T)
    whole = [*names, "candidate", "range"]

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        sides = [[], []]
        for positive, n, data in zip(*(rows.column(c).to_pylist() for c in ("positive", "n", "list"))):
            sides[positive].append(unpacked(n, data))
        none = (np.empty(0, np.uint64), np.empty(0, np.int64))
        neg, pos = (merged(s) if s else none for s in sides)
        found = [[k.as_py()] for k in key] + [[int(pos[1].sum())], [int(neg[1].sum())], [str(won(pos, neg))]]
        return pa.Table.from_arrays([*(pa.array(k, pa.int32()) for k in found[: len(key)]), pa.array(found[-3], pa.int64()), pa.array(found[-2], pa.int64()), pa.array(found[-1])], [*whole, "pos", "neg", "won"])

    lists = value_lists(df, plans, rows_of, names, keys, label, cuts)
    counted = lists.groupBy(*whole).applyInArrow(count, "".join(f"{n} int, " for n in whole) + "pos long, neg long, won string")
    sums: dict[tuple, list[int]] = {}
    for r in sorted(counted.collect(), key=lambda r: r["range"]):
        # Rows of smaller ranges are all below.
        total = sums.setdefault(tuple(r[c] for c in whole[:-1]), [0, 0, 0])
        total[2] += int(r["won"]) + 2 * r["pos"] * total[1]
        total[0] += r["pos"]
        total[1] += r["neg"]
    return {k: won / (2 * pos * neg) if pos and neg else None for k, (pos, neg, won) in sums.items()}
