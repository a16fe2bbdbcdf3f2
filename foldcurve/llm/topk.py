"""Exact top-k search by inner product with dual-tree traversal of cover trees.

Vectors are dealt to the nearest of a bounded number of centres, which are fitted on a
bounded sample and only decide who is neighbour to whom; every vector is indexed. A
centre's vectors are cut into blocks of bounded size, and so are the queries. Blocks
of data are dealt to slots, blocks of queries go to every slot, so each block of queries
meets each block of data once: the query set is stated by the caller, and no task gets
more than its slots hold. There both get a cover tree, and the two
trees are descended together: a pair of nodes is dropped when

    <q, x> <= <cq, cx> + rq |cx| + rx |cq| + rq rx

(c: centre, r: covering radius) is below the worst k-th score that the queries of the
node hold so far. A bound that equals it stays, since ties go to smaller ids. Scores
are computed in whole numbers. The best k of each block are merged per query.

Null vectors and vectors with a null or non-finite component take no part. Vectors are
compared with those of their own length only. Rows that share an id are one candidate
with its best score, and one query likewise; a query is never its own candidate. Fewer
than k candidates give fewer rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldcurve.llm.common import partitions, written

#: Rows of a block of data, of a block of queries, and of a tree's leaf.
DATA_BLOCK = 8192
QUERY_BLOCK = 1024
LEAF = 256
#: Vectors in the sample that centres are fitted on, and centres at most.
SAMPLE = 4096
CENTRES = 16
SLACK = 1e-9


def scaled(vectors: DataFrame, column: str = "embedding", factor: int = 256) -> DataFrame:
    """vec_id and v, the floors of the scaled components as longs; unfit rows left out, equal rows merged."""
    x = F.col(column)
    fit = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.transform(x, lambda c: F.floor(F.lit(factor) * c.cast("double")).cast("long"))
    return vectors.where(F.coalesce(fit, F.lit(False)) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).distinct()


class Node:
    """A ball of points: rows start..stop of the tree's order."""

    __slots__ = ("start", "stop", "centre", "radius", "length", "children")

    def __init__(self, points: np.ndarray, start: int, stop: int):
        part = points[start:stop]
        self.start, self.stop, self.children = start, stop, ()
        self.centre = part.mean(axis=0)
        self.radius = float(np.sqrt(((part - self.centre) ** 2).sum(axis=1).max()))
        self.length = float(np.linalg.norm(self.centre))


def cover_tree(points: np.ndarray, leaf: int) -> tuple[Node, np.ndarray]:
    """Root and the order of rows. A node's children cover its points with balls of about half its radius."""
    order = np.arange(len(points))

    def build(start: int, stop: int) -> Node:
        node = Node(points[order[start:stop]], 0, stop - start)
        node.start, node.stop = start, stop
        if stop - start <= leaf or node.radius == 0:
            return node
        own = order[start:stop]
        part = points[own]
        # Far points as centres until all are covered at half the radius, eight at most in one step.
        nearest = np.full(len(part), np.inf)
        owner = np.zeros(len(part), int)
        pick = int(((part - node.centre) ** 2).sum(axis=1).argmax())
        for c in range(8):
            away = ((part - part[pick]) ** 2).sum(axis=1)
            closer = away < nearest
            nearest[closer], owner[closer] = away[closer], c
            pick = int(nearest.argmax())
            if nearest[pick] <= (node.radius / 2) ** 2:
                break
        by = np.argsort(owner, kind="stable")
        order[start:stop] = own[by]
        sizes = np.bincount(owner)
        ends = start + np.cumsum(sizes)
        if len(ends) > 1:
            node.children = tuple(build(int(e - s), int(e)) for s, e in zip(sizes, ends) if s)
        return node

    return build(0, len(points)), order


def block_top(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, id, score) of the best k of x for each query, by dual-tree search."""
    n_q = len(q_ids)
    # Whole numbers stay exact in doubles below 2^53.
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1]) < 2**53
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    q_root, q_order = cover_tree(qf, LEAF)
    x_root, x_order = cover_tree(xf, LEAF)
    qf, xf, q, x = qf[q_order], xf[x_order], q[q_order], x[x_order]
    q_ids, x_ids = q_ids[q_order], x_ids[x_order]
    best_s = np.full((n_q, k), -(2**62), np.int64)
    best_i = np.full((n_q, k), 2**62, np.int64)
    held = np.zeros(n_q, int)

    def bound(a: Node, b: Node) -> float:
        top = float(a.centre @ b.centre) + a.radius * b.length + b.radius * a.length + a.radius * b.radius
        return top + SLACK * (1 + abs(top))

    def worst(a: Node) -> float:
        return float(best_s[a.start : a.stop, -1].min())

    def leaf(a: Node, b: Node) -> None:
        rows, cols = slice(a.start, a.stop), slice(b.start, b.stop)
        if exact:
            scores = np.rint(qf[rows] @ xf[cols].T).astype(np.int64)
        else:
            scores = q[rows] @ x[cols].T
        for r in range(a.start, a.stop):
            s = scores[r - a.start]
            good = np.flatnonzero(s >= best_s[r, -1])
            good = good[x_ids[b.start + good] != q_ids[r]]
            if not len(good):
                continue
            if len(good) > 4 * k:  # only the best scores matter; all that tie with the last stay
                cut = np.partition(s[good], len(good) - k)[len(good) - k]
                # An id may stand in several rows, so a cut must leave k different ones.
                fewer = good[s[good] >= cut]
                if len(np.unique(x_ids[b.start + fewer])) >= k:
                    good = fewer
            ids = np.concatenate([best_i[r, : held[r]], x_ids[b.start + good]])
            all_s = np.concatenate([best_s[r, : held[r]], s[good]])
            by = np.lexsort((ids, -all_s))
            ids, all_s = ids[by], all_s[by]
            _, first = np.unique(ids, return_index=True)
            first = np.sort(first)[:k]
            held[r] = len(first)
            best_i[r, : held[r]], best_s[r, : held[r]] = ids[first], all_s[first]

    stack = [(q_root, x_root)]
    while stack:
        a, b = stack.pop()
        if bound(a, b) < worst(a):
            continue
        if not a.children and not b.children:
            leaf(a, b)
        elif b.children and (not a.children or b.radius >= a.radius):
            stack.extend(sorted(((a, c) for c in b.children), key=lambda p: bound(*p)))
        else:
            stack.extend((c, b) for c in a.children)
    return [(int(q_ids[r]), int(best_i[r, j]), int(best_s[r, j])) for r in range(n_q) for j in range(held[r])]


def packed(rows: DataFrame, keys: list[str], block: int, names: tuple[str, str, str]) -> DataFrame:
    """Rows of a key in blocks of about `block` rows, each a row of ids and vectors laid end to end."""
    counts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n_blocks"))
    dealt = rows.join(counts, keys).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("n_blocks")).cast("int"))
    name, ids, flat = names
    return dealt.groupBy(*keys, "block").agg(F.collect_list(F.struct("vec_id", "v")).alias("rows")).select(
        F.col("dim"),
        F.xxhash64(*keys, "block").alias(name),
        F.transform("rows", lambda r: r["vec_id"]).alias(ids),
        F.flatten(F.transform("rows", lambda r: r["v"])).alias(flat),
    )


def centred(rows: DataFrame) -> DataFrame:
    """`rows` with dim, the vector's length, and centre, the number of its nearest centre of that length."""
    rows = rows.withColumn("dim", F.size("v"))
    chosen = rows.orderBy(F.xxhash64(F.lit("centres"), "vec_id"), "vec_id").limit(SAMPLE).collect()
    centres: dict[int, np.ndarray] = {}
    for dim in {r.dim for r in chosen}:
        own = [r.v for r in chosen if r.dim == dim]
        points = np.array(own, float).reshape(len(own), dim)
        picks, nearest = [0], np.full(len(points), np.inf)
        while len(picks) < min(CENTRES, len(points)):
            nearest = np.minimum(nearest, ((points - points[picks[-1]]) ** 2).sum(axis=1))
            if nearest.max(initial=0) == 0:
                break
            picks.append(int(nearest.argmax()))
        centres[dim] = points[picks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            out = np.zeros(len(dims), np.int32)
            v = batch.column("v")
            flat, offsets = v.values.to_numpy().astype(float), v.offsets.to_numpy()
            for dim in np.unique(dims):
                c = centres.get(int(dim))
                if c is None or not dim:
                    continue
                at = np.flatnonzero(dims == dim)
                points = flat[offsets[at][:, None] + np.arange(dim)]
                out[at] = ((c**2).sum(axis=1) - 2 * points @ c.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), v, batch.column("dim"), pa.array(out)], ["vec_id", "v", "dim", "centre"])

    return rows.mapInArrow(run, "vec_id long, v array<long>, dim int, centre int")


def search(vectors: DataFrame, queries, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the best k rows of `vectors` (vec_id, v) for those that `queries` selects."""
    spark = vectors.sparkSession
    rows = written(centred(vectors))
    slots = partitions(spark)
    data = packed(rows, ["dim", "centre"], DATA_BLOCK, ("data", "x_ids", "x"))
    asked = packed(rows.where(queries), ["dim", "centre"], QUERY_BLOCK, ("asked", "q_ids", "q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q, x_ids, x = (np.asarray(batch.column(c)[i].values) for c in ("q_ids", "q", "x_ids", "x"))
                dim = batch.column("dim")[i].as_py()
                found = block_top(q_ids, q.reshape(len(q_ids), dim), x_ids, x.reshape(len(x_ids), dim), k)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["query_id", "vec_id", "score"])

    data = data.withColumn("slot", F.pmod(F.col("data"), F.lit(slots)).cast("int"))
    asked = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    pairs = asked.join(data.hint("shuffle_merge"), ["dim", "slot"])
    found = pairs.select("dim", "q_ids", "q", "x_ids", "x").mapInArrow(run, "query_id long, vec_id long, score long")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
