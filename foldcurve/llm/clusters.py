"""Centroid clustering over a LAESA pivot table, in whole numbers.

The distances of every vector to a few fixed pivots are measured once and stored beside
it. In each round the distances of the centroids to the same pivots are measured (a
few numbers); the largest difference of the two over all pivots is a lower bound of a
vector's distance to a centroid. Centroids are tried in ascending order of their
bound, and those whose bound exceeds the best exact distance so far are never measured.
All distances that decide are squared Euclidean distances in whole numbers, so ties are
ties; bounds carry a slack above their rounding.

A round is one pass over the table: each task sends a count and a sum of components for
every cluster it met, and the driver gets their totals, `k` vectors. Nothing else is
shuffled. Totals are added as decimals, so no number of rows overflows them.

Vectors that are null, of another length than `dim`, or hold null or non-finite
components take no part. Repeated rows each count. Null ids count as the empty text in
the choice of the first centroids, ties of which go by the vector. Fewer rows than `k`
give as many centroids; an empty table gives no rows. Components beyond 2^26 after
scaling, whose distances a long may not hold, raise an error. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldcurve.llm.common import written

DIM, SCALE = 64, 1024
K, ROUNDS = 8, 10
#: Pivots, chosen far apart among this many vectors.
PIVOTS, PIVOT_SAMPLE = 16, 512
LARGEST = 1 << 26
#: Relative slack of a bound: far above the rounding of a square root and a difference.
SLACK = 1e-9

TABLE = "vec_id long, v array<long>, away array<double>"


def scaled(embeddings: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components as whole numbers, of the vectors that take part."""
    x = F.col("embedding")
    sound = F.forall(x, lambda c: F.coalesce((c == c) & ~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    rows = embeddings.where(x.isNotNull() & (F.size(x) == dim)).where(sound)
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    fits = F.forall(x, lambda c: F.abs(c.cast("double") * scale) < LARGEST)
    checked = F.when(fits, whole).otherwise(F.raise_error(F.lit("a component is too large for distances in a long")).cast("array<long>"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), checked.alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    sign = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(sign.alias("sign"), "v").orderBy("sign", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), len(rows[0].v) if rows else 0)


def pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """Vectors far apart among a bounded sample; which they are changes no result, only how much is measured."""
    rows = vectors.select("v").orderBy(F.xxhash64("vec_id", "v")).limit(PIVOT_SAMPLE).collect()
    sample = np.unique(np.array([r.v for r in rows], np.int64), axis=0)
    picks, nearest = [0], np.full(len(sample), np.inf)
    while len(picks) < min(n, len(sample)):
        nearest = np.minimum(nearest, ((sample - sample[picks[-1]]) ** 2).sum(axis=1).astype(float))
        picks.append(int(nearest.argmax()))
    return sample[picks]


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def pivot_table(vectors: DataFrame, anchors: np.ndarray) -> DataFrame:
    """The vectors with their distances to all pivots, written once."""
    n = len(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch, "v")
            away = np.stack([np.sqrt(((x - a) ** 2).sum(axis=1)) for a in anchors], axis=1)
            lists = pa.ListArray.from_arrays(np.arange(0, away.size + 1, n, dtype=np.int32), pa.array(away.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), lists], ["vec_id", "v", "away"])

    return written(vectors.mapInArrow(run, TABLE))


def nearest(x: np.ndarray, away: np.ndarray, centroids: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: the smaller number), its squared distance, and how many distances were measured."""
    bounds = np.zeros((len(x), len(centroids)))
    for p in range(away.shape[1]):
        np.maximum(bounds, np.abs(away[:, p, None] - to_pivots[None, :, p]), out=bounds)
    bounds *= bounds * (1 - SLACK)
    order = np.argsort(bounds, axis=1, kind="stable")
    best = np.full(len(x), np.iinfo(np.int64).max)
    owner = np.full(len(x), len(centroids))
    measured = 0
    for place in range(len(centroids)):
        c = order[:, place]
        rows = np.flatnonzero(bounds[np.arange(len(x)), c] <= best)
        if not len(rows):
            break  # bounds ascend, so no later centroid can come nearer
        c = c[rows]
        d = ((x[rows] - centroids[c]) ** 2).sum(axis=1)
        measured += len(rows)
        better = (d < best[rows]) | ((d == best[rows]) & (c < owner[rows]))
        best[rows[better]], owner[rows[better]] = d[better], c[better]
    return owner, best, measured


def _to_pivots(centroids: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    gaps = centroids[:, None, :] - anchors[None, :, :]
    return np.sqrt((gaps**2).sum(axis=2))


def totals(table: DataFrame, centroids: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows and componentwise sums of each cluster, as whole Python numbers, and distances measured."""
    k, dim = centroids.shape
    to_pivots = _to_pivots(centroids, anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, measured = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch, "v")
            owner, _, n = nearest(x, matrix(batch, "away"), centroids, to_pivots)
            measured += n
            for c in np.unique(owner):
                counts[c] += (owner == c).sum()
                sums[c] += x[owner == c].sum(axis=0)
        both = np.concatenate([counts, sums.reshape(-1), [measured]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both))), pa.array(both)], ["i", "n"])

    found = table.mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    flat = np.zeros(k + k * dim + 1, object)
    for r in found.collect():  # k * (dim + 1) + 1 numbers, whatever the rows
        flat[r.i] = int(r.n)
    return flat[:k], flat[k:-1].reshape(k, dim), int(flat[-1])


class Clustering:
    """Final centroids, the pivot table, and how many distances each round measured."""

    def __init__(self, table: DataFrame, centroids: np.ndarray, anchors: np.ndarray, measured: list[int]):
        self.table, self.centroids, self.anchors, self.measured = table, centroids, anchors, measured

    def assigned(self) -> DataFrame:
        """vec_id, v, cluster, distance (squared)."""
        if not len(self.centroids):
            return self.table.selectExpr("vec_id", "v", "0 as cluster", "0L as distance")
        centroids, to_pivots = self.centroids, _to_pivots(self.centroids, self.anchors)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                owner, best, _ = nearest(matrix(batch, "v"), matrix(batch, "away"), centroids, to_pivots)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("v"), pa.array(owner.astype(np.int32)), pa.array(best)], ["vec_id", "v", "cluster", "distance"]
                )

        return self.table.mapInArrow(run, "vec_id long, v array<long>, cluster int, distance long")


def fit(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = 3, n_pivots: int = PIVOTS) -> Clustering:
    """Clusters `vectors` (vec_id, v of one length): each round assigns all rows and moves every centroid that has some to the floor of their mean."""
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return Clustering(vectors, centroids, centroids, [])
    anchors = pivots(vectors, n_pivots)
    table = pivot_table(vectors, anchors)
    measured = []
    for _ in range(rounds):
        counts, sums, n = totals(table, centroids, anchors)
        measured.append(n)
        centroids = np.array([[s // count for s in row] if count else old for count, row, old in zip(counts, sums, centroids.tolist())], np.int64)
    return Clustering(table, centroids, anchors, measured)


def digest(clustering: Clustering) -> DataFrame:
    """vec_id, cluster, distance, inertia of its cluster and of all, and the hash of its centroid."""
    rows = written(clustering.assigned().select("vec_id", "cluster", "distance"))
    per = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()
    inertia = {r.cluster: int(r.n) for r in per}
    named = [(c, n, sum(inertia.values()), hashlib.sha256(",".join(map(str, clustering.centroids[c].tolist())).encode()).hexdigest()) for c, n in inertia.items()]
    known = rows.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row for each of k clusters
