"""Exact k nearest neighbours by Manhattan distance.

Training rows are split into cells around pivots, whose number grows with the square
root of the rows. Every row first searches its own cell; the distance of its k-th
neighbour there bounds the search. By the triangle inequality the members of a cell at
distance d lie between d - far and d - near of the row, so only cells that reach into
the bound are searched after that. Cells are searched in blocks of bounded size, each a
small array computation that returns k rows per searched row. Nothing is left out: far
data only means that more cells must be searched. Where features are many and
unrelated, distances are nearly equal and no bound excludes a cell. There a block first
compares rows rounded to one byte a feature: what rounding moved a row bounds the error of
its distances, and only pairs whose least distance is not above the k-th greatest one are
compared exactly. Where rows reach most cells, all blocks are compared with all: rows are packed
in blocks that are written once, and a task reads the training blocks one after the other from there,
holding the k nearest rows of its own block. No row is copied for a block of the other side.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The functions below travel with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fewest and most pivots; in between, the square root of the rows. The most reach the driver and every task. Cells of
# more rows are searched in more blocks.
PIVOTS, PIVOTS_MOST = 32, 8192
BLOCK = 2048
# Relative slack on distance bounds, wider than the rounding of a sum.
SLACK = 1e-9
# Steps of a rounded feature, and slack on rounded distances, as a share of the greatest number times the features.
STEPS, ROUNDING = 255, 1e-12
# Rows whose rounded distances are added up together, so that they stay in the cache of a core.
STRIP = 64
# Blocks are compared with all others where rows reach more than this share of the cells.
CROWDED = 0.25
#: Numbers of training rows that a task reads one after the other: 64 MB.
READ = 1 << 23
#: Pairs of rows and cells, and numbers of routed rows, that a task holds at once.
PAIRS, NUMBERS = 1 << 20, 1 << 20
#: Routed rows that a task of a search sorts.
TASK_ROWS = 1 << 20
SEED = 7


def _matrix(features: pd.Series) -> np.ndarray:
    out = np.array(features.tolist(), dtype="float64") if len(features) else np.empty((0, 0))
    if not np.isfinite(out).all():
        raise ValueError("a feature is missing or not a finite number")
    return out


def slices(rows: pd.DataFrame, width: int, most: int) -> Iterator[pd.DataFrame]:
    """The rows in their order, so many at a time that `most` numbers hold `width` of each."""
    step = max(1, most // max(1, width))
    for start in range(0, len(rows), step):
        yield rows.iloc[start : start + step]


def manhattan(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Distances between all rows of two blocks, one feature at a time to keep memory flat."""
    out = np.zeros((len(left), len(right)))
    for j in range(left.shape[1]):
        out += np.abs(left[:, j, None] - right[None, :, j])
    return out


def coarse(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray] | None:
    """Distances between all rows of two blocks in whole steps, from rounded features; the step; how far the distances of a left and a right row may be off.

    One step serves all features. A distance differs from that of the rounded rows by what
    rounding moved both rows at most. None where the range of a feature is no finite number.
    """
    low, high = np.minimum(left.min(0), right.min(0)), np.maximum(left.max(0), right.max(0))
    with np.errstate(over="ignore"):
        step = float((high - low).max(initial=0.0)) / STEPS or 1.0
        most = float(np.maximum(np.abs(low), np.abs(high)).max(initial=0.0)) * max(left.shape[1], 1)
    if not np.isfinite(step * STEPS * max(left.shape[1], 1)) or not np.isfinite(most):
        return None
    whole, moved = [], []
    for rows in (left, right):
        steps = np.rint((rows - low) / step)
        whole.append(np.ascontiguousarray(steps.T.astype("int16")))
        moved.append(np.abs(rows - low - steps * step).sum(1))
    total = np.zeros((len(left), len(right)), "int16" if STEPS * left.shape[1] < 1 << 15 else "int32")
    greater = np.empty((STRIP, len(right)), "int16")
    for start in range(0, len(left), STRIP):
        strip = total[start : start + STRIP]
        for a, b in zip(*whole):
            strip += np.maximum(a[start : start + STRIP, None], b[None, :], out=greater[: len(strip)])
    # A difference is twice the greater number without both. What is too much for two bytes on the way comes back.
    total += total
    total -= whole[0].sum(axis=0, dtype=total.dtype)[:, None]
    total -= whole[1].sum(axis=0, dtype=total.dtype)[None, :]
    return total, step, moved[0] + ROUNDING * most, moved[1]


def nearest_in_block(
    asks: np.ndarray, points: np.ndarray, k: int, allowed: np.ndarray | None = None, bound: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(ask, point, distance) of the k nearest points of each ask, nearest first, and the number of exact comparisons.

    Equal distances are ordered by the place of the point. Only pairs in `allowed` count. Points beyond an ask's `bound`
    may be left out. A distance that is no finite number has no pair.
    """
    able = np.ones((len(asks), len(points)), bool) if allowed is None else allowed.copy()
    if able.any() and (limits := coarse(asks, points)) is not None:
        total, step, left, right = limits
        if bound is not None and np.isfinite(bound).all():
            # The bound decides, in whole steps.
            steps = np.floor((bound * (1 + SLACK) + left + right.max()) * (1 + SLACK) / step)
            able &= total <= np.minimum(steps, np.iinfo(total.dtype).max).astype(total.dtype)[:, None]
        else:
            about, error = total * step, left[:, None] + right[None, :]
            if k < len(points):
                greatest = np.where(able, about + error, np.inf)
                able &= about - error <= np.partition(greatest, k - 1, axis=1)[:, k - 1, None]
            if bound is not None:
                able &= about - error <= (bound * (1 + SLACK))[:, None]
    ask, point = np.nonzero(able)
    distance = np.zeros(len(ask))
    # The features are added in their order, as everywhere, so equal rows have equal distances in all blocks.
    for j in range(asks.shape[1]):
        distance += np.abs(asks[ask, j] - points[point, j])
    compared = len(ask)
    finite = np.isfinite(distance)
    ask, point, distance = ask[finite], point[finite], distance[finite]
    order = np.lexsort((point, distance, ask))
    ask, point, distance = ask[order], point[order], distance[order]
    rank = np.arange(len(ask)) - np.searchsorted(ask, ask)
    return ask[rank < k], point[rank < k], distance[rank < k], compared


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """`rows`, n at most, by their keys in tasks of about TASK_ROWS, where the session's shuffle partitions would hold more."""
    tasks = -(-n // TASK_ROWS)
    return rows if tasks <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(tasks, *keys)


def packed(rows: DataFrame, n: int, features: int, block: int) -> DataFrame:
    """About n rows (id, part, features, label or none), `block` of them in a row as bytes, in the order of their id; numbers that are no longer than four bytes take four."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for some in slices(batch, features, min(block * features, NUMBERS)):
                some = some.sort_values("id")
                x = _matrix(some["features"])
                with np.errstate(over="ignore"):
                    short = x.astype("float32")
                columns = [some["id"].to_numpy("int64"), some["part"].to_numpy("float64"), some["label"].to_numpy("float64") if "label" in some else np.empty(0), short if (short == x).all() else x]
                yield pd.DataFrame({c: [v.tobytes()] for c, v in zip(("ids", "parts", "labels", "x"), columns)})

    # Small partitions would be small blocks.
    return rows.coalesce(max(1, n // (4 * block))).mapInPandas(pack, "ids binary, parts binary, labels binary, x binary")


def crossed(found: DataFrame, known: DataFrame, k: int, n: int, n_known: int, features: int, block: int, apart: bool) -> DataFrame:
    """(id, neighbor, distance, label): the k nearest rows of each row in each part of the training rows, READ numbers of them.

    Blocks are written once on each side. What is read grows with the product of their numbers, what is written with
    the rows, but for k answers of each row from each part.
    """
    rows = max(1, min(block, NUMBERS // max(1, features)))
    left = packed(found, n, features, block).select(F.col("ids").alias("own_ids"), F.col("parts").alias("own_parts"), F.col("x").alias("own_x"))
    right = packed(known, n_known, features, block).repartition(max(1, -(-n_known * features // READ)))
    # The hint keeps small sides from a broadcast, which may turn the sides round.
    pairs = left.repartition(max(1, -(-n // rows))).crossJoin(right.hint("shuffle_replicate_nl"))

    def matrix(x: bytes, n: int) -> np.ndarray:
        return np.frombuffer(x, "float32" if len(x) == 4 * n * features else "float64").reshape(n, features).astype("float64")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None

        def answer() -> pa.RecordBatch:
            row, rank = np.nonzero(np.isfinite(distance))
            # A label that is missing is no number.
            columns = [pa.array(ids[row]), pa.array(near[row, rank]), pa.array(distance[row, rank]), pa.array(labels[row, rank], from_pandas=True)]
            return pa.RecordBatch.from_arrays(columns, ["id", "neighbor", "distance", "label"])

        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                # A block of the left side meets all training blocks of a part before the next one comes.
                if own is None or columns["own_ids"][i].as_buffer() != own:
                    if own is not None:
                        yield answer()
                    own = columns["own_ids"][i].as_py()
                    ids, parts = np.frombuffer(own, "int64"), np.frombuffer(columns["own_parts"][i].as_py(), "float64")
                    asks = matrix(columns["own_x"][i].as_py(), len(ids))
                    distance, near, labels = np.full((len(ids), k), np.inf), np.zeros((len(ids), k), "int64"), np.zeros((len(ids), k))
                point_ids, point_parts, point_labels = (np.frombuffer(columns[c][i].as_buffer(), t) for c, t in (("ids", "int64"), ("parts", "float64"), ("labels", "float64")))
                points = matrix(columns["x"][i].as_buffer(), len(point_ids))
                # With a bound for every row, a pair takes two bytes until it is compared exactly.
                step = 1024 if np.isfinite(distance).all() else 256
                for start in range(0, len(ids), step):
                    some = slice(start, start + step)
                    allowed = parts[some, None] != point_parts[None, :] if apart else None
                    row, col, d, _ = nearest_in_block(asks[some], points, k, allowed, distance[some, k - 1])
                    if not len(row):
                        continue
                    hit, first, at = np.unique(row, return_index=True, return_inverse=True)
                    more = [np.full((len(hit), k), v, a.dtype) for v, a in ((np.inf, distance), (0, near), (0, labels))]
                    for new, values in zip(more, (d, point_ids[col], point_labels[col])):
                        new[at, np.arange(len(row)) - first[at]] = values
                    both = [np.concatenate([held[start + hit], new], axis=1) for held, new in zip((distance, near, labels), more)]
                    order = np.lexsort((both[1], both[0]), axis=1)[:, :k]
                    for held, values in zip((distance, near, labels), both):
                        held[start + hit] = np.take_along_axis(values, order, axis=1)
        if own is not None:
            yield answer()

    return pairs.mapInArrow(search, "id long, neighbor long, distance double, label double")


def _pivots(train: DataFrame, key: str, features: str, n: int) -> np.ndarray:
    """A few training rows in hash order of their key: at most n rows reach the driver."""
    rows = train.select(key, features).orderBy(F.xxhash64(key, F.lit(SEED)), key).limit(n).collect()
    return np.array([r[features] for r in rows], dtype="float64")


def nearest_neighbors(
    queries: DataFrame,
    train: DataFrame,
    k: int,
    key: str = "row_id",
    features: str = "features",
    label: str = "y",
    part: str | None = None,
    *,
    n_pivots: int | None = None,
    block: int = BLOCK,
    visited: dict | None = None,
) -> DataFrame:
    """(key, neighbor, distance, label of the neighbour, rank) of the k nearest training rows.

    Keys are unique on each side and features are finite numbers: ValueError, or a
    failed job, where they are not. `n_pivots` is by default the square root of the
    training rows, PIVOTS_MOST at most. `visited`, if given, receives the number of compared pairs.

    With `part`, a row takes its neighbours from the rows of other parts only,
    which is out-of-fold search in one job. `features` is an ARRAY<DOUBLE>
    column. Equal distances are ordered by the key of the neighbour.
    """
    part_of = F.col(part).cast("int") if part else F.lit(-1)
    wanted = [F.col(key).cast("long").alias("id"), part_of.alias("part"), F.col(features).cast("array<double>").alias("features")]
    found = queries.select(*wanted)
    known = train.select(*wanted, F.col(label).cast("double").alias("label"))

    for side, rows in (("searched", found), ("training", known)):
        twice = rows.groupBy("id").count().where("count > 1 or id is null").first()
        if twice is not None:
            raise ValueError(f"key {twice['id']} of the {side} rows is not unique")
    n_pivots = min(max(PIVOTS, math.isqrt(known.count())), PIVOTS_MOST) if n_pivots is None else n_pivots
    pivots = _pivots(known, "id", "features", n_pivots)
    if not len(pivots):
        raise ValueError("no training rows")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows in slices(batch, len(pivots), PAIRS):
                away = manhattan(_matrix(rows["features"]), pivots)
                yield rows.assign(cell=away.argmin(axis=1).astype("int32"), away=away.min(axis=1))

    placed_type = T.StructType([*known.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])
    placed = known.mapInPandas(place, placed_type)

    # One row per pivot and part: the size is set by the settings, not by the data.
    extents = placed.groupBy("cell", "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("away").alias("near"), F.max("away").alias("far")
    ).toPandas()
    n_parts = int(extents["part"].max()) + 1 if part else 1
    # A pivot without rows has no total and is never reached.
    cells = np.arange(len(pivots))
    sizes = np.zeros((len(cells), n_parts), dtype="int64")
    near, far = np.full(len(cells), np.inf), np.zeros(len(cells))
    for c, p, n, lo, hi in extents.itertuples(index=False):
        sizes[c, max(p, 0)] += n
        near[c], far[c] = min(near[c], lo), max(far[c], hi)
    centers = pivots
    totals = sizes.sum(axis=1)

    def usable(rows: pd.DataFrame) -> np.ndarray:
        """Training rows of each cell that each row may have as neighbours."""
        out = np.broadcast_to(totals, (len(rows), len(cells)))
        if part:
            inside = (rows["part"].to_numpy() >= 0) & (rows["part"].to_numpy() < n_parts)
            out = totals[None, :] - sizes.T[np.where(inside, rows["part"].to_numpy(), 0)] * inside[:, None]
        return out

    def own(rows: pd.DataFrame) -> np.ndarray:
        """The nearest cell that holds usable rows, as one True per row."""
        away = np.where(usable(rows) > 0, manhattan(_matrix(rows["features"]), centers), np.inf)
        return (np.arange(len(cells)) == away.argmin(axis=1)[:, None]) & np.isfinite(away)

    def others(rows: pd.DataFrame) -> np.ndarray:
        """All further cells that reach into the distance in `bound`."""
        away = manhattan(_matrix(rows["features"]), centers)
        bound = rows["bound"].fillna(np.inf).to_numpy() * (1 + SLACK) + SLACK
        gap = np.maximum(np.maximum(away - far, near - away), 0.0)
        return (gap * (1 - SLACK) <= bound[:, None]) & (usable(rows) > 0) & ~own(rows)

    spread = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30))

    def each(blocks: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))

    def tally(rows: DataFrame, reach: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
        """How many rows reach each cell."""

        def count_visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            visits = np.zeros(len(cells), dtype="int64")
            for batch in batches:
                for some in slices(batch, len(cells), PAIRS):
                    visits += reach(some).sum(axis=0)
            yield pd.DataFrame({"at": np.arange(len(cells), dtype="int32"), "n": visits})

        out = np.zeros(len(cells), dtype="int64")
        for at, n in rows.mapInPandas(count_visits, "at int, n long").groupBy("at").agg(F.sum("n")).collect():
            out[at] = n
        return out

    def searched(rows: DataFrame, reach: Callable[[pd.DataFrame], np.ndarray], visits: np.ndarray) -> DataFrame:
        """(id, neighbor, distance, label): k rows at most from each block of each cell that a row reaches; `visits` are the rows that reach each."""

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            step = max(1, NUMBERS // max(1, pivots.shape[1]))
            for batch in batches:
                for some in slices(batch, len(cells), PAIRS):
                    row, at = np.nonzero(reach(some))
                    # A row may reach many cells: its copies leave a few at a time.
                    for start in range(0, len(row), step):
                        yield some.iloc[row[start : start + step]].assign(at=at[start : start + step].astype("int32"))

        if visited is not None:
            visited["pairs"] = visited.get("pairs", 0) + int(visits @ totals)
        # Both sides of a cell are cut so that no block holds much more than `block` rows.
        train_blocks, query_blocks = np.maximum(1, -(-totals // block)), np.maximum(1, -(-visits // block))
        routed = rows.mapInPandas(route, T.StructType([*rows.schema.fields, T.StructField("at", T.IntegerType())]))
        # A few whole numbers per pivot.
        spark = known.sparkSession
        cuts = zip(cells.tolist(), query_blocks.tolist(), train_blocks.tolist())
        cut = F.broadcast(spark.createDataFrame(list(cuts), "at int, query_blocks long, train_blocks long"))
        asked = routed.join(cut, "at").select(
            "at", *rows.columns, (spread % F.col("query_blocks")).alias("query_block"), each("train_blocks").alias("train_block")
        )
        held = placed.withColumnRenamed("cell", "at").join(cut, "at").select(
            "at", *known.columns, (spread % F.col("train_blocks")).alias("train_block"), each("query_blocks").alias("query_block")
        )
        block_key = ["at", "train_block", "query_block"]
        # Rows are sent to as many blocks as their cell has on the other side: more copies go to more tasks.
        copies = int(visits @ train_blocks) + int(totals @ query_blocks)
        asked, held = dealt(asked, copies, *block_key), dealt(held, copies, *block_key)
        return (
            asked.groupBy(*block_key)
            .cogroup(held.groupBy(*block_key))
            .applyInPandas(search, "id long, neighbor long, distance double, label double")
        )

    def search(asks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        outputs = []
        if len(asks) and len(rows):
            # In key order, so that ties come out by key.
            rows = rows.sort_values("id")
            points, ids, labels, parts = _matrix(rows["features"]), rows["id"].to_numpy(), rows["label"].to_numpy(), rows["part"].to_numpy()
            for start in range(0, len(asks), 256):
                some = asks.iloc[start : start + 256]
                allowed = some["part"].to_numpy()[:, None] != parts[None, :] if part else None
                bound = some["bound"].fillna(np.inf).to_numpy(dtype="float64") if "bound" in some else None
                row, col, d, _ = nearest_in_block(_matrix(some["features"]), points, k, allowed, bound)
                outputs.append(pd.DataFrame({"id": some["id"].to_numpy()[row], "neighbor": ids[col], "distance": d, "label": labels[col]}))
        if not outputs:
            return pd.DataFrame({"id": [], "neighbor": [], "distance": [], "label": []})
        return pd.concat(outputs, ignore_index=True)

    at_home = tally(found, own)
    first = searched(found, own, at_home).persist(StorageLevel.MEMORY_AND_DISK)
    order = Window.partitionBy("id").orderBy("distance", "neighbor")
    bounds = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("id", F.col("distance").alias("bound"))
    bounded = found.join(bounds, "id", "left")
    abroad = tally(bounded, others)
    n, n_known, width = int(at_home.sum()), int(totals.sum()), pivots.shape[1]
    if abroad.sum() > CROWDED * n * len(cells):
        first.unpersist()
        if visited is not None:
            visited["pairs"] = visited["pairs"] + n * n_known
        near_rows = crossed(found, known, k, n, n_known, width, block, part is not None)
        most = k * n * max(1, -(-n_known * width // READ))
    else:
        near_rows = first.unionByName(searched(bounded, others, abroad))
        most = k * int((at_home + abroad) @ np.maximum(1, -(-totals // block)))
    # k rows per searched block reach this window. Where they are few, Spark drops ranks beyond k before the shuffle.
    near_rows = dealt(near_rows, most, "id")
    closest = Window.partitionBy("id").orderBy("distance", "neighbor")
    return (
        near_rows.withColumn("rank", F.row_number().over(closest))
        .where(F.col("rank") <= k)
        .select(F.col("id").alias(key), "neighbor", "distance", F.col("label").alias(label), "rank")
    )


def neighbor_probability(neighbors: DataFrame, keys: Sequence[str], label: str = "y") -> DataFrame:
    """(keys, p, yhat): votes weighted by inverse distance; rows at distance 0 alone decide where there are any."""
    zero = F.col("distance") == 0
    weight = F.try_divide(F.lit(1.0), F.col("distance"))
    sums = neighbors.groupBy(*keys).agg(
        F.count_if(zero).alias("__same"),
        F.sum(F.when(zero, F.col(label))).alias("__same_y"),
        F.sum(weight).alias("__w"),
        F.sum(weight * F.col(label)).alias("__wy"),
    )
    p = F.when(F.col("__same") > 0, F.try_divide("__same_y", "__same")).otherwise(F.try_divide("__wy", "__w"))
    return sums.select(*keys, p.alias("p"), (p > 0.5).cast("int").alias("yhat"))


def knn_scores(queries: DataFrame, train: DataFrame, k: int, key: str = "row_id", label: str = "y", **how) -> DataFrame:
    """(key, p, yhat) of every query row."""
    return neighbor_probability(nearest_neighbors(queries, train, k, key, label=label, **how), [key], label)
