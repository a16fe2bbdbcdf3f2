"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target of words: a share of a budget by weight, stopped at a multiple
of the source's size, the excess reshared by weight. A document of a source is to be
taken target / source size times: whole copies at once, and the fraction by rounding.
Rounding pairs two documents with fractional copies and moves words from one to the
other, in a random direction with chances that keep both expectations, until one of them
has a whole number of copies; the words that both take stay the same. So a group of
documents ends with one fraction at most. Groups of bounded size are rounded in parallel;
what each leaves goes to groups of the next level, until one is left per source: a
distributed reduction tree. The last fraction is rounded by its own chance, so a source
misses its target by less than one document, a small one as a rule: large ones are paired first.

Random numbers are hashes of the seed, the level and the document's id and size; groups
are hashes of the id; sources are counted first. Nothing depends on the layout of the
input, so reruns agree. Only ids, sizes and source numbers are moved. A source may hold
any share of all rows: its documents fill as many groups as they need.

Null text has size 0; documents of size 0 are taken 0 times. A null source is a source
of its own and comes last. Repeated rows are rounded each for itself; rows alike in id,
size and source are interchangeable. The reduction keeps (row number, size, copies) of
a row in one group only. An empty table gives an empty result.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldcurve.llm.common import WORD, written

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2.0
#: Documents of a group, on average.
GROUP = 4096
SEED = 20


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and the number of words of the whole text."""
    n = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n.cast("long").alias("size"))


def targets(rows: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """source, source_size, target, n_docs: one row per source.

    Targets are min(cap, level * weight): the level at which the excess over caps has been reshared. The
    windows run over one row per source.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    # Code points order as UTF-8 bytes do.
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    per = per.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    per = per.withColumn("fill", F.col("cap") / F.col("weight"))
    by_fill = Window.orderBy("fill", F.col("source").isNull(), "source")
    everything = Window.partitionBy(F.lit(1))
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = budget * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", rest / open_weight)
    # The first source in order of fill that its level does not fill sets the level for itself and all after it.
    level = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(everything)
    per = per.withColumn("_level", level["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("_level") * F.col("weight"), F.col("cap")))
    return per.select("source", "source_size", target.alias("target"), "n_docs")


def pivot(sizes: np.ndarray, shares: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Shares of 0 or 1, but for one at most, whose place is returned (-1: none). Words are kept."""
    out = shares.copy()
    held = -1
    for i in range(len(out)):
        if not 0 < out[i] < 1:
            continue
        if held < 0:
            held = i
            continue
        a, b = sizes[held], sizes[i]
        # Words that can move from i to the held one, and the other way.
        up, down = min((1 - out[held]) * a, out[i] * b), min(out[held] * a, (1 - out[i]) * b)
        move = up if draws[i] * (up + down) < down else -down
        x, y = out[held] + move / a, out[i] - move / b
        full = 1e-12
        x, y = (0.0 if x < full else 1.0 if x > 1 - full else x), (0.0 if y < full else 1.0 if y > 1 - full else y)
        out[held], out[i] = x, y
        held = held if 0 < x < 1 else i if 0 < y < 1 else -1
    return out, held


GROUP_ROW = "number int, doc_id long, size long, share double, n_docs long, open boolean"


def group_rounder(last: bool):
    """Rounds one group of an Arrow table; in the last level its remaining fraction, too."""

    def run(table: pa.Table) -> pa.Table:
        draw = table["_draw"].to_numpy()
        size, share = table["size"].to_numpy(), table["share"].to_numpy()
        # Large documents first, so that the fraction that is left belongs to a small one.
        order = np.lexsort((draw, share, -size))
        chance = (draw[order].astype(np.uint64) >> np.uint64(11)).astype(float) / 2.0**53
        shares, held = pivot(size[order].astype(float), share[order], (chance * 7919.0) % 1.0)
        open_ = np.zeros(len(order), bool)
        if held >= 0:
            if last:
                shares[held] = float((chance[held] * 104729.0) % 1.0 < shares[held])
            else:
                open_[held] = True
        table = table.take(pa.array(order))
        columns = [table["number"], table["doc_id"], table["size"], pa.array(shares), table["n_docs"], pa.array(open_)]
        return pa.Table.from_arrays(columns, ["number", "doc_id", "size", "share", "n_docs", "open"])

    return run


def rounded(rows: DataFrame, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """Rows (number, doc_id, size, share, n_docs) with share 0 or 1 in place of each fraction, source by source."""
    level, done = 0, []
    most = int(rows.agg(F.max("n_docs")).first()[0] or 0)
    while True:
        last = most <= group
        n_groups = F.greatest(F.ceil(F.col("n_docs") / group), F.lit(1))
        placed = rows.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed + level), "doc_id"), n_groups).cast("int"))
        placed = placed.withColumn("_draw", F.xxhash64(F.lit(seed + level), F.lit("draw"), "doc_id", "size"))
        after = written(placed.groupBy("number", "_group").applyInArrow(group_rounder(last), GROUP_ROW))
        done.append(after.where("not open").drop("open"))
        if last:
            break
        # One row per group at most goes on.
        rows = after.where("open").drop("open").withColumn("n_docs", F.ceil(F.col("n_docs") / group))
        most = -(-most // group)
        level += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row per document."""
    rows = written(sizes(docs))
    per = written(targets(rows, weights, budget, most).withColumn("number", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))))
    # One row per source: Spark broadcasts it where it measures it as small, and splits skewed sources where not.
    joined = rows.join(per, rows["source"].eqNullSafe(per["source"])).drop(per["source"])
    wish = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = joined.withColumn("whole", F.floor(wish).cast("long")).withColumn("share", wish - F.floor(wish))
    moving = joined.where("share > 0 and size > 0").select(F.col("number").cast("int"), "doc_id", "size", "share", F.col("n_docs").cast("long"))
    extra = rounded(moving, seed).select("number", "doc_id", "size", F.col("share").cast("long").alias("extra"))
    # What is not rounded takes its whole copies.
    still = joined.where("not (share > 0 and size > 0)").select("number", "doc_id", "size", F.lit(0).cast("long").alias("extra"))
    every = extra.unionByName(still.withColumn("number", F.col("number").cast("int")))
    out = every.join(per, "number")
    wish = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(wish).cast("long") + F.col("extra")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
