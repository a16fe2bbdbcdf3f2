"""Running totals over an ordered column without one task per group.

A plain ordered window sends a whole group to one task. Here the 64-bit order
value is cut into digits: the upper 22 bits name a cell, and a cell that holds
too many rows is cut again by the next 21 bits. Totals are taken per cell, summed
along the cells, and carried into windows that run inside one cell only. No
window holds more than `cell_rows` rows or 2**21 order values, whatever the data;
all totals are whole numbers, so a recomputed task gives the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL_ROWS = 1 << 20
CELL_SHIFT, PART_SHIFT, PART_MASK = 42, 21, (1 << 21) - 1

CELL, PART = "__cell", "__part"


def _window(group: Sequence[str], order: str, frame: str) -> str:
    return f"over (partition by {', '.join(group) or '0'} order by {order} rows between unbounded preceding and {frame})"


def _carry(rows: DataFrame, starts: DataFrame, group: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """Running sums of `rows` inside each group, begun at the totals in `starts`.

    A start row has no order value, so it is first in its group; adding it as a
    row needs one shuffle of `rows` where a join and a window would need two.
    """
    inside = _window(group, ", ".join(f"{c} asc nulls first" for c in order), "current row")
    both = rows.unionByName(starts, allowMissingColumns=True)
    return both.selectExpr(
        *[f"`{c}`" for c in both.columns if not c.startswith("total_")],
        *[f"sum({s}) {inside} as through_{s}" for s in sums],
        *[f"first(total_{s}) {inside} as total_{s}" for s in sums],
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Sequence[str],
    *,
    ties: Sequence[str] = (),
    with_start: bool = False,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Add `through_<s>` (sum up to and with the row) and `total_<s>` per key group.

    `order` is a LONG column; a null in it fails the job, so that no row is lost. `ties` settle the order of equal
    values. `sums` are whole numbers, not negative, and not all zero in a row.
    With `with_start` each key group also gets a first row of zeros.
    """
    keys, sums = [f"`{c}`" for c in keys], list(sums)
    checked = F.coalesce(F.col(f"`{order}`"), F.raise_error(F.lit(f"null in {order}, which orders the rows")).cast("long"))
    base = df.withColumn(order, checked).selectExpr("*", f"shiftright(`{order}`, {CELL_SHIFT}) as {CELL}")
    grouped = [F.expr(f"sum({s}) as {s}") for s in sums]

    before, whole = _window(keys, CELL, "1 preceding"), _window(keys, CELL, "unbounded following")
    cells = (
        base.groupBy(*keys, CELL)
        .agg(F.expr("count(1) as __rows"), *grouped)
        .selectExpr(
            *keys,
            CELL,
            "__rows",
            *[f"coalesce(sum({s}) {before}, 0L) as {s}" for s in sums],
            *[f"sum({s}) {whole} as total_{s}" for s in sums],
        )
    )

    # A cell with more rows is cut again. At most rows / cell_rows cells are this
    # full, which bounds the broadcast. Reading all totals in the test keeps this
    # branch on the same shuffle as the others.
    over = " and ".join([f"__rows > {cell_rows}", *[f"total_{s} >= 0" for s in sums]])
    names = {c: f"__full_{i}" for i, c in enumerate([*keys, CELL])}
    full = cells.where(over).selectExpr(*[f"{c} as {n}" for c, n in names.items()])
    same = F.expr(" and ".join(f"{c} <=> {n}" for c, n in names.items()))
    part = f"shiftright(`{order}`, {PART_SHIFT}) & {PART_MASK}L"

    parts = base.join(F.broadcast(full), same).groupBy(*keys, CELL, F.expr(f"{part} as {PART}")).agg(*grouped)
    totals = [f"total_{s}" for s in sums]
    placed = _carry(parts, cells.where(over).drop("__rows"), [*keys, CELL], [PART], sums)
    starts = (
        placed.where(f"{PART} is not null")
        .selectExpr(*keys, CELL, PART, *[f"through_{s} - {s} as {s}" for s in sums], *totals)
        .unionByName(cells.where(f"not ({over})").selectExpr(*keys, CELL, f"-1L as {PART}", *sums, *totals))
    )
    rows = base.join(F.broadcast(full), same, "left").selectExpr(
        *[f"`{c}`" for c in base.columns], f"if({names[CELL]} is null, -1L, {part}) as {PART}"
    )
    out = _carry(rows, starts, [*keys, CELL, PART], [f"`{order}`", *[f"`{c}`" for c in ties]], sums)
    keep = f"`{order}` is not null"
    if with_start:
        keep += " or (" + " and ".join(f"through_{s} = 0" for s in sums) + ")"
    return out.where(keep).drop(CELL, PART)


def ordinal(
    df: DataFrame, keys: Sequence[str], order: str, name: str, *, ties: Sequence[str] = (), cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Add the 1-based position of each row inside its key group, ordered by the LONG `order`."""
    counted = df.selectExpr("*", "1L as __one")
    out = running_totals(counted, keys, order, ["__one"], ties=ties, cell_rows=cell_rows)
    return out.withColumnRenamed("through___one", name).drop("__one", "total___one")
