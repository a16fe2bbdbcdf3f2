"""Integer images of doubles, for splitting an ordered column into cells."""

from __future__ import annotations

from pyspark.sql import DataFrame

FRACTION = 1 << 52
TOP = 2047 * FRACTION


def with_sortable_bits(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add a LONG in the same order as the DOUBLE column `value`; equal values map to equal longs.

    This is exponent and fraction of the number put side by side, found by exact
    steps only: a power of two is exact, and so are products and quotients by it.
    Infinity comes after every number and NaN last, as Spark sorts them. The
    steps are separate projections so that logarithm and power run once per row.
    """
    kept = [f"`{c}`" for c in df.columns]
    sized = df.selectExpr(*kept, f"abs(`{value}`) as __size", f"least(floor(log2(abs(`{value}`))), 1023L) as __guess")
    powers = sized.selectExpr(*kept, "__size", "__guess", "power(2d, __guess) as __power")
    # The logarithm may be off by one next to a power of two.
    scaled = powers.selectExpr(
        *kept,
        "__size",
        "case when __size < __power then __guess - 1 when __size >= 2 * __power then __guess + 1 else __guess end as __exponent",
        "case when __size < __power then __power / 2 when __size >= 2 * __power then 2 * __power else __power end as __scale",
    )
    bits = (
        f"case when isnan(__size) then {TOP + 1}L"
        f" when __size = double('infinity') then {TOP}L"
        " when __size = 0 then 0L"
        f" when __size < {2.0**-1022!r}d then bigint(__size / {2.0**-1074!r}d)"
        f" else (__exponent + 1023) * {FRACTION}L + bigint((try_divide(__size, __scale) - 1) * {float(FRACTION)!r}d) end"
    )
    return scaled.selectExpr(*kept, f"if(`{value}` < 0, -1L, 1L) * {bits} as {name}")
