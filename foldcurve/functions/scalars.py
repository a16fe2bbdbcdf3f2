"""The scalar functions of symbolic expressions, on columns.

Each takes (a, b, x): two operands and a weight. Functions of one operand use
b. A registry maps the names used in expressions to the functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Divisors nearer to zero than this give 1.
SMALLEST_DIVISOR = 0.001


def _guarded(pick: Callable[..., Column]) -> Callable[..., Column]:
    """Make NaN win: Spark holds NaN above all numbers, so plain least would lose it."""
    return lambda a, b, x: F.when(F.isnan(a) | F.isnan(b), F.lit(float("nan"))).otherwise(pick(a, b))


def _divide(a: Column, b: Column, x: Column | None) -> Column:
    # try_divide: a shared quotient may be computed ahead of the test.
    return F.when(~F.isnan(b) & (F.abs(b) > SMALLEST_DIVISOR), F.try_divide(a, b)).otherwise(F.lit(1.0))


def _divide_numbers(a: np.ndarray, b: np.ndarray, x: np.ndarray | None) -> np.ndarray:
    far = np.abs(b) > SMALLEST_DIVISOR
    return np.where(far, a / np.where(far, b, 1.0), 1.0)


@dataclass(frozen=True)
class Named:
    """A column function with the name it has in expressions and its number of operands.

    `numbers` is the same function on arrays without nulls; a function without it works on columns only.
    """

    name: str
    operands: int
    apply: Callable[[Column | None, Column, Column | None], Column]
    numbers: Callable[[np.ndarray | None, np.ndarray, np.ndarray | None], np.ndarray] | None = None

    def __call__(self, *operands: Column) -> Column:
        if len(operands) != self.operands:
            raise ValueError(f"{self.name} takes {self.operands} operands, not {len(operands)}")
        if self.operands == 1:
            return self.apply(None, operands[0], None)
        a, b, *x = operands
        return self.apply(a, b, x[0] if x else None)

    def of_numbers(self, *operands: np.ndarray) -> np.ndarray:
        if self.operands == 1:
            return self.numbers(None, operands[0], None)
        a, b, *x = operands
        return self.numbers(a, b, x[0] if x else None)


FUNCTIONS = {
    f.name: f
    for f in (
        Named("add", 2, lambda a, b, x: a + b, lambda a, b, x: a + b),
        Named("sub", 2, lambda a, b, x: a - b, lambda a, b, x: a - b),
        Named("mul", 2, lambda a, b, x: a * b, lambda a, b, x: a * b),
        Named("div", 2, _divide, _divide_numbers),
        Named("sqrt", 1, lambda a, b, x: F.sqrt(F.abs(b)), lambda a, b, x: np.sqrt(np.abs(b))),
        Named("neg", 1, lambda a, b, x: -b, lambda a, b, x: -b),
        Named("abs", 1, lambda a, b, x: F.abs(b), lambda a, b, x: np.abs(b)),
        Named("WA", 3, lambda a, b, x: x * a + (1 - x) * b, lambda a, b, x: x * a + (1 - x) * b),
        # NaN is the greatest for columns; fmin leaves it out as `least` does.
        Named("OWA", 3, lambda a, b, x: x * F.greatest(a, b) + (1 - x) * F.least(a, b), lambda a, b, x: x * np.maximum(a, b) + (1 - x) * np.fmin(a, b)),
        Named("min", 2, _guarded(F.least), lambda a, b, x: np.minimum(a, b)),
        Named("max", 2, _guarded(F.greatest), lambda a, b, x: np.maximum(a, b)),
        Named("dilator", 1, lambda a, b, x: F.pow(b, F.lit(0.5)), lambda a, b, x: np.power(b, 0.5)),
        Named("concentrator", 1, lambda a, b, x: b * b, lambda a, b, x: b * b),
    )
}


def register(function: Named) -> None:
    """Make a further function usable in expressions."""
    FUNCTIONS[function.name] = function
