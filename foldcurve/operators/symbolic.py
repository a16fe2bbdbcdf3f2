"""Symbolic expressions over the columns of a table, and their fitness.

An expression is a number, a column name, or a tuple (function name, operand,
...). It is compiled to one Column, so scoring stays inside generated code.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldcurve.functions.scalars import FUNCTIONS
from foldcurve.operators.roc import auc

Expression = float | int | str | tuple
# Expressions scored in one plan; more are split into several jobs.
CHUNK = 200


def compile_expr(tree: Expression, columns: Sequence[str] | Mapping[str, Column]) -> Column:
    """The column of an expression. `columns` lists the usable names, or maps them to columns."""
    if isinstance(tree, (int, float)):
        return F.lit(float(tree))
    if isinstance(tree, str):
        if tree not in columns:
            raise ValueError(f"no column {tree} in this table")
        return columns[tree] if isinstance(columns, Mapping) else F.col(f"`{tree}`").cast("double")
    name, *operands = tree
    if name not in FUNCTIONS:
        raise ValueError(f"no function {name}")
    return FUNCTIONS[name](*[compile_expr(o, columns) for o in operands])


def to_text(tree: Expression) -> str:
    if isinstance(tree, tuple):
        return f"{tree[0]}({', '.join(to_text(o) for o in tree[1:])})"
    return tree if isinstance(tree, str) else f"{tree:.3f}".rstrip("0").rstrip(".")


TOKENS = re.compile(r"\s*(?:(?P<number>[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)(?=\s*[,)]|\s*$)|(?P<name>[^\s,()]+)|(?P<mark>[(),]))")


def from_text(text: str) -> Expression:
    """The expression of `name(operand, ...)` text, as `to_text` writes it.

    What stands before a bracket is a function, any other name a column; names may
    hold anything but blanks, commas and brackets. ValueError for other text.
    """
    tokens, at = [], 0
    end = len(text.rstrip())
    while at < end:
        found = TOKENS.match(text, at)
        if found is None:
            raise ValueError(f"not an expression: {text!r}")
        tokens.append((found.lastgroup, found[found.lastgroup]))
        at = found.end()
    tokens.append(("end", ""))
    # Open calls, each a list that begins with the function's name; the first collects the result.
    open_calls: list[list] = [[None]]
    wants, i = True, 0
    while tokens[i][0] != "end":
        kind, value = tokens[i]
        if wants and kind == "number":
            open_calls[-1].append(float(value))
            wants = False
        elif wants and kind == "name" and tokens[i + 1] == ("mark", "("):
            open_calls.append([value])
            i += 1
        elif wants and kind == "name":
            open_calls[-1].append(value)
            wants = False
        elif not wants and value == "," and len(open_calls) > 1:
            wants = True
        elif not wants and value == ")" and len(open_calls) > 1:
            call = tuple(open_calls.pop())
            if call[0] not in FUNCTIONS:
                raise ValueError(f"no function {call[0]}")
            open_calls[-1].append(call)
        else:
            raise ValueError(f"not an expression: {text!r}")
        i += 1
    if wants or len(open_calls) != 1 or len(open_calls[0]) != 2:
        raise ValueError(f"not an expression: {text!r}")
    return open_calls[0][1]


def depth(tree: Expression) -> int:
    return 1 + max(depth(o) for o in tree[1:]) if isinstance(tree, tuple) else 0


def length(tree: Expression) -> int:
    return 1 + sum(length(o) for o in tree[1:]) if isinstance(tree, tuple) else 1


def logistic(value: Column) -> Column:
    return 1 / (1 + F.exp(-value))


def score_expr(df: DataFrame, tree: Expression, columns: Sequence[str], name: str = "p") -> DataFrame:
    """Add the class-1 probability of an expression."""
    return df.withColumn(name, logistic(compile_expr(tree, columns)))


def probability_pair(p: Column) -> Column:
    """[probability of class 0, probability of class 1]."""
    return F.array(1 - p, p)


def chunks(items: Sequence, size: int) -> Iterator[tuple[int, Sequence]]:
    for start in range(0, len(items), size):
        yield start, items[start : start + size]


def population_scores(df: DataFrame, trees: Sequence[Expression], columns: Sequence[str] | Mapping[str, Column], keep: Sequence[str], first: int = 0) -> DataFrame:
    """(keep, candidate, p): raw value of every expression on every row, from one scan."""
    values = F.array(*[compile_expr(t, columns) for t in trees])
    out = df.select(*keep, F.posexplode(values).alias("candidate", "p"))
    return out.withColumn("candidate", F.col("candidate") + first) if first else out


Fitness = Callable[[DataFrame, list[str], str, str], DataFrame]


def area_fitness(scored: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Area under the curve per candidate: the default fitness."""
    return auc(scored, keys, label, score).select(*keys, F.col("auc").alias("fitness"))


def population_auc(
    df: DataFrame,
    trees: Sequence[Expression],
    columns: Sequence[str] | Mapping[str, Column],
    label: str = "y",
    keys: Sequence[str] = (),
    fitness: Fitness = area_fitness,
    chunk: int = CHUNK,
) -> DataFrame:
    """(keys, candidate, fitness) of many expressions.

    Candidates share one scan of the table. A further callable with the same
    signature may replace the area as the fitness.
    """
    parts = []
    for first, some in chunks(trees, chunk):
        scored = population_scores(df, some, columns, [*keys, label], first)
        parts.append(fitness(scored, [*keys, "candidate"], label, "p"))
    return reduce(DataFrame.unionByName, parts)
