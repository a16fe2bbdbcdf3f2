"""Seeded search for a symbolic expression by generations of small changes.

The driver holds expressions only. The searches of many folds go together, generation
by generation: one scan of the table scores the new expressions of all of them, each
different subtree once (operators/forest.py). An expression that was scored in an earlier
generation, as most copies and many children were, is not scored again.
"""

from __future__ import annotations

import random
from collections.abc import Generator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldcurve.operators import forest
from foldcurve.operators.symbolic import Expression, Fitness, area_fitness, depth, length, population_auc


@dataclass(frozen=True)
class Search:
    """Settings of a search; the chances are per new expression, the rest are copies."""

    population: int = 100
    generations: int = 20
    tournament: int = 7
    start_depth: tuple[int, int] = (2, 6)
    crossover: float = 0.8
    subtree_mutation: float = 0.01
    hoist_mutation: float = 0.01
    point_mutation: float = 0.01
    point_replace: float = 0.05
    parsimony: float = 0.001
    stop_at: float | None = 0.01
    #: Deeper expressions are not bred, their parent is copied instead; None sets no bound.
    max_depth: int | None = None
    functions: tuple[str, ...] = ("add", "sub", "mul", "div")
    constants: tuple[float, float] = (-1.0, 1.0)
    seed: int = 7


@dataclass(frozen=True)
class Found:
    tree: Expression
    fitness: float
    generation: int


class Breeder:
    """Draws and changes expressions with one seeded generator."""

    def __init__(self, names: list[str], settings: Search) -> None:
        self.names, self.settings = names, settings
        self.random = random.Random(settings.seed)

    def leaf(self) -> Expression:
        i = self.random.randrange(len(self.names) + 1)
        return self.names[i] if i < len(self.names) else self.random.uniform(*self.settings.constants)

    def draw(self, levels: int, full: bool) -> Expression:
        choices = len(self.settings.functions)
        grow = full or self.random.randrange(len(self.names) + choices) < choices
        if levels == 0 or not grow:
            return self.leaf()
        return (self.random.choice(self.settings.functions), self.draw(levels - 1, full), self.draw(levels - 1, full))

    def start(self) -> Expression:
        full = self.random.random() < 0.5
        levels = self.random.randint(*self.settings.start_depth)
        # The root is a function, so every start uses some column or constant pair.
        return (self.random.choice(self.settings.functions), self.draw(levels - 1, full), self.draw(levels - 1, full))

    def place(self, tree: Expression) -> tuple[int, ...]:
        """A random node; functions are drawn nine times as often as leaves."""
        inner = [p for p, node in nodes(tree) if isinstance(node, tuple)]
        outer = [p for p, node in nodes(tree) if not isinstance(node, tuple)]
        return self.random.choice(inner if inner and self.random.random() < 0.9 else outer)

    def cross(self, tree: Expression, donor: Expression) -> Expression:
        return replace(tree, self.place(tree), at(donor, self.place(donor)))

    def hoist(self, tree: Expression) -> Expression:
        place = self.place(tree)
        branch = at(tree, place)
        return replace(tree, place, at(branch, self.place(branch)))

    def points(self, tree: Expression) -> Expression:
        change = self.random.random() < self.settings.point_replace
        if isinstance(tree, tuple):
            head = self.random.choice(self.settings.functions) if change else tree[0]
            return (head, *[self.points(o) for o in tree[1:]])
        return self.leaf() if change else tree

    def child(self, pick) -> Expression:
        s, chance, tree = self.settings, self.random.random(), pick()
        if chance < s.crossover:
            new = self.cross(tree, pick())
        elif chance < s.crossover + s.subtree_mutation:
            new = self.cross(tree, self.start())
        elif chance < s.crossover + s.subtree_mutation + s.hoist_mutation:
            new = self.hoist(tree)
        elif chance < s.crossover + s.subtree_mutation + s.hoist_mutation + s.point_mutation:
            new = self.points(tree)
        else:
            new = tree
        return new if s.max_depth is None or depth(new) <= s.max_depth else tree


def nodes(tree: Expression, place: tuple[int, ...] = ()):
    yield place, tree
    if isinstance(tree, tuple):
        for i, operand in enumerate(tree[1:], 1):
            yield from nodes(operand, (*place, i))


def at(tree: Expression, place: tuple[int, ...]) -> Expression:
    for i in place:
        tree = tree[i]
    return tree


def replace(tree: Expression, place: tuple[int, ...], new: Expression) -> Expression:
    if not place:
        return new
    i, *rest = place
    return (*tree[:i], replace(tree[i], tuple(rest), new), *tree[i + 1 :])


def generations(names: Sequence[str], settings: Search) -> Generator[list[Expression], Mapping[Expression, float], Found]:
    """A search as a generator: it yields the different expressions of a generation and is sent their fitness."""
    breeder = Breeder(list(names), settings)
    people = [breeder.start() for _ in range(settings.population)]
    for generation in range(settings.generations):
        known = yield list(dict.fromkeys(people))
        best = max(people, key=known.__getitem__)
        last = generation + 1 == settings.generations
        if last or (settings.stop_at is not None and known[best] >= settings.stop_at):
            return Found(best, known[best], generation)
        penalized = {t: known[t] - settings.parsimony * length(t) for t in dict.fromkeys(people)}

        def pick() -> Expression:
            entrants = [breeder.random.choice(people) for _ in range(settings.tournament)]
            return max(entrants, key=penalized.__getitem__)

        people = [breeder.child(pick) for _ in range(settings.population)]
    raise ValueError("a search needs at least one generation")


class Searches:
    """Searches by group that go on together. `scored` and `asked` count the expressions that were scored and those that were met."""

    def __init__(self, names: Sequence[str], settings: Mapping[object, Search]) -> None:
        self.forest = forest.Forest(names)
        self.open = {g: generations(names, s) for g, s in settings.items()}
        self.found: dict[object, Found] = {}
        self.memo: dict[object, dict[int, float]] = {g: {} for g in settings}
        self.asked = self.scored = 0

    def run(self, score) -> dict[object, Found]:
        """`score` takes {group: (plan, roots)} and returns {(group, root): fitness}."""
        waiting = {g: next(s) for g, s in self.open.items()}
        while waiting:
            roots = {g: [self.forest.add(t) for t in trees] for g, trees in waiting.items()}
            new = {g: sorted(set(own) - self.memo[g].keys()) for g, own in roots.items()}
            self.asked += sum(map(len, roots.values()))
            self.scored += sum(map(len, new.values()))
            fitness = score({g: (self.forest.needed(own), own) for g, own in new.items() if own})
            for g, own in new.items():
                self.memo[g].update({r: fitness.get((g, r)) or 0.0 for r in own})
            following = {}
            for g, trees in waiting.items():
                try:
                    following[g] = self.open[g].send({t: self.memo[g][r] for t, r in zip(trees, roots[g])})
                except StopIteration as end:
                    self.found[g] = end.value
            waiting = following
        return self.found


def symbolic_search(
    df: DataFrame,
    columns: Mapping[str, Column],
    settings: Search,
    label: str = "y",
    fitness: Fitness = area_fitness,
) -> Found:
    """The fittest expression of the last generation.

    The search ends early once the best fitness reaches `stop_at`. With the
    usual 0.01 that is after the first generation for any useful expression;
    None runs all generations. Rows have no missing values: a null fails the job.
    """
    if not forest.takes(settings.functions):
        return _search_columns(df, columns, settings, label, fitness)
    checked = [F.coalesce(c.cast("double"), F.raise_error(F.lit(f"a value of {n} is missing")).cast("double")) for n, c in columns.items()]
    rows = df.select(F.col(label).alias(label), F.array(*checked).alias("x"))

    def rows_of(batch, group):
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        return x, batch.column(label).to_numpy(zero_copy_only=False)

    def score(plans) -> dict:
        if not plans:
            return {}
        if fitness is area_fitness:
            return {(0, *k): area for k, area in forest.areas(rows, plans, rows_of, lambda g: (), (), label).items()}
        scored = forest.scores(rows, plans, rows_of, lambda g: (), (), label)
        return {(0, r["candidate"]): r["fitness"] for r in fitness(scored, ["candidate"], label, "p").collect()}

    return Searches(list(columns), {0: settings}).run(score)[0]


def _search_columns(df: DataFrame, columns: Mapping[str, Column], settings: Search, label: str, fitness: Fitness) -> Found:
    """The search with functions that work on columns only."""
    steps = generations(list(columns), settings)
    trees, memo = next(steps), {}
    while True:
        new = [t for t in trees if t not in memo]
        if new:
            rated = population_auc(df, new, columns, label, fitness=fitness).collect()
            memo |= {t: 0.0 for t in new} | {new[r["candidate"]]: r["fitness"] or 0.0 for r in rated}
        try:
            trees = steps.send(memo)
        except StopIteration as end:
            return end.value
