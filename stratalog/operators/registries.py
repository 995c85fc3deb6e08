"""Extension points: named functions that callers add to, and queries built from what is registered."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Registry:
    """Named functions in the order of their registration; a name that is registered again is replaced in its place."""

    def __init__(self) -> None:
        self._entries: dict[str, Callable] = {}

    def register(self, name: str, entry: Callable) -> Callable:
        self._entries[name] = entry
        return entry

    def __getitem__(self, name: str) -> Callable:
        if name not in self._entries:
            raise KeyError(f"{name!r} is not registered; there are {', '.join(self._entries) or 'none'}")
        return self._entries[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._entries)

    def __len__(self) -> int:
        return len(self._entries)


#: DataFrame -> DataFrame by kind of artifact; supplements add rows to what the analyzer of a kind gives.
ANALYZERS, SUPPLEMENTS = Registry(), Registry()
#: Row -> label, or null where a classifier can't tell.
CLASSIFIERS = Registry()
#: Row -> score of a dimension from 0 to 100.
SCORERS = Registry()
#: Row -> the identifier of a package, by ecosystem.
RESOLVERS = Registry()


def analyze(rows: DataFrame, kind: str) -> DataFrame:
    """What the analyzer of a kind gives, and what all supplements add to it; all have the same columns."""
    found = ANALYZERS[kind](rows)
    for name in SUPPLEMENTS:
        found = found.unionByName(SUPPLEMENTS[name](rows))
    return found


def first_label(classifiers: Registry, names: Sequence[str] | None = None, otherwise: str = "unknown") -> Column:
    """The label of the first classifier that can tell."""
    return F.coalesce(*[classifiers[n]() for n in (names or list(classifiers))], F.lit(otherwise))


def scorecard(scorers: Registry) -> Column:
    """(dimension, score) of every scorer, in order; a score that is null counts as 0."""
    bounded = lambda c: F.least(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)), F.lit(100)).cast("int")
    return F.array(*[F.struct(F.lit(n).alias("dimension"), bounded(scorers[n]()).alias("score")) for n in scorers])


def package_id(resolvers: Registry, ecosystem: Column, otherwise: Column) -> Column:
    """The identifier that the resolver of the row's ecosystem gives."""
    out = None
    for name in resolvers:
        out = F.when(ecosystem == name, resolvers[name]()) if out is None else out.when(ecosystem == name, resolvers[name]())
    return otherwise if out is None else F.coalesce(out, otherwise)
