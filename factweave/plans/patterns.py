"""Graph patterns as DataFrame plans: each pattern is a scan of the triples, and shared variables become equi-joins.

A variable is written "?name"; anything else is a constant. Catalyst orders the joins, prunes the columns and pushes the constants to the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Pattern = tuple[str, str, str]


def scan(triples: DataFrame, pattern: Pattern) -> DataFrame:
    """The solutions of one pattern, a column for each variable."""
    names: dict[str, str] = {}
    for column, term in zip("spo", pattern, strict=True):
        if not term.startswith("?"):
            triples = triples.where(F.col(column) == term)
        elif term[1:] in names.values():
            first = next(c for c, n in names.items() if n == term[1:])
            triples = triples.where(F.col(column) == F.col(first))
        else:
            names[column] = term[1:]
    return triples.select(*[F.col(c).alias(n) for c, n in names.items()])


def together(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """A join on the shared variables; patterns that share none would multiply, and are refused."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError(f"no variable in common: {left.columns} and {right.columns}")
    return left.join(right, shared, how)


def match(triples: DataFrame, *patterns: Pattern) -> DataFrame:
    """All patterns at once."""
    return reduce(together, (scan(triples, p) for p in patterns))


def optional(left: DataFrame, triples: DataFrame, *patterns: Pattern) -> DataFrame:
    """left, with the group's variables where the whole group matches, else null."""
    return together(left, match(triples, *patterns), "left")


def without(left: DataFrame, triples: DataFrame, *patterns: Pattern) -> DataFrame:
    """left, without the rows for which the group matches."""
    return together(left, match(triples, *patterns), "left_anti")


def either(*solutions: DataFrame) -> DataFrame:
    """The bag union; variables that a side lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), solutions)
