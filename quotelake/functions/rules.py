"""Ordered rules as data: the first pattern that matches gives the label."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(text: Column, rules: Iterable[tuple[str, str]], default: Column | None = None) -> Column:
    """The label of the first (label, pattern) that matches: one CASE, in the rules' order. Null text gives the default."""
    chain = None
    for label, pattern in rules:
        test = text.rlike(pattern)
        chain = F.when(test, F.lit(label)) if chain is None else chain.when(test, F.lit(label))
    if chain is None:
        return F.lit(None).cast("string") if default is None else default
    return chain if default is None else chain.otherwise(default)


def first_true(tests: Iterable[tuple[str, Column]]) -> Column:
    """The name of the first test that holds; null if none does."""
    return F.coalesce(*(F.when(test, F.lit(name)) for name, test in tests))


def all_matches(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """The labels of all rules that match, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(label)) for label, p in rules))))


def most_specific(found: Column, chains: Sequence[Sequence[str]], exclusive: Sequence[str]) -> Column:
    """One label of an array: of each chain (general to special) the most special stays; two that exclude each other give null."""
    for chain in chains:
        for i, general in enumerate(chain[:-1]):
            special = reduce(lambda a, b: a | b, (F.array_contains(found, s) for s in chain[i + 1 :]))
            found = F.when(special, F.array_remove(found, general)).otherwise(found)
    clash = F.size(F.array_intersect(found, F.array(*map(F.lit, exclusive)))) > 1 if exclusive else F.lit(False)
    return F.when(clash | (F.size(found) == 0), F.lit(None).cast("string")).otherwise(found[0])


def nearest_level(path: Column, rules: Iterable[tuple[str, str]], separator: str = " > ") -> Column:
    """The first label found from the innermost level of a path outwards."""
    rules = list(rules)
    levels = F.reverse(F.split(path, separator))
    return F.get(F.filter(F.transform(levels, lambda x: first_match(x, rules)), lambda x: x.isNotNull()), F.lit(0))


def score(text: Column, points: Iterable[tuple[str, int]], how: str = "sum") -> Column:
    """Points of all patterns that match, summed, or the largest of them (``max``; 0 if none)."""
    terms = [F.when(text.rlike(p), F.lit(n)).otherwise(F.lit(0)) for p, n in points]
    return reduce(lambda a, b: a + b, terms) if how == "sum" else F.greatest(*terms) if len(terms) > 1 else terms[0]


def reasons(*checks: tuple[str, Column]) -> Column:
    """The names of the checks that hold, as an array in the order given."""
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in checks)))


def both(conditions: Iterable[Column | None]) -> Column:
    """All conditions that are given; none given keeps every row."""
    return reduce(lambda a, b: a & b, (c for c in conditions if c is not None), F.lit(True))
