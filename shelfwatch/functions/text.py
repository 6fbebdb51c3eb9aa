"""Small text helpers shared by the column functions."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(text: Column, words: list[str]) -> Column:
    """True when text contains any of the words. Plain byte search, no regex engine.

    A word that contains another one adds nothing and is not searched for.
    """
    needed = [w for w in words if not any(o != w and o in w for o in words)]
    return reduce(lambda a, b: a | b, [text.contains(w) for w in needed])


def first_case(branches: list[tuple[Column, Column]], default: Column) -> Column:
    """Ordered CASE: the first true condition decides."""
    if not branches:
        return default
    cond, value = branches[0]
    case = F.when(cond, value)
    for cond, value in branches[1:]:
        case = case.when(cond, value)
    return case.otherwise(default)


def alternation(regexes: list[str], ignore_case: bool = False) -> str:
    """One regex that matches where any of the given ones does."""
    body = "|".join(f"(?:{r})" for r in regexes)
    return f"(?i){body}" if ignore_case else body
