"""Ordered rule tables compiled to one CASE expression: the first rule that holds gives the value.

A rule is (value, {column: pattern, ...}); all its patterns must match. Patterns stay in the part of the syntax that
Java and RE2 read alike. Users append rules of their own; nothing runs row by row in Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, dict[str, str]]


def matches(patterns: dict[str, str]) -> Column:
    """True where every column matches its pattern; null columns match nothing."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(c).rlike(p), F.lit(False)) for c, p in patterns.items()])


def first_rule(rules: list[Rule], otherwise: str | None = None) -> Column:
    """The value of the first rule that matches, or ``otherwise``."""
    case = None
    for value, patterns in rules:
        case = F.when(matches(patterns), value) if case is None else case.when(matches(patterns), value)
    return F.lit(otherwise) if case is None else case.otherwise(F.lit(otherwise))


def first_rule_sql(rules: list[Rule], otherwise: str | None = None) -> str:
    """The same table as SQL text for an engine with ``regexp_matches``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    arms = " ".join("WHEN " + " AND ".join(f"coalesce(regexp_matches({c}, {quote(p)}), false)" for c, p in ps.items()) + f" THEN {quote(v)}" for v, ps in rules)
    return f"CASE {arms} ELSE {quote(otherwise) if otherwise is not None else 'NULL'} END"
