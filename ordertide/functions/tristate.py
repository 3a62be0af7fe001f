"""Three-valued and completeness-aware aggregate builders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_true(flag: Column) -> Column:
    """Rows where the flag is known and true."""
    return F.count(F.when(flag, F.lit(1)))


def complete_sum(value: Column) -> Column:
    """Group sum that is null as soon as one member is null."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def complete_max(value: Column) -> Column:
    return F.when(F.count(value) == F.count(F.lit(1)), F.max(value))


def any_known(flag: Column) -> Column:
    """True if any known true; false only when every member is known false; otherwise null."""
    return F.when(count_true(flag) > 0, F.lit(True)).when(
        F.count(flag) == F.count(F.lit(1)), F.lit(False))


def any_of(*flags: Column) -> Column:
    """Row-wise form of any_known."""
    seen = reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in flags])
    known = reduce(lambda a, b: a & b, [f.isNotNull() for f in flags])
    return F.when(seen, F.lit(True)).when(known, F.lit(False))


def known_true(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def reasons(pairs: list[tuple[str, Column]]) -> Column:
    """Array of the names whose condition is true, in declared order."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in pairs]), lambda x: x.isNotNull())


def first_match(pairs: list[tuple[str, Column]], default: str | None = None) -> Column:
    """Name of the first true condition: exclusive groups by precedence."""
    chain = None
    for name, condition in pairs:
        value = F.lit(name)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain.otherwise(F.lit(default)) if default is not None else chain


def ratio(part: Column, whole: Column) -> Column:
    """Undefined ratios stay null."""
    return F.when(whole != 0, part / whole)
