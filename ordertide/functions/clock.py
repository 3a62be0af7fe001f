"""Time expressions on source wall-clock timestamps (session zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86400


def seconds(ts: Column) -> Column:
    """Epoch seconds of a wall-clock timestamp."""
    return F.unix_seconds(ts.cast("timestamp"))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    """Signed whole seconds; null if either endpoint is missing."""
    return seconds(end) - seconds(start)


def days_between(start: Column, end: Column) -> Column:
    """Signed duration in days at microsecond precision."""
    return (micros(end) - micros(start)) / F.lit(86400000000.0)


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def calendar_days(start: Column, end: Column) -> Column:
    """Calendar-date difference: never compares a timestamp with midnight."""
    return F.datediff(F.to_date(end), F.to_date(start)).cast("long")


def half_month(ts: Column) -> Column:
    return F.concat(month(ts), F.when(F.dayofmonth(ts) <= 15, "-H1").otherwise("-H2"))


def iso_week_start(ts: Column) -> Column:
    return F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd")


def month_contains(ts: Column, boundary: Column) -> Column:
    return month(ts) == month(boundary)


def split_of(ts: Column, bounds: list[tuple[str, str]]) -> Column:
    """Half-open partitions: first (name, exclusive upper bound) whose bound lies after ts."""
    chain = None
    for name, upper in bounds:
        condition = ts < F.lit(upper).cast("timestamp_ntz")
        chain = F.when(condition, name) if chain is None else chain.when(condition, name)
    return chain


def cutoff_of(ts: Column, bounds: list[tuple[str, str]]) -> Column:
    """Exclusive observation cutoff of the partition that ts belongs to."""
    chain = None
    for _, upper in bounds:
        edge = F.lit(upper).cast("timestamp_ntz")
        chain = F.when(ts < edge, edge) if chain is None else chain.when(ts < edge, edge)
    return chain
