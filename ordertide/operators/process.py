"""Event-log analytics: activity times, variants, directly-follows, fitness, durations."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ordertide.functions import tristate
from ordertide.operators import ordered


def activity_times(log: DataFrame, activities: list[str], names: list[str] | None = None) -> DataFrame:
    """One row per case with the first time of each activity (a pivot with known values)."""
    names = names or activities
    return log.groupBy("case_id").agg(*[F.min(F.when(F.col("activity") == a, F.col("ts"))).alias(n)
                                        for a, n in zip(activities, names)])


def trace_variant(log: DataFrame, separator: str = " -> ") -> DataFrame:
    """Ordered activity string per case; equal times are ordered by activity rank.

    The log holds one row per (case, activity), so a case's list is bounded by the activity count.
    """
    events = F.array_sort(F.collect_list(F.struct("ts", "rank", "activity")))
    return log.groupBy("case_id").agg(events.alias("_events")).select(
        "case_id", F.array_join(F.transform("_events", lambda e: e["activity"]), separator).alias("variant"),
        F.size("_events").cast("long").alias("event_count"),
        F.transform("_events", lambda e: e["rank"]).alias("ranks"),
        (F.size(F.array_distinct(F.transform("_events", lambda e: e["ts"]))) < F.size("_events")).alias("has_equal_times"))


def variant_statistics(variants: DataFrame) -> DataFrame:
    """Cases and share per variant."""
    counts = variants.groupBy("variant").agg(F.count(F.lit(1)).alias("case_count"),
                                             F.max("event_count").alias("event_count"),
                                             F.max("fitness").alias("fitness"))
    total = counts.agg(F.sum("case_count").alias("_all"))
    return ordered.attach_one_row(counts, total).select(
        "variant", "event_count", "fitness", "case_count", (100.0 * F.col("case_count") / F.col("_all")).alias("case_percent"))


def directly_follows(log: DataFrame, keys: list[str] | None = None, skip_ties: bool = True) -> DataFrame:
    """Edge counts between consecutive activities; cases with equal times can be left out."""
    keys = keys or []
    if skip_ties:
        tied = log.groupBy("case_id", "ts").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        log = log.join(tied.select("case_id").distinct(), "case_id", "left_anti")
    w = W.partitionBy("case_id").orderBy("ts", "rank")
    edges = log.select(*keys, F.col("activity").alias("source"), F.lead("activity").over(w).alias("target"))
    return edges.where("target IS NOT NULL").groupBy(*keys, "source", "target").agg(F.count(F.lit(1)).alias("edge_count"))


def equal_time_events(log: DataFrame) -> DataFrame:
    """Events that share their timestamp with another event of the same case."""
    tied = log.groupBy("case_id", "ts").agg(F.count(F.lit(1)).alias("same_time_events")).where("same_time_events > 1")
    return log.join(tied, ["case_id", "ts"])


def trace_fitness(ranks: Column, length: int) -> Column:
    """Token-replay fitness of an ordered rank array on the sequential net of ``length`` activities.

    Replay folds over the array: place i holds tokens as bit i of the marking. A transition consumes
    place r and produces place r+1; an absent token is counted missing. The final place is consumed
    at the end; whatever stays is remaining.
    """
    start = F.struct(F.lit(1).cast("long").alias("m"), F.lit(0).cast("long").alias("missing"))

    def fire(state, rank):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), rank.cast("int"))
        enabled = state["m"].bitwiseAND(bit) != 0
        consumed = F.when(enabled, state["m"].bitwiseXOR(bit)).otherwise(state["m"])
        produced = consumed.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (rank + 1).cast("int")))
        return F.struct(produced.alias("m"), (state["missing"] + F.when(enabled, 0).otherwise(1)).alias("missing"))

    def finish(state):
        last = F.lit(1 << length).cast("long")
        reached = state["m"].bitwiseAND(last) != 0
        left = F.when(reached, state["m"].bitwiseXOR(last)).otherwise(state["m"])
        n = (F.size(ranks) + 1).cast("double")
        missing = state["missing"] + F.when(reached, 0).otherwise(1)
        return 0.5 * (1 - missing / n) + 0.5 * (1 - F.bit_count(left) / n)

    return F.aggregate(ranks, start, fire, finish)


def fitness_band(fitness: Column) -> Column:
    # Names and edges of the bands.
    return tristate.first_match([("1.0", fitness >= 1.0), ("0.8-<1.0", fitness >= 0.8), ("0.5-<0.8", fitness >= 0.5)], "<0.5")


def conformance(log: DataFrame, activities: list[str]) -> DataFrame:
    """Per case: variant, fitness, band, missing activities, reversed pairs."""
    v = trace_variant(log)
    n = len(activities)
    ranks = F.col("ranks")
    # Adjacent activities of the reference process that are both present, the later one before the earlier one.
    at = [F.array_position(ranks, k) for k in range(n)]
    reversed_flag = functools.reduce(lambda a, b: a | b, [(at[k + 1] > 0) & (at[k + 1] < at[k]) for k in range(n - 1)], F.lit(False))
    fitness = trace_fitness(ranks, n)
    return v.select("case_id", "variant", "event_count", "has_equal_times", fitness.alias("fitness"),
                    fitness_band(fitness).alias("fitness_band"),
                    (F.lit(n) - F.size(F.array_distinct(ranks))).cast("long").alias("missing_event_count"),
                    reversed_flag.alias("reversed_flag"))


def lowest(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Ordered head: a per-partition top-n merged on the driver side of the plan, n is the report size."""
    return df.orderBy(*order).limit(n)


def duration_summary(df: DataFrame, keys: list[str], value: str, eligible: Column | None = None,
                     scale: float = 86400.0, width: float = ordered.UNITS) -> DataFrame:
    """Counts, mean, exact quantiles and extremes of an integer duration per group, in days.

    ``eligible`` restricts the statistics; unknown, zero and negative rows are counted over all rows.
    """
    ok = F.col(value).isNotNull() if eligible is None else eligible
    used = F.when(ok, F.col(value))
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count(used).alias("eligible_rows"),
        F.count(F.when(F.col(value).isNull(), 1)).alias("unknown_rows"),
        F.count(F.when(F.col(value) < 0, 1)).alias("negative_rows"),
        F.count(F.when(F.col(value) == 0, 1)).alias("zero_rows"),
        (F.avg(used) / scale).alias("mean_days"), (F.min(used) / scale).alias("min_days"),
        (F.max(used) / scale).alias("max_days"))
    points = ordered.quantiles(df.where(ok), keys, value, {
        "p05_days": .05, "q25_days": .25, "median_days": .5, "q75_days": .75, "p95_days": .95},
        scale=scale, width=width)
    return ordered.join_groups(counts, points, keys)
