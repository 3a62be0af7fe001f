"""Delivery performance: visibility, promise difference, stage rows and rate summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertide.functions import clock, tristate
from ordertide.operators import ordered
from ordertide.sources.star_schema import STAGES, TIMES


def promise_delta(delivered: Column, estimated: Column) -> Column:
    """Delivered date minus estimated date in calendar days."""
    return clock.calendar_days(estimated, delivered)


def timing_state(delta: Column) -> Column:
    return tristate.first_match([("unknown", delta.isNull()), ("early", delta < 0), ("on_date", delta == 0)], "late")


def order_performance(orders: DataFrame, bounds: list[tuple[str, str]]) -> DataFrame:
    """Orders with their partition, masked milestones, conflicts and delivery state."""
    cut = orders.withColumns({
        "split": clock.split_of(F.col("purchased_at"), bounds), "cutoff": clock.cutoff_of(F.col("purchased_at"), bounds),
        "status_delivery_conflict": (F.col("order_status") == "delivered") != F.col("delivered_at").isNotNull(),
        "purchase_month": clock.month(F.col("purchased_at"))})
    total = lambda parts: reduce(lambda a, b: a + b, [p.cast("long") for p in parts])
    at_or_after = [tristate.known_true(F.col(t) >= F.col("cutoff")) for t in TIMES]
    masked = cut.withColumns({
        "source_missing_milestones": total([F.col(t).isNull() for t in TIMES]),
        "post_cutoff_milestones": total(at_or_after),
        "delivery_visibility": tristate.first_match([
            ("source_missing", F.col("delivered_at").isNull()),
            ("at_or_after_cutoff", F.col("delivered_at") >= F.col("cutoff"))], "visible"),
    }).withColumns({t: F.when(F.col(t) < F.col("cutoff"), F.col(t)) for t in TIMES})
    inversions = total([tristate.known_true(F.col(TIMES[j]) < F.col(TIMES[i]))
                        for i in range(4) for j in range(i + 1, 4)])
    delta = F.col("promise_delta")
    return masked.withColumns({
        "visible_inversions": inversions, "promise_delta": promise_delta(F.col("delivered_at"), F.col("estimated_at")),
        "seller_attribution_scope": F.when(F.col("seller_count") == 1, "single_seller_order").otherwise("multi_seller_order"),
    }).withColumn("quality_conflict", (F.col("visible_inversions") > 0) | F.col("status_delivery_conflict")
                  | tristate.known_true(F.to_date("estimated_at") < F.to_date("purchased_at"))).withColumns({
        "days_early": F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0))),
        "days_late": F.when(delta.isNotNull(), F.greatest(delta, F.lit(0))),
        "performance_eligible": delta.isNotNull() & ~F.col("quality_conflict"),
        "performance_state": F.when(F.col("quality_conflict"), "excluded_source_conflict").otherwise(timing_state(delta))})


def stage_rows(orders: DataFrame) -> DataFrame:
    """Long (order, stage) rows with integer-second durations, state and eligibility."""
    pieces = ", ".join(f"'{s}', {a}, {b}" for s, a, b in STAGES)
    keep = [c for c in orders.columns if c not in TIMES]
    long = orders.select(*keep, F.expr(f"stack({len(STAGES)}, {pieces}) AS (stage, started_at, ended_at)"))
    duration = clock.seconds_between(F.col("started_at"), F.col("ended_at"))
    return long.withColumn("duration_s", duration).withColumns({
        "duration_state": tristate.first_match([
            ("endpoint_not_visible", F.col("duration_s").isNull()), ("negative_recorded_duration", F.col("duration_s") < 0),
            ("zero_recorded_duration", F.col("duration_s") == 0)], "positive_observed"),
        "duration_eligible": F.coalesce(F.col("duration_s") >= 0, F.lit(False)) & ~F.col("quality_conflict")})


def delivery_rates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per delivery state, rates over comparable orders, exact medians of the day counts."""
    state, eligible = F.col("performance_state"), F.col("performance_eligible")
    count = lambda c: F.count(F.when(c, 1))
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("orders"), count(eligible).alias("comparable_orders"),
        count(F.col("seller_count") == 1).alias("single_seller_orders"),
        count(F.col("seller_count") > 1).alias("multi_seller_orders"),
        *[count(state == s).alias(f"{s}_orders") for s in ["early", "on_date", "late", "unknown", "excluded_source_conflict"]])
    rated = base.withColumns({f"{s}_rate": tristate.ratio(F.col(f"{s}_orders"), F.col("comparable_orders"))
                              for s in ["early", "on_date", "late"]})
    for name, condition, value in [("median_days_early", state == "early", "days_early"),
                                   ("median_days_late", state == "late", "days_late"),
                                   ("median_promise_delta", eligible, "promise_delta")]:
        part = ordered.quantiles(df.where(condition), keys, value, {name: .5}, width=ordered.UNITS)
        rated = ordered.join_groups(rated, part, keys)
    return rated


def grouped_rates(df: DataFrame, groupings: list[list[str]]) -> DataFrame:
    """Rates over several groupings in one grouping-sets aggregate (absent keys are null)."""
    names = sorted({k for g in groupings for k in g})
    state = F.col("performance_state")
    count = lambda c: F.count(F.when(c, 1))
    return df.groupingSets([[F.col(k) for k in g] for g in groupings], *[F.col(n) for n in names]).agg(
        F.grouping_id().alias("grouping"), F.count(F.lit(1)).alias("orders"),
        count(F.col("performance_eligible")).alias("comparable_orders"), count(state == "late").alias("late_orders"),
    ).withColumn("late_rate", tristate.ratio(F.col("late_orders"), F.col("comparable_orders")))
