"""Leakage-safe history: everything strictly before the purchase of the row it describes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertide.functions import clock, tristate
from ordertide.operators import ordered

DAYS_30 = 30 * clock.DAY_SECONDS


def customer_prior(orders: DataFrame) -> DataFrame:
    """(order_id, customer_id, as_of_s) -> strictly prior purchases and days since the last one."""
    out = ordered.strictly_prior(orders, orders, ["customer_id"], "as_of_s",
                                 {"prior_orders": F.lit(1)}, {"last_purchase_s": F.col("as_of_s")})
    return out.select("order_id", "customer_id", F.coalesce("prior_orders", F.lit(0)).alias("prior_orders"),
                      ((F.col("as_of_s") - F.col("last_purchase_s")) / clock.DAY_SECONDS).alias("days_since_prior_purchase"))


def seller_prior_purchases(pairs: DataFrame) -> DataFrame:
    """Pairs (order_id, seller_id, seller_count, as_of_s) with their prior purchase history."""
    single = (F.col("seller_count") == 1).cast("long")
    out = ordered.strictly_prior(pairs, pairs, ["seller_id"], "as_of_s",
                                 {"prior_orders": F.lit(1), "prior_single_seller_orders": single},
                                 {"latest_prior_purchase_s": F.col("as_of_s")}, windows={"_30d": DAYS_30})
    return out.select(
        "order_id", "seller_id", "as_of_s", "prior_orders", F.col("prior_orders_30d"), "prior_single_seller_orders",
        (F.col("prior_orders") - F.col("prior_single_seller_orders")).alias("prior_multi_seller_orders"),
        "latest_prior_purchase_s",
        ((F.col("as_of_s") - F.col("latest_prior_purchase_s")) / clock.DAY_SECONDS).alias("days_since_last_prior_purchase"))


def seller_prior_counts(pairs: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """Pairs with the counts of earlier purchases and, of ``outcomes`` (see seller_prior_outcomes), of earlier completed orders: one running sum."""
    single = (F.col("seller_count") == 1).cast("long")
    events = pairs.select("seller_id", "as_of_s", F.lit(1).alias("bought"), single.alias("alone"), F.lit(0).alias("done"))
    names = {"prior_orders": F.col("bought"), "prior_single_seller_orders": F.col("alone")}
    if outcomes is not None:
        names["prior_completed_orders"] = F.col("done")
        events = events.unionByName(outcomes.select("seller_id", F.col("delivered_s").alias("as_of_s"), F.lit(0).alias("bought"),
                                                    F.lit(0).cast("long").alias("alone"), F.lit(1).alias("done")))
    out = ordered.strictly_prior(pairs, events, ["seller_id"], "as_of_s", names)
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in names})


def seller_history_seen(pairs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Pairs with prior_orders and prior_completed_orders as 0 or 1: whether the seller's first purchase, and first of ``outcomes``, lie before as_of_s."""
    first = pairs.groupBy("seller_id").agg(F.min("as_of_s").alias("_bought")).join(
        outcomes.groupBy("seller_id").agg(F.min("delivered_s").alias("_done")), "seller_id", "left")
    seen = lambda c: F.coalesce((F.col(c) < F.col("as_of_s")).cast("int"), F.lit(0))
    return pairs.join(first, "seller_id", "left").withColumns({"prior_orders": seen("_bought"), "prior_completed_orders": seen("_done")}).drop("_bought", "_done")


def seller_prior_outcomes(queries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes (seller_id, delivered_s, comparable, late) visible before each query's as_of_s.

    ``outcomes`` holds completed single-seller orders only; delivery after purchase makes
    delivery < as-of imply purchase < as-of.
    """
    events = outcomes.withColumn("as_of_s", F.col("delivered_s"))
    out = ordered.strictly_prior(queries, events, ["seller_id"], "as_of_s", {
        "prior_completed_orders": F.lit(1), "prior_comparable_orders": F.col("comparable").cast("long"),
        "prior_late_orders": (F.col("comparable") & F.col("late")).cast("long")},
        {"latest_history_delivery_s": F.col("as_of_s")})
    filled = {c: F.coalesce(F.col(c), F.lit(0)) for c in
              ["prior_completed_orders", "prior_comparable_orders", "prior_late_orders"]}
    return out.withColumns(filled).withColumn(
        "prior_late_fraction", tristate.ratio(F.col("prior_late_orders"), F.col("prior_comparable_orders")))


def review_changes(reviews: DataFrame) -> DataFrame:
    """Per (order, seller, answer time): what the order's latest clean review adds and takes back.

    The answer at a time counts when all scores at that time agree; a conflicting time takes the
    earlier answer back and adds nothing until the next clean one.
    """
    at_time = reviews.groupBy("order_id", "seller_id", "answered_s").agg(
        F.min("score").alias("lo"), F.max("score").alias("hi"))
    state = F.struct("answered_s", "lo", "hi")
    steps = ordered.running(at_time, ["order_id", "seller_id"], "answered_s", maxima={"last": state}, width=ordered.WEEK)
    now, before = F.col("last"), F.col("last_before")
    clean_now = (now["lo"] == now["hi"]).cast("long")
    clean_before = F.coalesce((before["lo"] == before["hi"]).cast("long"), F.lit(0))
    return steps.select(
        "seller_id", "answered_s", (clean_now - clean_before).alias("reviewed"),
        (clean_now * now["lo"] - clean_before * F.coalesce(before["lo"], F.lit(0))).alias("score_sum"),
        *[(clean_now * (now["lo"] == k).cast("long")
           - clean_before * F.coalesce((before["lo"] == k).cast("long"), F.lit(0))).alias(f"score_{k}")
          for k in range(1, 6)],
        ((1 - clean_now) - F.when(before.isNull(), 0).otherwise(1 - clean_before)).alias("ambiguous"))


def seller_prior_reviews(queries: DataFrame, reviews: DataFrame) -> DataFrame:
    """Latest visible review per prior order before as_of_s; conflicting latest answers are withheld."""
    names = ["reviewed", "score_sum", "ambiguous", *[f"score_{k}" for k in range(1, 6)]]
    events = review_changes(reviews).withColumnRenamed("answered_s", "as_of_s")
    out = ordered.strictly_prior(queries, events, ["seller_id"], "as_of_s", {n: F.col(n) for n in names})
    out = out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in names})
    return out.withColumn("mean_score", tristate.ratio(F.col("score_sum"), F.col("reviewed")))


def history_route(df: DataFrame) -> DataFrame:
    """Which history an order may use: multi-seller outcomes are never attributed to one seller."""
    has_outcomes = (F.col("prior_completed_orders") > 0) | (F.col("prior_reviewed_orders") > 0)
    return df.withColumn("history_route", tristate.first_match([
        ("multi_seller_use_pair_context", F.col("seller_count") > 1),
        ("single_seller_with_prior_outcomes", has_outcomes),
        ("single_seller_purchase_history_only", F.col("prior_orders") > 0)], "single_seller_no_prior_history"))


def support_bin(count: Column) -> Column:
    return tristate.first_match([("0", count == 0), ("1-4", count <= 4), ("5-19", count <= 19), ("20-49", count <= 49)], "50+")


def history_coverage(pairs: DataFrame, measures: list[str], keys: list[str]) -> DataFrame:
    """Pairs per support bin of each history measure, every bin present."""
    pieces = ", ".join(f"'{m}', {m}" for m in measures)
    long = pairs.select(*keys, F.expr(f"stack({len(measures)}, {pieces}) AS (history_measure, n)"))
    wide = long.groupBy(*keys, "history_measure").agg(*[F.count(F.when(support_bin(F.col("n")) == b, 1)).alias(b)
                                                        for b in ["0", "1-4", "5-19", "20-49", "50+"]])
    bins = ", ".join(f"'{b}', `{b}`" for b in ["0", "1-4", "5-19", "20-49", "50+"])
    return wide.select(*keys, "history_measure", F.expr(f"stack(5, {bins}) AS (support_bin, pairs)"))
