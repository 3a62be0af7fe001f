"""Business features: payment and item roll-ups, reconciliation, order features, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertide.functions import tristate


def _count(condition):
    return F.count(F.when(condition, 1))


def rollup_payments(payments: DataFrame) -> DataFrame:
    """One row per order: exact sums, distinct types, maxima and defect counts in one aggregate."""
    cents, types, parts = F.col("payment_cents"), F.col("payment_type"), F.col("payment_installments")
    n = F.count(F.lit(1))
    return payments.groupBy("order_id").agg(
        n.alias("payment_records"), tristate.complete_sum(cents).alias("payment_sum_cents"),
        F.when(F.count(types) == n, F.count_distinct(types)).alias("payment_type_count"),
        F.array_sort(F.collect_set(types)).alias("payment_types"),
        tristate.complete_max(parts).alias("installments_max"), F.max("payment_sequential").alias("sequential_max"),
        (n - F.count(cents)).alias("value_missing_records"), _count(cents == 0).alias("value_zero_records"),
        _count(cents < 0).alias("value_negative_records"), _count(parts == 0).alias("installments_zero_records"),
        _count(types == "not_defined").alias("undefined_type_records"))


def rollup_items(items: DataFrame) -> DataFrame:
    price, freight = F.col("price_cents"), F.col("freight_cents")
    n = F.count(F.lit(1))
    out = items.groupBy("order_id").agg(
        n.alias("item_count"), F.count_distinct("product_id").alias("product_count"),
        F.count_distinct("seller_id").alias("seller_count"), tristate.complete_sum(price).alias("price_sum_cents"),
        tristate.complete_sum(freight).alias("freight_sum_cents"), tristate.complete_max(price).alias("price_max_cents"),
        (n - F.count(price)).alias("missing_price_records"), (n - F.count(freight)).alias("missing_freight_records"),
        _count((price < 0) | (freight < 0)).alias("negative_amount_records"))
    return out.withColumns({
        "items_plus_freight_cents": F.col("price_sum_cents") + F.col("freight_sum_cents"),
        "price_mean_cents": F.col("price_sum_cents") / F.col("item_count"),
        "freight_ratio": F.when(F.col("price_sum_cents") > 0, F.col("freight_sum_cents") / F.col("price_sum_cents"))})


def payment_reconciliation(df: DataFrame) -> DataFrame:
    """Payment minus (items + freight) in cents and its status."""
    difference = F.col("payment_sum_cents") - F.col("items_plus_freight_cents")
    return df.withColumn("payment_difference_cents", difference).withColumn(
        "payment_reconciliation", tristate.first_match([
            ("not_assessable", F.col("payment_difference_cents").isNull()),
            ("matched", F.col("payment_difference_cents") == 0)], "difference"))


def order_features(orders: DataFrame, payments: DataFrame, items: DataFrame, history: DataFrame) -> DataFrame:
    """One row per order; counts are zero-filled, sums of absent children stay null."""
    counts = ["payment_records", "item_count", "product_count", "seller_count"]
    joined = (orders.join(rollup_payments(payments), "order_id", "left").join(rollup_items(items), "order_id", "left")
              .join(history.select("order_id", "prior_orders", "days_since_prior_purchase"), "order_id", "left"))
    filled = joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})
    complete = (F.col("payment_records") > 0) & F.col("payment_sum_cents").isNotNull()
    return payment_reconciliation(filled).withColumns({
        "payment_values_complete": complete,
        "payment_values_nonnegative": complete & F.coalesce(F.col("value_negative_records") == 0, F.lit(False)),
        "item_values_complete": (F.col("item_count") > 0) & F.col("items_plus_freight_cents").isNotNull()})


def source_support(pairs: DataFrame, zips: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per split and seller: linked orders, orders with a usable review, orders with both ZIPs supported.

    pairs: (order_id, seller_id, split, customer_zip, seller_zip); zips: (zip, valid);
    reviews: (order_id, usable).
    """
    valid = zips.where("valid").select("zip").distinct()
    reviewed = reviews.where("usable").select("order_id").distinct().withColumn("reviewed", F.lit(True))
    marked = (pairs.join(valid.select(F.col("zip").alias("customer_zip"), F.lit(True).alias("c_ok")), "customer_zip", "left")
              .join(valid.select(F.col("zip").alias("seller_zip"), F.lit(True).alias("s_ok")), "seller_zip", "left")
              .join(reviewed, "order_id", "left"))
    return marked.groupBy("split", "seller_id").agg(
        F.count(F.lit(1)).alias("linked_orders"), _count(F.col("reviewed")).alias("orders_with_usable_review"),
        _count(F.col("c_ok") & F.col("s_ok")).alias("orders_with_both_zips"))


def feature_group_coverage(features: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """Supported orders and denominator per feature group from a single aggregate."""
    counts = features.agg(F.count(F.lit(1)).alias("orders"), *[_count(c).alias(f"g{i}") for i, c in enumerate(groups.values())])
    pieces = ", ".join(f"'{name}', g{i}" for i, name in enumerate(groups))
    return counts.select("orders", F.expr(f"stack({len(groups)}, {pieces}) AS (feature_group, supported_orders)"))
