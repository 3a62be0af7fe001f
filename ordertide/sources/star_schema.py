"""The order model read off the star-schema tables.

Orders get four milestones: purchase = order date; approval = order date plus (priority digit - 1)
days; carrier = first ship date of any line; delivery = last ship date of a line that was not
returned. Items, payments, products, parties, coordinates, reviews and the activity log follow.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordertide.functions import clock

TIMES = ["purchased_at", "approved_at", "carrier_at", "delivered_at"]
STAGES = [("approval", "purchased_at", "approved_at"), ("handling", "approved_at", "carrier_at"),
          ("transport", "carrier_at", "delivered_at")]
# The four order milestones of the process, in reference order.
ACTIVITIES = ["Purchased", "Approved", "Handed to Carrier", "Delivered"]
FUNNEL = ["signup", "view", "click", "purchase"]
SPLIT_BOUNDS = [("train", "1999-01-01"), ("validation", "2000-06-01"), ("test", "2002-01-01")]


def cents(value: Column) -> Column:
    return F.round(value * 100).cast("long")


class Shop:
    """Lazy DataFrames over ``{sf_dir}/*.parquet``; nothing runs until a query is executed."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def orders(self) -> DataFrame:
        return self._placed.join(self._shipped, "order_id", "left")

    @cached_property
    def _shipped(self) -> DataFrame:
        return self.table("lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(
            F.min("l_shipdate").alias("carrier_at"),
            F.max(F.when(F.col("l_returnflag") != "R", F.col("l_shipdate"))).alias("delivered_at"))

    @cached_property
    def _placed(self) -> DataFrame:
        digit = F.substring("o_orderpriority", 1, 1).cast("int")
        status = (F.when(F.col("o_orderstatus") == "F", "delivered")
                  .when(F.col("o_orderstatus") == "O", "shipped")
                  .when(digit == 5, "canceled").otherwise("processing"))
        return self.table("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
            status.alias("order_status"), F.col("o_orderdate").alias("purchased_at"),
            (F.col("o_orderdate") + F.make_dt_interval(digit - 1)).alias("approved_at"),
            (F.col("o_orderdate") + F.make_dt_interval(F.lit(30))).alias("estimated_at"),
            cents(F.col("o_totalprice")).alias("total_cents"),
            F.col("o_orderpriority").alias("priority"))

    @cached_property
    def items(self) -> DataFrame:
        price = cents(F.col("l_extendedprice"))
        tax = F.round(F.col("l_tax") * 100).cast("long")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("item_no"),
            F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"),
            price.alias("price_cents"), F.floor(price * tax / 100).cast("long").alias("freight_cents"),
            F.col("l_shipdate").alias("shipping_limit_at"))

    @cached_property
    def payments(self) -> DataFrame:
        price = cents(F.col("l_extendedprice"))
        discount = F.round(F.col("l_discount") * 100).cast("long")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("payment_sequential"),
            F.when(F.col("l_returnflag") == "N", "not_defined").otherwise(F.col("l_returnflag")).alias("payment_type"),
            (F.col("l_linenumber") - 1).cast("long").alias("payment_installments"),
            F.floor(price * (100 - discount) / 100).cast("long").alias("payment_cents"))

    @cached_property
    def products(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("brand"),
            F.when(F.col("p_size") <= 45, F.col("p_type")).alias("category"),
            (F.col("p_size") - 1).cast("long").alias("weight_g"))

    @cached_property
    def customers(self) -> DataFrame:
        nation = F.broadcast(self.table("nation").select("n_nationkey", "n_name"))
        return self.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
            F.col("c_custkey").alias("customer_id"), F.col("n_name").alias("customer_state"),
            F.lpad(F.expr("c_nationkey div 2").cast("string"), 5, "0").alias("customer_zip"))

    @cached_property
    def sellers(self) -> DataFrame:
        nation = F.broadcast(self.table("nation").select("n_nationkey", "n_name"))
        return self.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
            F.col("s_suppkey").alias("seller_id"), F.col("n_name").alias("seller_state"),
            F.lpad(F.expr("s_nationkey div 2").cast("string"), 5, "0").alias("seller_zip"))

    @cached_property
    def coordinates(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("record"), F.lpad(F.col("label").cast("string"), 5, "0").alias("zip"),
            (F.element_at("embedding", 1).cast("double") * 90).alias("lat"),
            (F.element_at("embedding", 2).cast("double") * 180).alias("lng"),
            F.concat(F.lit("S"), F.floor(F.abs(F.element_at("embedding", 3).cast("double")) * 2).cast("string")).alias("state"))

    @cached_property
    def activity_log(self) -> DataFrame:
        """Milestone log of the orders: (case_id, activity, ts, rank), observed milestones only."""
        return self.milestones(self.orders)

    @staticmethod
    def milestones(orders: DataFrame) -> DataFrame:
        pieces = ", ".join(f"{rank}L, '{name}', {column}" for rank, (name, column)
                           in enumerate(zip(ACTIVITIES, TIMES)))
        return orders.select(
            F.col("order_id").alias("case_id"),
            F.expr(f"stack(4, {pieces}) AS (rank, activity, ts)")).where("ts IS NOT NULL")

    @cached_property
    def funnel_log(self) -> DataFrame:
        """Weekly user cases over the click stream: first occurrence of each of the four activities."""
        week = F.date_trunc("week", F.col("ts"))
        rank = F.array_position(F.array(*[F.lit(a) for a in FUNNEL]), F.col("event_type")) - 1
        return self.table("events").where(F.col("event_type").isin(FUNNEL)).groupBy(
            F.concat_ws("@", F.col("user_id").cast("string"), F.date_format(week, "yyyy-MM-dd")).alias("case_id"),
            F.col("event_type").alias("activity"), rank.cast("long").alias("rank"),
        ).agg(F.min("ts").alias("ts"))

    @cached_property
    def reviews(self) -> DataFrame:
        """Review records from the click and error events of weekly user cases."""
        week = F.date_trunc("week", F.col("ts"))
        return self.table("events").where(F.col("event_type").isin("click", "error")).select(
            F.col("event_id").alias("review_id"),
            F.concat_ws("@", F.col("user_id").cast("string"), F.date_format(week, "yyyy-MM-dd")).alias("order_id"),
            (F.col("user_id") % 10).alias("seller_id"), (F.col("event_id") % 5 + 1).alias("score"),
            clock.seconds(F.date_trunc("hour", F.col("ts"))).alias("answered_s"))

    @cached_property
    def performance(self) -> DataFrame:
        """Orders with split, visibility cutoff, context and delivery state (see operators.performance)."""
        from ordertide.operators import performance
        return performance.order_performance(self.contextual_orders, SPLIT_BOUNDS)

    @cached_property
    def contextual_orders(self) -> DataFrame:
        # One distinct count per aggregate over lines dealt by order: two in one copy every line three times before the shuffle.
        of = lambda column: self.items.select("order_id", column).repartition("order_id").groupBy("order_id")
        sellers = of("seller_id").agg(
            F.count_distinct("seller_id").alias("seller_count"), F.count(F.lit(1)).alias("item_count"), F.min("seller_id").alias("first_seller"),
        ).join(of("product_id").agg(F.count_distinct("product_id").alias("product_count"), F.min("product_id").alias("first_product")), "order_id")
        band = (F.when(F.col("total_cents") < 10000000, "low").when(F.col("total_cents") < 25000000, "middle")
                .otherwise("high"))
        # The customers first: what follows is joined by order, so that the rows are dealt twice, and not a third time to come back.
        placed = self._placed.join(self.customers.select("customer_id", "customer_state"), "customer_id", "left")
        return (placed.join(self._shipped, "order_id", "left").select(*self.orders.columns, "customer_state")
                .join(sellers, "order_id", "left")
                .withColumn("seller_count", F.coalesce("seller_count", F.lit(0)))
                .withColumn("product_count", F.coalesce("product_count", F.lit(0)))
                .withColumn("item_count", F.coalesce("item_count", F.lit(0)))
                .withColumn("distance_band", band))

    @cached_property
    def measures(self) -> DataFrame:
        """Detector matrix: per order three non-negative integer features and an inner role."""
        per_order = self.table("lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(
            F.sum(F.col("l_quantity").cast("long")).alias("quantity"),
            F.sum(cents(F.col("l_extendedprice"))).alias("price_cents"),
            F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("discount_points"))
        role = clock.split_of(F.col("purchased_at"), [("fit", "1998-01-01"), ("calibration", "2000-01-01"),
                                                      ("validation", "2002-01-01")])
        dates = self.table("orders").select(F.col("o_orderkey").alias("order_id"),
                                            F.col("o_orderdate").alias("purchased_at"),
                                            F.col("o_orderstatus").alias("raw_status"))
        return per_order.join(dates, "order_id").withColumn("role", role)
