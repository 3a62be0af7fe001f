"""Category comparison, partitions, roles and coverage over the order model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ordertide.functions import clock, tristate
from ordertide.operators import ordered


def _n(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def category_profile(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Per category over single-category orders: volumes, timeline quality, sellers, months, durations.

    orders: scoped and flagged orders with usage columns and total_s; items: order items.
    """
    membership = orders.select("order_id", F.explode("categories").alias("category")).groupBy("category").agg(
        F.count(F.lit(1)).alias("orders_with_category"))
    single = orders.where("category_scope = 'single_category'").withColumn("category", F.col("single_category_name"))
    base = single.groupBy("category").agg(
        F.count(F.lit(1)).alias("single_category_orders"), _n(F.col("order_status") == "delivered").alias("delivered_orders"),
        _n(F.col("completed_timing_eligible")).alias("complete_orders"), _n(F.col("missing_milestone_count") > 0).alias("missing_timeline_orders"),
        _n(F.col("has_reversed_milestones")).alias("reversed_timeline_orders"), _n(F.col("seller_count") > 1).alias("multi_seller_orders"),
        F.count_distinct(clock.month(F.col("purchased_at"))).alias("purchase_months"),
        F.min("purchased_at").alias("first_purchase"), F.max("purchased_at").alias("last_purchase"))
    sellers = items.join(single.select("order_id", "category"), "order_id").groupBy("category").agg(
        F.count_distinct("seller_id").alias("distinct_sellers"))
    points = ordered.quantiles(single.where("completed_timing_eligible"), ["category"], "total_s",
                               {"median_days": .5, "p95_days": .95}, scale=86400, width=ordered.UNITS)
    return membership.join(base, "category", "left").join(sellers, "category", "left").join(points, "category", "left")


def category_months(orders: DataFrame, min_month: int) -> DataFrame:
    """Dense category x month counts of single-category orders over the calendar span of all of them."""
    single = orders.where("category_scope = 'single_category'").select(
        F.col("single_category_name").alias("category"), F.trunc("purchased_at", "month").alias("month_start"))
    counts = single.groupBy("category", "month_start").agg(F.count(F.lit(1)).alias("orders"))
    span = counts.agg(F.min("month_start").alias("lo"), F.max("month_start").alias("hi"))
    spine = ordered.attach_one_row(counts.select("category").distinct(), span).select(
        "category", F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("month_start"))
    return spine.join(counts, ["category", "month_start"], "left").select(
        "category", "month_start", F.coalesce("orders", F.lit(0)).alias("orders")).withColumn("supported_month", F.col("orders") >= min_month)


def coverage_gate(months: DataFrame, min_orders: int, min_months: int) -> DataFrame:
    return months.groupBy("category").agg(F.sum("orders").alias("single_category_orders"), _n(F.col("supported_month")).alias("supported_months")).withColumn(
        "candidate", (F.col("single_category_orders") >= min_orders) & (F.col("supported_months") >= min_months))


def common_window(months: DataFrame, gate: DataFrame) -> DataFrame:
    """Longest run of months supported by every candidate, the earliest on a tie (gaps and islands).

    The windows run over one row per calendar month.
    """
    shared = months.join(gate.where("candidate").select("category"), "category", "left_semi").groupBy("month_start").agg(
        F.bool_and("supported_month").alias("ok")).where("ok")
    index = F.year("month_start") * 12 + F.month("month_start")
    island = shared.select("month_start", (index - F.row_number().over(W.orderBy("month_start"))).alias("g"))
    runs = island.groupBy("g").agg(F.min("month_start").alias("first_month"), F.max("month_start").alias("last_month"), F.count(F.lit(1)).alias("months"))
    return runs.orderBy(F.desc("months"), "first_month").limit(1).select(
        "first_month", "last_month", "months", F.add_months("last_month", 1).alias("end_exclusive"))


def selection_ledger(orders: DataFrame, gate: DataFrame, window: DataFrame) -> DataFrame:
    """Every order with one exclusive disposition by precedence."""
    marked = orders.join(gate.select(F.col("category").alias("single_category_name"), "candidate"), "single_category_name", "left")
    day = F.to_date("purchased_at")
    # Aggregated to one row even without a shared period, so every order keeps its ledger row.
    one = window.agg(*[F.max(c).alias(c) for c in ["first_month", "last_month", "months", "end_exclusive"]])
    inside = (day >= F.col("first_month")) & (day < F.col("end_exclusive"))
    placed = ordered.attach_one_row(marked, one).withColumn("in_window", tristate.known_true(inside))
    return placed.withColumn("disposition", F.when(F.col("category_scope") != "single_category", F.concat(F.lit("category_scope:"), F.col("category_scope")))
                             .when(~tristate.known_true(F.col("candidate")), "below_category_coverage_gate").when(~F.col("in_window"), "outside_common_period")
                             .when(~F.col("completed_timing_eligible"), F.concat(F.lit("timing_ineligible:"), F.col("usage_group"))).otherwise("included"))


def category_overview(ledger: DataFrame) -> DataFrame:
    period = (F.col("category_scope") == "single_category") & F.col("in_window")
    return ledger.where("category_scope = 'single_category'").groupBy(F.col("single_category_name").alias("category")).agg(
        F.count(F.lit(1)).alias("single_category_orders"), _n(period).alias("period_orders"),
        _n(period & F.col("completed_timing_eligible")).alias("period_eligible"), _n(F.col("disposition") == "included").alias("comparison_orders")).withColumn(
        "period_excluded_fraction", tristate.ratio(F.col("period_orders") - F.col("period_eligible"), F.col("period_orders")))


def vote_levels(cases: DataFrame, flags: list[str]) -> DataFrame:
    """Cases and share per number of flags, unknown flags counted as not raised, with the level of agreement."""
    votes = sum(F.coalesce(F.col(f), F.lit(False)).cast("int") for f in flags)
    per = cases.groupBy(votes.alias("votes")).agg(F.count(F.lit(1)).alias("cases"))
    level = F.when(F.col("votes") == 0, "none").when(F.col("votes") == 1, "single").when(F.col("votes") < len(flags), "majority").otherwise("all")
    total = per.agg(F.sum("cases").alias("_all"))
    return ordered.attach_one_row(per, total).select("votes", level.alias("level"), "cases", (100 * F.col("cases") / F.col("_all")).alias("percent"))


def usage_group_exclusions(ledger: DataFrame) -> DataFrame:
    """Orders of the common window per category and usage group, and whether the category passed the coverage gate."""
    rows = ledger.where("category_scope = 'single_category' AND in_window")
    return rows.groupBy(F.col("single_category_name").alias("category"), "usage_group").agg(
        F.count(F.lit(1)).alias("orders"), F.max(F.coalesce("candidate", F.lit(False))).alias("category_candidate"))


def single_seller_states(included: DataFrame, items: DataFrame, customers: DataFrame, sellers: DataFrame) -> DataFrame:
    """Per category over orders of one seller: share sold inside the customer's state (unknown states count as different), median total time."""
    single = included.where("seller_count = 1")
    seller = items.select("order_id", "seller_id").distinct().join(sellers.select("seller_id", "seller_state"), "seller_id", "left").drop("seller_id")
    rows = single.select("order_id", "category", "customer_id").join(seller, "order_id").join(customers.select("customer_id", "customer_state"), "customer_id", "left")
    same = tristate.known_true(F.col("seller_state") == F.col("customer_state"))
    counted = rows.groupBy("category").agg(F.count(F.lit(1)).alias("single_seller_orders"), _n(same).alias("same_state_orders"))
    counted = counted.withColumn("same_state_fraction", tristate.ratio(F.col("same_state_orders"), F.col("single_seller_orders")))
    return counted.join(ordered.quantiles(single, ["category"], "total_s", {"median_total_days": .5}, scale=86400, width=ordered.WEEK), "category")


def seller_composition(included: DataFrame, items: DataFrame) -> DataFrame:
    """Seller structure per category; the largest seller comes from a two-level count."""
    base = included.groupBy("category").agg(F.count(F.lit(1)).alias("comparison_orders"), _n(F.col("seller_count") == 1).alias("single_seller_orders"),
                                            _n(F.col("seller_count") > 1).alias("multi_seller_orders"))
    pairs = items.select("order_id", "seller_id").distinct().join(included.select("order_id", "category", "seller_count"), "order_id")
    per = pairs.groupBy("category", "seller_id").agg(_n(F.col("seller_count") == 1).alias("n"))
    sellers = per.groupBy("category").agg(F.count(F.lit(1)).alias("distinct_sellers"), F.max("n").alias("largest_single_seller_orders"))
    return base.join(sellers, "category").withColumn("largest_share", tristate.ratio(F.col("largest_single_seller_orders"), F.col("single_seller_orders")))


def direct_standardization(included: DataFrame, stratum: str, value: str, minimum: int) -> DataFrame:
    """Mean with equal weight per stratum supported by every category, next to raw means."""
    cells = included.groupBy("category", stratum).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"))
    total = cells.agg(F.count_distinct("category").alias("_k"))
    common = ordered.attach_one_row(cells.where(F.col("n") >= minimum).groupBy(stratum).agg(F.count(F.lit(1)).alias("c")), total).where("c = _k").select(
        stratum, F.lit(True).alias("common"))
    strata = common.agg(F.count(F.lit(1)).alias("common_strata"))
    joined = ordered.attach_one_row(cells.join(common, stratum, "left"), strata)
    inside = F.col("common").isNotNull()
    return joined.groupBy("category").agg(
        F.sum("n").alias("orders"), F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("supported_orders"), F.max("common_strata").alias("common_strata"),
        (F.sum("s") / F.sum("n") / 86400).alias("raw_mean_days"), (F.sum(F.when(inside, F.col("s"))) / F.sum(F.when(inside, F.col("n"))) / 86400).alias("supported_mean_days"),
        (F.sum(F.when(inside, F.col("s") / F.col("n"))) / F.max("common_strata") / 86400).alias("standardized_mean_days"))


def tail_sensitivity(ledger: DataFrame) -> DataFrame:
    """The comparison with and without the last month of the window, in one pass over two scenarios."""
    scenarios = F.array(F.struct(F.lit("common_window").alias("scenario"), F.col("end_exclusive").alias("end")),
                        F.struct(F.lit("omit_last_purchase_month").alias("scenario"), F.col("last_month").alias("end")))
    rows = ledger.where("category_scope = 'single_category' AND candidate").withColumn("s", F.explode(scenarios)).where(
        (F.to_date("purchased_at") >= F.col("first_month")) & (F.to_date("purchased_at") < F.col("s.end")))
    ok = F.col("completed_timing_eligible")
    return rows.groupBy(F.col("single_category_name").alias("category"), F.col("s.scenario").alias("scenario")).agg(
        F.count(F.lit(1)).alias("orders"), _n(ok).alias("eligible_orders"), (F.avg(F.when(ok, F.col("total_s"))) / 86400).alias("mean_days"))


def split_summary(orders: DataFrame) -> DataFrame:
    """Per split: cohort size, completed, crossing the cutoff, timing inputs, missing and reversed."""
    crosses = F.col("timing_input_reason") == "completion_not_before_partition_cutoff"
    return orders.groupBy("split").agg(
        F.count(F.lit(1)).alias("cohort_orders"), _n(F.col("completed_timing_eligible")).alias("completed_orders"), _n(crosses).alias("crossing_orders"),
        _n(F.col("timing_input_eligible")).alias("timing_input_orders"), _n(F.col("missing_milestone_count") > 0).alias("missing_orders"),
        _n(F.col("has_reversed_milestones")).alias("reversed_orders"), F.min("purchased_at").alias("first_purchase"), F.max("purchased_at").alias("last_purchase"))


def outer_split(df: DataFrame, time: str, tail: int = 5) -> DataFrame:
    """Latest 1/tail of the rows form the test side; all ties at the boundary go to test.

    The boundary is an order statistic of the chunked distribution, not a global sort.
    """
    distribution = ordered.ranks(df, [], time, width=ordered.WEEK)
    n = F.col("n_total")
    boundary = ordered.pick_positions(distribution, [], time, {"boundary": n - F.floor((n + tail - 1) / tail)})
    return ordered.attach_one_row(df, boundary).withColumn("proposed_role", F.when(F.col(time) >= F.col("boundary"), "test").otherwise("development"))


def inner_roles(df: DataFrame, fit_end: str, last: Column) -> DataFrame:
    """fit only when purchase and completion are before the boundary; deferred when completion is not."""
    edge = F.lit(fit_end).cast("timestamp_ntz")
    return df.withColumn("inner_role", tristate.first_match([
        ("validation", F.col("split") == "validation"), ("reserved_test", F.col("split") == "test"), ("calibration", F.col("purchased_at") >= edge),
        ("fit", tristate.known_true(last < edge))], "deferred_at_inner_cutoff"))


def quality_metrics(orders: DataFrame, log: DataFrame) -> DataFrame:
    """Long (section, metric, value) audit table from three aggregates."""
    o = orders.agg(F.count(F.lit(1)).alias("orders"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"missing_{c}") for c in ["carrier_at", "delivered_at"]],
                   _n(F.col("negative_transition_count") > 0).alias("orders_with_negative_duration"), _n(F.col("has_reversed_milestones")).alias("reversed_orders"))
    e = log.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("events_per_case_min"), F.max("n").alias("events_per_case_max"),
                                                                    F.sum("n").alias("events"))
    status = orders.groupBy(F.col("order_status").alias("metric")).agg(F.count(F.lit(1)).alias("value")).select(F.lit("status").alias("section"), "metric", "value")
    long = lambda df, section: df.select(F.lit(section).alias("section"), F.expr(
        f"stack({len(df.columns)}, {', '.join(f'{chr(39)}{c}{chr(39)}, cast({c} as bigint)' for c in df.columns)}) AS (metric, value)"))
    return status.unionByName(long(o, "orders")).unionByName(long(e, "event_log"))


def overlap_groups(df: DataFrame, flags: list[str]) -> DataFrame:
    """Exclusive overlap groups of detector flags with their share."""
    counts = df.groupBy(*flags).agg(F.count(F.lit(1)).alias("cases"))
    total = counts.agg(F.sum("cases").alias("_t"))
    return ordered.attach_one_row(counts, total).withColumn("percent", 100 * F.col("cases") / F.col("_t")).drop("_t")


def label_crosstab(df: DataFrame, a: str, b: str, a_labels: list[str], b_labels: list[str]) -> DataFrame:
    """Dense label table with share of population and of the row; absent combinations are zero."""
    counts = df.groupBy(a).agg(*[_n(F.col(b) == v).alias(f"v{i}") for i, v in enumerate(b_labels)])
    spine = df.sparkSession.createDataFrame([(v,) for v in a_labels], f"{a} string")
    pieces = ", ".join(f"'{v}', coalesce(v{i}, 0L)" for i, v in enumerate(b_labels))
    long = spine.join(counts, a, "left").select(a, F.expr(f"stack({len(b_labels)}, {pieces}) AS ({b}, cases)"))
    rows = long.groupBy(a).agg(F.sum("cases").alias("_r"))
    total = long.agg(F.sum("cases").alias("_t"))
    return ordered.attach_one_row(long.join(rows, a), total).select(a, b, "cases", tristate.ratio(100 * F.col("cases"), F.col("_t")).alias("percent_population"),
                                                                    tristate.ratio(100 * F.col("cases"), F.col("_r")).alias("percent_row"))
