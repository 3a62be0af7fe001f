"""Order quality: durations, timeline flags, usage groups, quality issues and their usage actions."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertide.functions import clock, tristate
from ordertide.sources.star_schema import STAGES, TIMES

# Issue code -> usage action, usage groups in order of precedence.
ISSUE_ACTIONS = {
    "missing_timestamp": "retain_missing_do_not_compute_affected_duration",
    "negative_transition_duration": "retain_evidence_exclude_completed_timing_review_source",
    "recorded_milestones_out_of_order": "retain_evidence_exclude_completed_timing_review_source",
    "delivered_without_delivery_timestamp": "verify_source_status_and_timestamps",
    "non_delivered_status_with_delivery_timestamp": "verify_source_status_and_timestamps",
    "missing_product_attribute": "leave_attribute_missing_do_not_infer",
    "zero_physical_measurement": "mask_measurement_in_derived_feature_only",
    "zero_payment_field_needs_context": "retain_zero_no_automatic_anomaly_or_correction",
    "undefined_payment_type": "retain_unknown_type_do_not_infer_payment_method",
    "unmatched_optional_reference": "retain_source_key_do_not_invent_mapping",
    "missing_child_records": "retain_order_do_not_replace_missing_table_records_with_zero_totals",
    "negative_numeric_value": "retain_source_review_field_semantics_before_feature_use",
    "invalid_review_score": "retain_source_exclude_score_from_satisfaction_statistics",
    "review_answer_before_creation": "retain_source_review_dates_before_review_timing_analysis",
    "invalid_earth_coordinate": "retain_source_exclude_coordinate_from_spatial_computations",
}
USAGE_GROUPS = ["status_delivery_conflict", "recorded_timeline_reversal", "delivered_missing_milestones",
                "completed_timing_available", "canceled_or_unavailable_incomplete",
                "nonfinal_status_cutoff_unknown"]


def duration_columns(df: DataFrame) -> DataFrame:
    """Signed days of the three transitions and of the whole cycle."""
    out = {f"{stage}_days": clock.days_between(F.col(a), F.col(b)) for stage, a, b in STAGES}
    out["total_days"] = clock.days_between(F.col(TIMES[0]), F.col(TIMES[-1]))
    return df.withColumns(out)


def pair_flags(times: list[str] = TIMES, relation: str = "reversed") -> list[tuple[str, Column]]:
    """Named predicates over all ordered milestone pairs; a missing endpoint gives false."""
    test = (lambda a, b: F.col(b) < F.col(a)) if relation == "reversed" else (lambda a, b: F.col(a) == F.col(b))
    return [(f"{a}>{b}", tristate.known_true(test(a, b))) for a, b in combinations(times, 2)]


def pairwise_inversions(times: list[str] = TIMES) -> Column:
    return tristate.reasons(pair_flags(times, "reversed"))


def equal_pairs(times: list[str] = TIMES) -> Column:
    return tristate.reasons(pair_flags(times, "equal"))


def timeline_flags(df: DataFrame) -> DataFrame:
    """Missing count, reversals over all pairs, negative transitions, completeness and conflicts."""
    missing = reduce(lambda a, b: a + b, [F.col(t).isNull().cast("long") for t in TIMES])
    negative = reduce(lambda a, b: a + b, [tristate.known_true(F.col(b) < F.col(a)).cast("long") for _, a, b in STAGES])
    reversed_any = reduce(lambda a, b: a | b, [c for _, c in pair_flags()])
    delivered = F.col("order_status") == "delivered"
    return df.withColumns({
        "missing_milestone_count": missing, "negative_transition_count": negative,
        "has_reversed_milestones": reversed_any,
        "status_delivery_conflict": delivered != F.col(TIMES[-1]).isNotNull(),
    }).withColumn("completed_timing_eligible", delivered & (F.col("missing_milestone_count") == 0)
                  & ~F.col("has_reversed_milestones")).withColumn(
        "temporal_review_required", (F.col("missing_milestone_count") > 0) | F.col("has_reversed_milestones")
        | F.col("status_delivery_conflict"))


def usage_group(df: DataFrame) -> DataFrame:
    """Six exclusive groups by precedence, the exclusion reasons and the verification priority."""
    delivered = F.col("order_status") == "delivered"
    closed = F.col("order_status").isin("canceled", "unavailable")
    missing = F.col("missing_milestone_count") > 0
    conditions = [F.col("status_delivery_conflict"), F.col("has_reversed_milestones"), delivered & missing,
                  F.col("completed_timing_eligible"), closed & missing, ~delivered & ~closed & missing]
    group = tristate.first_match(list(zip(USAGE_GROUPS, conditions)))
    return df.withColumn("usage_group", group).withColumn(
        "source_verification_priority", F.col("usage_group").isin(USAGE_GROUPS[:3])).withColumn(
        "timing_exclusion_reasons", tristate.reasons([
            ("not_delivered_status", ~delivered), ("missing_milestones", missing),
            ("reversed_recorded_timeline", F.col("has_reversed_milestones"))]))


def duration_state(value: Column) -> Column:
    return tristate.first_match([("missing_endpoint", value.isNull()), ("negative_observed", value < 0),
                                 ("zero_observed", value == 0)], "positive_observed")


def measurement_policy(products: DataFrame, measures: list[str]) -> DataFrame:
    """Usable flag and masked feature per physical measure; the source column is untouched."""
    out = {}
    for m in measures:
        out[f"{m}_usable"] = F.coalesce(F.col(m) > 0, F.lit(False))
        out[f"{m}_feature"] = F.when(F.col(m) > 0, F.col(m))
    return products.withColumns(out)


def category_scope(items: DataFrame, products: DataFrame) -> DataFrame:
    """Per order with items: counts, sorted known categories and the exclusive category scope."""
    joined = items.join(products.select("product_id", "category"), "product_id", "left")
    grouped = joined.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("item_count"), (F.count(F.lit(1)) - F.count("category")).alias("missing_category_item_count"),
        F.array_sort(F.collect_set("category")).alias("categories")).withColumn("known_category_count", F.size("categories").cast("long"))
    # One distinct count per aggregate over lines dealt by order: several in one copy every line per counted column.
    for column, name in [("product_id", "product_count"), ("seller_id", "seller_count")]:
        counted = items.select("order_id", column).repartition("order_id").groupBy("order_id").agg(F.count_distinct(column).alias(name))
        grouped = grouped.join(counted, "order_id")
    return grouped


def scoped_orders(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    counts = ["item_count", "product_count", "seller_count", "known_category_count", "missing_category_item_count"]
    joined = orders.join(category_scope(items, products), "order_id", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in counts})
    scope = tristate.first_match([
        ("no_items", F.col("item_count") == 0), ("unknown_only", F.col("known_category_count") == 0),
        ("partially_unknown", F.col("missing_category_item_count") > 0),
        ("mixed_category", F.col("known_category_count") > 1)], "single_category")
    return joined.withColumn("category_scope", scope).withColumn(
        "single_category_name", F.when(F.col("category_scope") == "single_category", F.col("categories")[0]))


def issue(field: str, code: str, condition: Column, observed: Column, action: str = "retain_for_review") -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.struct(
        F.lit(field).alias("field"), F.lit(code).alias("issue_code"),
        observed.cast("string").alias("observed_value"), F.lit(action).alias("action")))


def explode_issues(name: str, df: DataFrame, key: Column, issues: list[Column]) -> DataFrame:
    """Long issue rows of one table; one narrow pass, nothing joined or shuffled."""
    listed = F.filter(F.array(*issues), lambda x: x.isNotNull())
    return df.select(F.lit(name).alias("table_name"), key.cast("string").alias("record_key"),
                     F.explode(listed).alias("i")).select("table_name", "record_key", "i.*")


def quality_issues(tables: dict[str, DataFrame]) -> DataFrame:
    """Long issue table over orders, items, payments, products, reviews and coordinates.

    ``tables``: orders (with child counts item_count, payment_count), items, payments, products,
    reviews (review_id, score, created_s, answered_s), coordinates (record, lat, lng),
    customers (customer_id, customer_zip), zips (zip).
    """
    orders = timeline_flags(duration_columns(tables["orders"]))
    delivered = F.col("order_status") == "delivered"
    keep_missing, keep_time = "retain_missing_no_imputation", "retain_temporal_evidence"
    parts = [explode_issues("orders", orders, F.col("order_id"), [
        *[issue(t, "missing_timestamp", F.col(t).isNull(), F.lit(None), keep_missing) for t in TIMES],
        *[issue(f"{s}_days", "negative_transition_duration", F.col(b) < F.col(a),
                F.round(F.col(f"{s}_days")).cast("long"), keep_time) for s, a, b in STAGES],
        issue("purchased_at", "recorded_milestones_out_of_order", F.col("has_reversed_milestones"),
              F.date_format("purchased_at", "yyyy-MM-dd HH:mm:ss"), keep_time),
        issue("order_status", "delivered_without_delivery_timestamp", delivered & F.col("delivered_at").isNull(),
              F.col("order_status")),
        issue("order_status", "non_delivered_status_with_delivery_timestamp",
              ~delivered & F.col("delivered_at").isNotNull(), F.col("order_status")),
        *[issue(c, "missing_child_records", F.col(c) == 0, F.col(c), keep_missing)
          for c in ["item_count", "payment_count"]]])]
    parts.append(explode_issues("items", tables["items"], F.concat_ws(":", "order_id", "item_no"), [
        issue(c, "negative_numeric_value", F.col(c) < 0, F.col(c)) for c in ["price_cents", "freight_cents"]]))
    parts.append(explode_issues("payments", tables["payments"], F.concat_ws(":", "order_id", "payment_sequential"), [
        issue("payment_cents", "negative_numeric_value", F.col("payment_cents") < 0, F.col("payment_cents")),
        *[issue(c, "zero_payment_field_needs_context", F.col(c) == 0, F.col(c))
          for c in ["payment_cents", "payment_installments"]],
        issue("payment_type", "undefined_payment_type", F.col("payment_type") == "not_defined", F.col("payment_type"))]))
    parts.append(explode_issues("products", tables["products"], F.col("product_id"), [
        issue("category", "missing_product_attribute", F.col("category").isNull(), F.lit(None), keep_missing),
        issue("weight_g", "zero_physical_measurement", F.col("weight_g") == 0, F.col("weight_g"),
              "retain_exclude_this_measurement")]))
    parts.append(explode_issues("reviews", tables["reviews"], F.col("review_id"), [
        issue("score", "invalid_review_score", F.col("score").isNull() | ~F.col("score").between(1, 5), F.col("score")),
        issue("answered_s", "review_answer_before_creation", F.col("answered_s") < F.col("created_s"),
              F.col("answered_s"))]))
    parts.append(explode_issues("coordinates", tables["coordinates"], F.col("record"), [
        issue(c, "invalid_earth_coordinate", F.col(c).isNull() | (F.abs(c) > limit), F.lit(c),
              "retain_exclude_this_coordinate") for c, limit in [("lat", 90), ("lng", 180)]]))
    unmatched = tables["customers"].where(F.col("customer_zip").isNotNull()).join(
        tables["zips"].select(F.col("zip").alias("customer_zip")).distinct(), "customer_zip", "left_anti")
    parts.append(explode_issues("customers", unmatched, F.col("customer_id"), [
        issue("customer_zip", "unmatched_optional_reference", F.lit(True), F.col("customer_zip"),
              "retain_no_inferred_mapping")]))
    return reduce(lambda a, b: a.unionByName(b), parts)


def issue_actions(issues: DataFrame) -> DataFrame:
    """Usage action per issue; a code without a policy raises when the row is read."""
    table = F.create_map(*[F.lit(x) for pair in ISSUE_ACTIONS.items() for x in pair])
    action = F.try_element_at(table, F.col("issue_code"))
    known = F.when(action.isNull(), F.raise_error(F.concat(F.lit("missing usage policy: "), F.col("issue_code")))
                   .cast("string")).otherwise(action)
    return issues.withColumn("usage_action", known)


def visible_before(df: DataFrame, columns: list[str], cutoff: Column, boundary: Column) -> DataFrame:
    """Hide values at or after the earlier of row cutoff and boundary; count what was hidden."""
    edge = F.least(cutoff, boundary)
    hidden = reduce(lambda a, b: a + b, [tristate.known_true(F.col(c) >= edge).cast("long") for c in columns])
    return df.withColumn("hidden_values", hidden).withColumns(
        {c: F.when(F.col(c) < edge, F.col(c)) for c in columns})


def timing_eligibility(df: DataFrame, category: str) -> DataFrame:
    """Eligible flag and first applicable reason by precedence."""
    crosses = reduce(lambda a, b: a | b, [tristate.known_true(F.col(t) >= F.col("cutoff")) for t in TIMES])
    reason = tristate.first_match([
        ("reserved_test_not_used", F.col("split") == "test"), ("chronological_split_required", F.col("split").isNull()),
        ("outside_selected_category", ~tristate.known_true(F.col("single_category_name") == category)),
        ("timing_ineligible", ~F.col("completed_timing_eligible")), ("partition_cutoff_required", F.col("cutoff").isNull()),
        ("completion_not_before_partition_cutoff", crosses)], "eligible_completed_timing")
    return df.withColumn("timing_input_reason", reason).withColumn(
        "timing_input_eligible", F.col("timing_input_reason") == "eligible_completed_timing")


def scope_support(df: DataFrame) -> DataFrame:
    """Long (order, analysis scope): support state, reasons and recommended use.

    Input columns: visible_events, missing_events, hidden_events, inverted_pairs, has_equal_times,
    timing_input_eligible, payment_cents, geography_eligible, distance_band, seller_count,
    prior_comparable_orders, prior_reviewed_orders.
    """
    def scope(name, state, pairs):
        return F.struct(F.lit(name).alias("analysis_scope"), state.alias("support_state"),
                        tristate.reasons(pairs).alias("reasons"))

    yes = F.lit(True)
    timing = tristate.known_true(F.col("timing_input_eligible"))
    paid = F.coalesce(F.col("payment_cents") >= 0, F.lit(False))
    geo = tristate.known_true(F.col("geography_eligible")) & F.col("distance_band").isNotNull()
    single = F.col("seller_count") == 1
    supported = tristate.known_true((F.col("prior_comparable_orders") > 0) & (F.col("prior_reviewed_orders") > 0))
    held = lambda ok: F.when(ok, "available").otherwise("withheld")
    scopes = F.array(
        scope("process_evidence", F.when(F.col("visible_events") == 4, "available").otherwise("partial"), [
            ("source_milestones_missing", F.col("missing_events") > 0),
            ("events_not_visible_at_cutoff", F.col("hidden_events") > 0),
            ("recorded_inversion_not_verified_entry_error", F.col("inverted_pairs") > 0),
            ("equal_times_not_observed_causal_order", F.col("has_equal_times"))]),
        scope("completed_timing", held(timing), [("preserve_saved_timing_eligibility_and_inner_cutoff", ~timing)]),
        scope("payment_order_features", held(paid), [
            ("missing_or_negative:payment_cents", ~paid),
            ("retrospective_snapshot_not_verified_event_time_availability", yes)]),
        scope("geographic_context", held(geo), [("inherited_provisional_zip_screen_not_verified_road_distance", yes)]),
        scope("seller_history", held(single & supported), [
            ("prior_category_scoped_history_not_causal_seller_fault", yes),
            ("multi_seller_order_level_outcome_not_attributed", ~single),
            ("required_prior_outcomes_unavailable_not_zero", ~supported)]))
    use = F.create_map(*[F.lit(x) for x in ["available", "retain_evidence", "partial", "retain_partial_evidence",
                                            "withheld", "withhold_from_named_analysis"]])
    return df.select("order_id", "split", F.explode(scopes).alias("s")).select(
        "order_id", "split", "s.*", use[F.col("s.support_state")].alias("recommended_use"))


def case_query(evidence: DataFrame, split: str | None = None, month: str | None = None, code: str | None = None,
               offset: int = 0, limit: int | None = None) -> DataFrame:
    """Filtered evidence in purchase order, one page of it when a limit is asked for."""
    if offset < 0 or (limit is not None and not 1 <= limit <= 200):
        raise ValueError("offset must be nonnegative and the page size 1..200")
    if split:
        evidence = evidence.where(F.col("split") == split)
    if month:
        evidence = evidence.where(F.col("purchase_month") == month)
    if code:
        evidence = evidence.where(F.array_contains("evidence_codes", code))
    if limit is None:
        return evidence
    return evidence.orderBy("purchased_at", "order_id").offset(offset).limit(limit)


def missing_feature_list(features: list[str]) -> Column:
    return tristate.reasons([(f, F.col(f).isNull()) for f in features])


def distance_band(distance: Column) -> Column:
    """Left-closed kilometre bands; unknown distance is its own band."""
    edges = [0, 50, 200, 500, 1000, 2000]
    chain = F.when(distance.isNull() | (distance < 0), "unavailable")
    for low, high in zip(edges, edges[1:]):
        chain = chain.when((distance >= low) & (distance < high), f"{low}_to_{high}")
    return chain.otherwise("2000_plus")
