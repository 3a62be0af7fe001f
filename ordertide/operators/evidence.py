"""Rule evidence per order: automatic checks with actions, evidence policy, stage comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertide.functions import tristate
from ordertide.operators import ordered, peers
from ordertide.operators.quality import pair_flags
from ordertide.sources.star_schema import STAGES, TIMES

# Reason code -> kind.
RULE_KINDS = {
    "STATUS_DELIVERY_CONFLICT": "source_record_issue", "RECORDED_TIMELINE_REVERSAL": "source_record_issue",
    "DELIVERED_MISSING_MILESTONE": "source_record_issue", "INCOMPLETE_CLOSED_STATUS": "context", "NONFINAL_CUTOFF_UNKNOWN": "context",
    "TIMING_OUTSIDE_PARTITION_CUTOFF": "context", "LONG_DURATION": "warning", "SEVERE_LONG_DURATION": "warning",
    "SHORT_DURATION_WARNING": "warning", "ZERO_DURATION_WARNING": "warning", "AFTER_ESTIMATED_DATE_WARNING": "warning",
    "MODEL_CANDIDATE_SIGNAL": "warning",
}


def duration_limits(fit: DataFrame) -> DataFrame:
    """One row of long, severe and short limits per stage from fit durations <stage>_s."""
    out = None
    for stage, _, _ in STAGES:
        q = ordered.quantiles(fit.select(F.col(f"{stage}_s").alias("v")), [], "v", {"q01": .01, "q25": .25, "q75": .75}, width=ordered.UNITS)
        iqr = F.col("q75") - F.col("q25")
        part = q.select((F.col("q75") + 1.5 * iqr).alias(f"{stage}_long"), (F.col("q75") + 3 * iqr).alias(f"{stage}_severe"), F.col("q01").alias(f"{stage}_short"))
        out = part if out is None else ordered.attach_one_row(out, part)
    return out


def auto_validate(orders: DataFrame, limits: DataFrame) -> DataFrame:
    """Reason array and one action per order by severity precedence.

    orders: milestones, order_status, flags, <stage>_s, days_late, timing_rules_available,
    timing_input_reason, model_candidate_signal.
    """
    df = ordered.attach_one_row(orders, limits)
    ok = F.col("timing_rules_available")
    delivered = F.col("order_status") == "delivered"
    missing = F.col("missing_milestone_count") > 0
    closed = F.col("order_status").isin("canceled", "unavailable")

    def entry(code: str, condition: Column, feature: str = "") -> Column:
        return F.when(tristate.known_true(condition), F.struct(F.lit(code).alias("reason_code"), F.lit(RULE_KINDS[code]).alias("kind"), F.lit(feature).alias("feature")))

    parts = [entry("STATUS_DELIVERY_CONFLICT", F.col("status_delivery_conflict"))]
    parts += [entry("RECORDED_TIMELINE_REVERSAL", c, name) for name, c in pair_flags(TIMES)]
    parts += [entry("DELIVERED_MISSING_MILESTONE", delivered & missing), entry("INCOMPLETE_CLOSED_STATUS", ~delivered & missing & closed),
              entry("NONFINAL_CUTOFF_UNKNOWN", ~delivered & missing & ~closed),
              entry("TIMING_OUTSIDE_PARTITION_CUTOFF", F.col("timing_input_reason") == "completion_not_before_partition_cutoff")]
    for stage, _, _ in STAGES:
        v = F.col(f"{stage}_s")
        parts += [entry("LONG_DURATION", ok & (v > F.col(f"{stage}_long")), stage), entry("SEVERE_LONG_DURATION", ok & (v > F.col(f"{stage}_severe")), stage),
                  entry("ZERO_DURATION_WARNING", ok & (v == 0), stage), entry("SHORT_DURATION_WARNING", ok & (v > 0) & (v < F.col(f"{stage}_short")), stage)]
    parts += [entry("AFTER_ESTIMATED_DATE_WARNING", ok & (F.col("days_late") > 0)), entry("MODEL_CANDIDATE_SIGNAL", F.col("model_candidate_signal"))]
    listed = df.withColumn("reasons", F.filter(F.array(*parts), lambda x: x.isNotNull()))
    has = lambda test: F.exists("reasons", test)
    timing = has(lambda x: (x["kind"] == "warning") & (x["reason_code"] != "MODEL_CANDIDATE_SIGNAL"))
    return listed.withColumn("auto_action", tristate.first_match([
        ("verify_source_record", has(lambda x: x["kind"] == "source_record_issue")), ("inspect_timing_warning", timing),
        ("inspect_model_signal", tristate.known_true(F.col("model_candidate_signal"))), ("insufficient_context", ~ok)], "no_signal_in_available_checks"))


def reason_rows(validated: DataFrame) -> DataFrame:
    return validated.select("order_id", "split", F.explode("reasons").alias("r")).select("order_id", "split", "r.*")


def monthly_actions(validated: DataFrame) -> DataFrame:
    warned = lambda code: F.count(F.when(F.exists("reasons", lambda x: x["reason_code"] == code), 1))
    return validated.groupBy("split", "purchase_month", "auto_action").agg(
        F.count(F.lit(1)).alias("orders"), F.count(F.when(F.col("timing_rules_available"), 1)).alias("timing_available"),
        warned("LONG_DURATION").alias("long_warnings"), warned("SHORT_DURATION_WARNING").alias("short_warnings"))


def evidence_policy(orders: DataFrame, signals: DataFrame) -> DataFrame:
    """Source quality, payment and timing-signal status per order; orders keep every row.

    orders: quality_conflict, milestones, payment_difference_cents; signals: peers.order_signals.
    """
    incomplete = reduce(lambda a, b: a | b, [F.col(t).isNull() for t in TIMES])
    joined = orders.join(signals.select("order_id", "assessed_stage_count", "long_stage_warning_count", "short_stage_note_count"), "order_id", "left")
    full = F.coalesce(F.col("assessed_stage_count") == 3, F.lit(False))
    warned = F.coalesce((F.col("long_stage_warning_count") + F.col("short_stage_note_count")) > 0, F.lit(False))
    return joined.withColumns({
        "source_quality_status": tristate.first_match([("recorded_conflict_requires_verification", F.col("quality_conflict")),
                                                       ("incomplete_at_observation_cutoff", incomplete)], "no_conflict_in_executed_timing_checks"),
        "payment_reconciliation": tristate.first_match([("not_assessable", F.col("payment_difference_cents").isNull()),
                                                        ("difference_requires_verification", F.col("payment_difference_cents") != 0)], "matched_exactly"),
        "timing_signal_status": tristate.first_match([
            ("statistical_warning_not_confirmed_anomaly", full & warned), ("no_warning_under_working_reference", full),
            ("partial_context_warning_other_stages_unassessed", warned)], "not_assessable")})


def percentile_sensitivity(stages: DataFrame, uppers: list[float]) -> DataFrame:
    """Warnings per stage at several upper percentiles from one pass over ranked stages."""
    rows = stages.where("assessable").withColumn("upper", F.explode(F.array(*[F.lit(float(u)) for u in uppers])))
    warn = (F.col(peers.DURATION) > 0) & (F.col("ref_upto") > F.col("upper") * F.col("ref_n"))
    return rows.groupBy("stage", "upper").agg(F.count(F.lit(1)).alias("assessed"), F.count(F.when(warn, 1)).alias("warnings"))


def global_and_context(stages: DataFrame, reference: DataFrame, uppers: list[float], stage_count: int = 3) -> DataFrame:
    """Per order and upper percentile: does any stage exceed it among all reference rows of the stage, and among its context peers?

    Orders with all stages assessable and a known delivery outcome count, so both methods judge the same orders.
    """
    own = stages.where("assessable").select("order_id", "stage", peers.DURATION, "performance_eligible", "performance_state",
                                            F.col("ref_upto").alias("context_upto"), F.col("ref_n").alias("context_n"))
    both = ordered.ecdf(own, reference, ["stage"], peers.DURATION, width=ordered.WEEK)
    rows = both.withColumn("upper", F.explode(F.array(*[F.lit(float(u)) for u in uppers])))

    def warned(upto, n):
        return F.max((F.col(peers.DURATION) > 0) & (F.col(upto) > F.col("upper") * F.col(n)))
    return rows.groupBy("order_id", "upper", "performance_state", "performance_eligible").agg(
        F.count(F.lit(1)).alias("stages"), warned("ref_upto", "ref_n").alias("global_warning"), warned("context_upto", "context_n").alias("context_warning")).where(
        (F.col("stages") == stage_count) & F.col("performance_eligible")).drop("stages", "performance_eligible")


def method_sensitivity(flags: DataFrame) -> DataFrame:
    """Per method and percentile: warnings among common orders, their overlap with late deliveries, and warnings of one method only."""
    methods = F.array(F.struct(F.lit("global_ecdf").alias("method"), F.col("global_warning").alias("flag")),
                      F.struct(F.lit("context_ecdf").alias("method"), F.col("context_warning").alias("flag")))
    rows = flags.withColumn("m", F.explode(methods)).select("*", "m.*")
    late, flag = F.col("performance_state") == "late", F.col("flag")
    n = tristate.count_true
    return rows.groupBy("method", "upper").agg(
        F.count(F.lit(1)).alias("common_orders"), n(flag).alias("warning_orders"), (n(flag) / F.count(F.lit(1))).alias("warning_fraction"),
        n(late).alias("late_promise_orders"), n(late & flag).alias("late_promise_with_warning"), n(late & ~flag).alias("late_promise_without_warning"),
        n(~late & flag).alias("meets_promise_with_warning"), n(F.col("context_warning") & ~F.col("global_warning")).alias("context_only_warnings"),
        n(F.col("global_warning") & ~F.col("context_warning")).alias("global_only_warnings"))


def method_disagreements(flags: DataFrame) -> DataFrame:
    return flags.where("global_warning <> context_warning").withColumn("correct_detector", F.lit("unresolved"))


def stage_comparison(stages: DataFrame, groups: DataFrame) -> DataFrame:
    """Direction against the reference median; groups: (group, median_days)."""
    joined = stages.join(groups.select("group", "median_days"), "group", "left")
    d = F.col(peers.DURATION) / 86400
    ok = F.col("assessable")
    return joined.withColumn("comparison_direction", tristate.first_match([
        ("unavailable", ~ok), ("zero_recorded_duration", d == 0), ("faster", d < F.col("median_days")), ("slower", d > F.col("median_days"))], "equal"))


def excess_by_dimension(stages: DataFrame, groups: DataFrame, dimensions: list[str]) -> DataFrame:
    """Per stage and value of each dimension (and overall), over assessable rows: median duration and its excess over the peers' median, in days.

    Rows are listed once per dimension; medians come from chunks, so a value with most rows is not one task.
    """
    compared = stages.where("assessable").join(groups.select("group", "median_days"), "group", "left")
    sides = F.array(F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("group_value")),
                    *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("group_value")) for d in dimensions])
    rows = compared.select("stage", peers.DURATION, "median_days", F.inline(sides))
    keys = ["stage", "dimension", "group_value"]
    excess = F.greatest(F.lit(0.0), F.col(peers.DURATION) / 86400 - F.col("median_days"))
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("assessed_orders"), F.count(F.when(excess > 0, 1)).alias("orders_above_peers"), F.sum(excess).alias("excess_days"))
    medians = ordered.quantiles(rows, keys, peers.DURATION, {"own_median_days": .5}, scale=86400, width=ordered.WEEK)
    return ordered.join_groups(sums, medians, keys)


def early_explanation(compared: DataFrame) -> DataFrame:
    """Order class: is an early delivery accompanied by a stage faster than its reference median?"""
    n = lambda *names: F.count(F.when(F.col("comparison_direction").isin(*names), 1))
    rolled = compared.groupBy("order_id", "performance_state", "performance_eligible").agg(
        n("faster").alias("faster_stages"), n("slower").alias("slower_stages"), n("faster", "slower", "equal").alias("compared_stages"))
    early, fast, full = F.col("performance_state") == "early", F.col("faster_stages") > 0, F.col("compared_stages") == 3
    return rolled.withColumn("early_delivery_explanation", tristate.first_match([
        ("delivery_outcome_unavailable", ~F.col("performance_eligible")), ("not_early_delivery", ~early), ("early_with_faster_stage", fast & full),
        ("early_with_faster_stage_partial_comparison", fast), ("early_without_faster_stage", full)], "early_insufficient_stage_evidence"))


def integrated_evidence(base: DataFrame, parts: list[DataFrame], codes: list[tuple[str, Column]]) -> DataFrame:
    """One wide row per order from evidence tables of order grain, with its evidence codes."""
    wide = reduce(lambda a, b: a.join(b, "order_id", "left"), parts, base)
    return wide.withColumn("evidence_codes", tristate.reasons([(n, tristate.known_true(c)) for n, c in codes]))


def signal_counts(warnings: DataFrame, evaluated: Column, signals: dict[str, str]) -> DataFrame:
    """Per order: models that scored it, models whose outcome is known, and per signal the warnings among the latter (null if none is)."""
    known = F.count(F.when(evaluated, 1))
    return warnings.groupBy("order_id").agg(F.count(F.lit(1)).alias("models_forecast"), known.alias("models_evaluated"), *[
        F.when(known > 0, F.count(F.when(evaluated & F.col(c), 1))).alias(name) for name, c in signals.items()])


def case_codes() -> list[tuple[str, Column]]:
    """The thirteen evidence codes over one wide row per order; an unknown condition gives no code."""
    # Names and order of the codes.
    return [
        ("visible_milestone_inversion", F.col("visible_inversions") > 0),
        ("incomplete_visible_trace", F.col("visible_events") < 4),
        ("equal_time_order_unresolved", F.col("has_equal_times")),
        ("geographic_context_withheld", ~F.col("all_pairs_quality_eligible")),
        ("multi_seller_no_individual_outcome_attribution", F.col("seller_count") > 1),
        ("limited_seller_history", F.col("history_route") != "single_seller_with_prior_outcomes"),
        ("no_prior_scoped_customer_purchase", F.col("prior_orders") == 0),
        ("observed_accounting_difference_not_fraud", F.col("payment_difference_cents") != 0),
        ("business_anchor_warning", F.col("profiles_with_warning") > 0),
        ("delivery_long_interval_warning", F.col("long_warnings") > 0),
        ("delivery_short_interval_warning", F.col("short_warnings") > 0),
        ("delivery_zero_duration_warning", F.col("zero_warnings") > 0),
        ("no_validation_model_result_here", F.col("profiles_scored").isNull() & F.col("models_forecast").isNull()),
    ]


def trace_shape(orders: DataFrame, times: list[str]) -> DataFrame:
    """Adds the number of visible milestones and whether two of them carry the same time."""
    seen = F.array_compact(F.array(*times))
    return orders.withColumns({"visible_events": F.size(seen).cast("long"), "has_equal_times": F.size(F.array_distinct(seen)) < F.size(seen)})


def source_rule_checks(orders: DataFrame, payments: DataFrame, items: DataFrame) -> DataFrame:
    """Recompute order aggregates from child rows and state one outcome per (order, scope)."""
    joined = orders.join(payments.groupBy("order_id").agg(F.count(F.lit(1)).alias("_pay"), tristate.complete_sum(F.col("payment_cents")).alias("_paid")), "order_id", "left").join(
        items.groupBy("order_id").agg(F.count(F.lit(1)).alias("_n"), tristate.complete_sum(F.col("price_cents") + F.col("freight_cents")).alias("_due")), "order_id", "left")

    def scope(name, pairs, default):
        return F.struct(F.lit(name).alias("scope"), tristate.first_match(pairs, default).alias("outcome"))

    return joined.select("order_id", F.explode(F.array(
        scope("timing", [("conflict", F.col("quality_conflict")), ("not_observed", F.col("promise_delta").isNull()), ("late", F.col("promise_delta") > 0)], "not_late"),
        scope("payment", [("no_child_records", F.col("_pay").isNull() | F.col("_n").isNull()), ("matched", F.col("_paid") == F.col("_due"))], "difference"),
        scope("contents", [("no_child_records", F.col("_n").isNull()), ("recorded_count_differs", F.col("item_count") != F.col("_n"))], "count_confirmed"))).alias("s")).select(
        "order_id", "s.*")


def finding_actions(stages: DataFrame, groups: DataFrame) -> DataFrame:
    """Signed margin of each stage to its upper boundary and the proposed check."""
    joined = stages.join(groups.select("group", "upper_boundary_days"), "group", "left")
    margin = F.when(F.col("assessable"), F.col(peers.DURATION) / 86400 - F.col("upper_boundary_days"))
    return joined.withColumn("margin_days", margin).withColumn("proposed_action", tristate.first_match([
        ("complete_missing_context", ~F.col("assessable")), ("verify_long_stage_source", tristate.known_true(F.col("long_stage_warning"))),
        ("verify_tied_timestamps", F.col(peers.DURATION) == 0)], "no_action"))
