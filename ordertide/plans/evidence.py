"""D12, D18-D20, D22-D23, F10, F14, A43-A46, A48-A49, E14, E22-E23, E27, E31, E35-E36."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordertide.functions import clock
from ordertide.operators import detectors, evaluation, evidence, features, forecasts, peers, performance, quality, relations
from ordertide.plans import detectors as det
from ordertide.plans import history as hist
from ordertide.plans import peers as peer_plans
from ordertide.plans.cleaning import scoped
from ordertide.plans.ctes import define, sql
from ordertide.plans.registry import query, rounded
from ordertide.session import materialize
from ordertide.sources.star_schema import SPLIT_BOUNDS, STAGES, TIMES

_CROSS = " OR ".join(f"coalesce({t}>=cutoff,false)" for t in TIMES)
define("av0", f"""SELECT *, CAST(epoch(approved_at)-epoch(purchased_at) AS BIGINT) AS approval_s, CAST(epoch(carrier_at)-epoch(approved_at) AS BIGINT) AS handling_s, CAST(epoch(delivered_at)-epoch(carrier_at) AS BIGINT) AS transport_s,
  datediff('day', estimated_at::DATE, delivered_at::DATE) AS late_days, completed_timing_eligible AND NOT ({_CROSS}) AND split<>'test' AS ok, ({_CROSS}) AND completed_timing_eligible AND split<>'test' AS crossing, total_cents>40000000 AS model FROM elig""")
define("lim", "SELECT " + ", ".join(f"quantile_cont({s}_s::DOUBLE,0.75)+1.5*(quantile_cont({s}_s::DOUBLE,0.75)-quantile_cont({s}_s::DOUBLE,0.25)) AS {s}_long, quantile_cont({s}_s::DOUBLE,0.75)+3*(quantile_cont({s}_s::DOUBLE,0.75)-quantile_cont({s}_s::DOUBLE,0.25)) AS {s}_severe, quantile_cont({s}_s::DOUBLE,0.01) AS {s}_short" for s, _, _ in STAGES) + " FROM av0 WHERE ok AND split='train'")
_W = " OR ".join(f"{s}_s>{s}_long OR {s}_s=0 OR ({s}_s>0 AND {s}_s<{s}_short)" for s, _, _ in STAGES)
define("av", f"""SELECT *, status_delivery_conflict OR has_reversed_milestones OR (order_status='delivered' AND missing_milestone_count>0) AS src, ok AND ({_W} OR late_days>0) AS tim FROM av0 CROSS JOIN lim""")
define("act", "SELECT *, CASE WHEN src THEN 'verify_source_record' WHEN coalesce(tim,false) THEN 'inspect_timing_warning' WHEN model THEN 'inspect_model_signal' WHEN NOT ok THEN 'insufficient_context' ELSE 'no_signal_in_available_checks' END AS auto_action FROM av")


def validated(shop):
    o = quality.usage_group(quality.timeline_flags(shop.orders)).withColumns({
        "split": clock.split_of(F.col("purchased_at"), SPLIT_BOUNDS), "cutoff": clock.cutoff_of(F.col("purchased_at"), SPLIT_BOUNDS),
        "purchase_month": clock.month(F.col("purchased_at")), "days_late": performance.promise_delta(F.col("delivered_at"), F.col("estimated_at")),
        "model_candidate_signal": F.col("total_cents") > 40000000, **{f"{s}_s": clock.seconds_between(F.col(a), F.col(b)) for s, a, b in STAGES}})
    crosses = quality.tristate.any_of(*[F.coalesce(F.col(t) >= F.col("cutoff"), F.lit(False)) for t in TIMES])
    usable = F.col("completed_timing_eligible") & (F.col("split") != "test")
    o = o.withColumns({"timing_rules_available": usable & ~crosses,
                       "timing_input_reason": F.when(usable & crosses, "completion_not_before_partition_cutoff").otherwise("other")})
    return evidence.auto_validate(o, evidence.duration_limits(o.where("timing_rules_available AND split = 'train'")))


@query("d12_auto_validate_rules", sql("SELECT order_id, auto_action FROM act"))
def auto_validate(shop):
    return validated(shop).select("order_id", "auto_action")


@query("d12_reason_summary", sql("SELECT split, reason_code, count(*) AS orders FROM (" + " UNION ALL ".join([
    "SELECT split, 'STATUS_DELIVERY_CONFLICT' AS reason_code FROM av WHERE status_delivery_conflict", "SELECT split, 'RECORDED_TIMELINE_REVERSAL' FROM av WHERE has_reversed_milestones",
    "SELECT split, 'DELIVERED_MISSING_MILESTONE' FROM av WHERE order_status='delivered' AND missing_milestone_count>0", "SELECT split, 'INCOMPLETE_CLOSED_STATUS' FROM av WHERE order_status='canceled' AND missing_milestone_count>0",
    "SELECT split, 'NONFINAL_CUTOFF_UNKNOWN' FROM av WHERE order_status NOT IN ('canceled','delivered') AND missing_milestone_count>0", "SELECT split, 'TIMING_OUTSIDE_PARTITION_CUTOFF' FROM av WHERE crossing",
    "SELECT split, 'LONG_DURATION' FROM av WHERE ok AND (" + " OR ".join(f"{s}_s>{s}_long" for s, _, _ in STAGES) + ")", "SELECT split, 'SEVERE_LONG_DURATION' FROM av WHERE ok AND (" + " OR ".join(f"{s}_s>{s}_severe" for s, _, _ in STAGES) + ")",
    "SELECT split, 'ZERO_DURATION_WARNING' FROM av WHERE ok AND (" + " OR ".join(f"{s}_s=0" for s, _, _ in STAGES) + ")", "SELECT split, 'SHORT_DURATION_WARNING' FROM av WHERE ok AND (" + " OR ".join(f"({s}_s>0 AND {s}_s<{s}_short)" for s, _, _ in STAGES) + ")",
    "SELECT split, 'AFTER_ESTIMATED_DATE_WARNING' FROM av WHERE ok AND late_days>0", "SELECT split, 'MODEL_CANDIDATE_SIGNAL' FROM av WHERE model"]) + ") GROUP BY 1,2"))
def reason_summary(shop):
    return evidence.reason_rows(validated(shop)).groupBy("split", "reason_code").agg(F.count_distinct("order_id").alias("orders"))


@query("f14_json_evidence_fields", sql("SELECT auto_action, count(*) AS orders FROM act WHERE src OR coalesce(tim,false) OR model OR crossing OR missing_milestone_count>0 GROUP BY 1"))
def json_fields(shop):
    v = validated(shop).where(F.size("reasons") > 0).select("auto_action", F.to_json("reasons").alias("j"))
    back = v.select("auto_action", F.from_json("j", "array<struct<reason_code:string,kind:string,feature:string>>").alias("r"))
    return back.where(F.size("r") > 0).groupBy("auto_action").agg(F.count(F.lit(1)).alias("orders"))


@query("a49_monthly_action_summary", sql("SELECT split, strftime(purchased_at,'%Y-%m') AS purchase_month, auto_action, count(*) AS orders, count(*) FILTER (WHERE ok) AS timing_available, count(*) FILTER (WHERE ok AND ("
    + " OR ".join(f"{s}_s>{s}_long" for s, _, _ in STAGES) + ")) AS long_warnings, count(*) FILTER (WHERE ok AND (" + " OR ".join(f"({s}_s>0 AND {s}_s<{s}_short)" for s, _, _ in STAGES) + ")) AS short_warnings FROM act GROUP BY 1,2,3"))
def monthly(shop):
    return evidence.monthly_actions(validated(shop))


def ranked(shop):
    return peers.stage_signals(peer_plans.eligible_candidates(shop), peer_plans.reference(shop))


define("osig", "SELECT order_id, count(*) FILTER (WHERE assessment_status='assessable') AS n, count(*) FILTER (WHERE is_long OR is_short) AS w FROM sig WHERE assessment_status IN ('assessable','context_reference_unavailable') GROUP BY 1")


@query("d19_evidence_policy", sql("""SELECT order_id, CASE WHEN quality_conflict THEN 'recorded_conflict_requires_verification' WHEN purchased_at IS NULL OR approved_at IS NULL OR carrier_at IS NULL OR delivered_at IS NULL THEN 'incomplete_at_observation_cutoff' ELSE 'no_conflict_in_executed_timing_checks' END AS source_quality_status,
 CASE WHEN payment_sum_cents-items_plus_freight_cents IS NULL THEN 'not_assessable' WHEN payment_sum_cents<>items_plus_freight_cents THEN 'difference_requires_verification' ELSE 'matched_exactly' END AS payment_reconciliation,
 CASE WHEN n=3 AND w>0 THEN 'statistical_warning_not_confirmed_anomaly' WHEN n=3 THEN 'no_warning_under_working_reference' WHEN w>0 THEN 'partial_context_warning_other_stages_unassessed' ELSE 'not_assessable' END AS timing_signal_status
FROM perf LEFT JOIN ipay USING (order_id) LEFT JOIN iitem i USING (order_id) LEFT JOIN osig USING (order_id) WHERE split='validation'"""))
def evidence_policy(shop):
    paid = features.payment_reconciliation(features.rollup_payments(shop.payments).join(features.rollup_items(shop.items), "order_id")).select("order_id", "payment_difference_cents")
    base = shop.performance.where("split = 'validation'").join(paid, "order_id", "left")
    return evidence.evidence_policy(base, peers.order_signals(ranked(shop))).select("order_id", "source_quality_status", "payment_reconciliation", "timing_signal_status")


@query("d18_percentile_sensitivity", sql("SELECT stage, u::DOUBLE AS upper, count(*) AS assessed, count(*) FILTER (WHERE duration_s>0 AND ref_upto>u*ref_n) AS warnings FROM sig, (VALUES (0.8),(0.9),(0.95)) v(u) WHERE assessment_status='assessable' GROUP BY 1,2"))
def sensitivity(shop):
    return evidence.percentile_sensitivity(ranked(shop), [0.8, 0.9, 0.95])


UPPERS = [0.8, 0.9, 0.95, 0.99]
define("gref", "SELECT stage, duration_s, sum(count(*)) OVER (PARTITION BY stage ORDER BY duration_s)::BIGINT AS upto, sum(count(*)) OVER (PARTITION BY stage)::BIGINT AS n FROM srow WHERE split='train' AND duration_eligible GROUP BY 1,2")
define("gcx", f"""SELECT order_id, performance_state, u::DOUBLE AS upper, bool_or(s.duration_s>0 AND coalesce(g.upto,0)>u::DOUBLE*t.n) AS global_warning, bool_or(s.duration_s>0 AND s.ref_upto>u::DOUBLE*s.ref_n) AS context_warning
FROM sig s JOIN (SELECT stage, max(n) AS n FROM gref GROUP BY 1) t USING (stage) ASOF LEFT JOIN gref g ON g.stage=s.stage AND g.duration_s<=s.duration_s, (VALUES {', '.join(f'({u})' for u in UPPERS)}) v(u)
WHERE assessment_status='assessable' AND performance_eligible GROUP BY 1,2,3 HAVING count(*)=3""")
_METHOD = """SELECT '{0}_ecdf' AS method, upper, count(*) AS common_orders, count(*) FILTER (WHERE {0}_warning) AS warning_orders, round(count(*) FILTER (WHERE {0}_warning)/count(*),6) AS warning_fraction, count(*) FILTER (WHERE performance_state='late') AS late_promise_orders,
 count(*) FILTER (WHERE performance_state='late' AND {0}_warning) AS late_promise_with_warning, count(*) FILTER (WHERE performance_state='late' AND NOT {0}_warning) AS late_promise_without_warning, count(*) FILTER (WHERE performance_state<>'late' AND {0}_warning) AS meets_promise_with_warning,
 count(*) FILTER (WHERE context_warning AND NOT global_warning) AS context_only_warnings, count(*) FILTER (WHERE global_warning AND NOT context_warning) AS global_only_warnings FROM gcx GROUP BY 2"""


def both_methods(shop):
    return evidence.global_and_context(ranked(shop), peer_plans.reference(shop), UPPERS)


@query("d18_global_and_context", sql(" UNION ALL ".join(_METHOD.format(m) for m in ("global", "context"))))
def method_sensitivity(shop):
    return rounded(evidence.method_sensitivity(both_methods(shop)))


@query("d18_method_disagreements", sql("SELECT order_id, performance_state, upper, global_warning, context_warning, 'unresolved' AS correct_detector FROM gcx WHERE global_warning<>context_warning"))
def method_disagreements(shop):
    return evidence.method_disagreements(both_methods(shop))


define("med", "SELECT grp, quantile_cont(duration_s::DOUBLE,0.5)/86400 AS md FROM bank JOIN gstat USING (grp) GROUP BY 1")
define("cmp", "SELECT s.*, CASE WHEN assessment_status<>'assessable' THEN 'unavailable' WHEN duration_s=0 THEN 'zero_recorded_duration' WHEN duration_s/86400<md THEN 'faster' WHEN duration_s/86400>md THEN 'slower' ELSE 'equal' END AS dir FROM sig s LEFT JOIN med USING (grp) WHERE assessment_status IN ('assessable','context_reference_unavailable')")


@query("a33_excess_by_dimension", sql(" UNION ALL ".join(f"""SELECT stage, '{d}' AS dimension, {v} AS group_value, count(*) AS assessed_orders, count(*) FILTER (WHERE duration_s/86400>md) AS orders_above_peers, round(sum(greatest(0.0, duration_s/86400-md)),3) AS excess_days,
 round(quantile_cont(duration_s::DOUBLE,0.5)/86400,3) AS own_median_days FROM sig LEFT JOIN med USING (grp) WHERE assessment_status='assessable' GROUP BY 1,3""" for d, v in [("overall", "'all'"), ("customer_state", "customer_state"), ("purchase_month", "purchase_month"), ("distance_band", "distance_band")])))
def excess_by_dimension(shop):
    return rounded(evidence.excess_by_dimension(ranked(shop), peers.reference_groups(peer_plans.reference(shop)), ["customer_state", "purchase_month", "distance_band"]), 3)


@query("f10_stage_comparison", sql("""WITH o AS (SELECT order_id, performance_state, performance_eligible, count(*) FILTER (WHERE dir='faster') AS faster_stages, count(*) FILTER (WHERE dir='slower') AS slower_stages, count(*) FILTER (WHERE dir IN ('faster','slower','equal')) AS compared_stages FROM cmp GROUP BY 1,2,3)
SELECT order_id, faster_stages, slower_stages, compared_stages, CASE WHEN NOT performance_eligible THEN 'delivery_outcome_unavailable' WHEN performance_state<>'early' THEN 'not_early_delivery' WHEN faster_stages>0 AND compared_stages=3 THEN 'early_with_faster_stage' WHEN faster_stages>0 THEN 'early_with_faster_stage_partial_comparison'
 WHEN compared_stages=3 THEN 'early_without_faster_stage' ELSE 'early_insufficient_stage_evidence' END AS early_delivery_explanation FROM o"""))
def stage_comparison(shop):
    compared = evidence.stage_comparison(ranked(shop), peers.reference_groups(peer_plans.reference(shop)))
    return evidence.early_explanation(compared).drop("performance_state", "performance_eligible")


@query("a43_followup_audit", sql("""SELECT purchase_month, h::INTEGER AS horizon_days, CASE WHEN carrier_at IS NULL THEN 'carrier_not_recorded_before_cutoff' WHEN coalesce(carrier_at<purchased_at,false) OR coalesce(delivered_at<carrier_at,false) THEN 'invalid_visible_stage_chronology'
 WHEN NOT carrier_at + to_days(h) < cutoff THEN 'insufficient_followup' WHEN delivered_at IS NULL THEN 'no_delivery_recorded_before_cutoff' WHEN delivered_at<=carrier_at+to_days(h) THEN 'delivery_recorded_within_horizon' ELSE 'delivery_recorded_after_horizon_before_cutoff' END AS followup_state, count(*) AS orders
FROM perf, (VALUES (14),(30),(45)) v(h) WHERE split='validation' GROUP BY 1,2,3"""))
def followup(shop):
    return forecasts.followup_audit(shop.performance.where("split = 'validation'"), [14, 30, 45]).groupBy("purchase_month", "horizon_days", "followup_state").agg(
        F.count(F.lit(1)).alias("orders"))


# --- forecasts on the order matrix ----------------------------------------------------------------

LEVELS = {"state_distance_band": ["raw_status", "band"], "distance_band": ["band"]}
define("fx", "SELECT *, CASE WHEN quantity<50 THEN 'small' WHEN quantity<400 THEN 'middle' ELSE 'large' END AS band FROM meas")
define("fq", """SELECT 'state_distance_band' AS route, raw_status, band, count(*) AS support, quantile_cont(price_cents::DOUBLE,0.05) AS low, quantile_cont(price_cents::DOUBLE,0.5) AS mid, quantile_cont(price_cents::DOUBLE,0.95) AS high FROM fx WHERE role='fit' GROUP BY 2,3 HAVING count(*)>=50
 UNION ALL SELECT 'distance_band', NULL, band, count(*), quantile_cont(price_cents::DOUBLE,0.05), quantile_cont(price_cents::DOUBLE,0.5), quantile_cont(price_cents::DOUBLE,0.95) FROM fx WHERE role='fit' GROUP BY 3 HAVING count(*)>=50
 UNION ALL SELECT 'global', NULL, NULL, count(*), quantile_cont(price_cents::DOUBLE,0.05), quantile_cont(price_cents::DOUBLE,0.5), quantile_cont(price_cents::DOUBLE,0.95) FROM fx WHERE role='fit'""")
define("fp", """SELECT f.*, coalesce(a.route,b.route,g.route) AS route, coalesce(a.support,b.support,g.support) AS support, coalesce(a.low,b.low,g.low) AS low, coalesce(a.mid,b.mid,g.mid) AS mid, coalesce(a.high,b.high,g.high) AS high FROM fx f
  LEFT JOIN (SELECT * FROM fq WHERE route='state_distance_band') a ON a.raw_status=f.raw_status AND a.band=f.band LEFT JOIN (SELECT * FROM fq WHERE route='distance_band') b ON b.band=f.band, (SELECT * FROM fq WHERE route='global') g WHERE f.role<>'fit'""")
define("sh", "SELECT quantile_cont(price_cents-low,0.05) AS ls, quantile_cont(price_cents-high,0.95) AS us FROM fp WHERE role='calibration'")
define("fc", "SELECT fp.* REPLACE (greatest(0.0, least(low+ls, mid)) AS low, greatest(high+us, mid) AS high) FROM fp CROSS JOIN sh WHERE role='validation'")


def predicted(shop):
    if "predicted" not in shop.__dict__:
        rows = det.matrix(shop).withColumn("band", F.when(F.col("quantity") < 50, "small").when(F.col("quantity") < 400, "middle").otherwise("large"))
        shop.__dict__["predicted_fit"] = rows.where("role = 'fit'")
        shop.__dict__["predicted"] = materialize(forecasts.peer_quantile_forecast(rows.where("role <> 'fit'"), rows.where("role = 'fit'"), "price_cents", LEVELS), "forecasts")
    return shop.__dict__["predicted"]


def calibrated(shop):
    p = predicted(shop)
    return forecasts.calibrate(p.where("role = 'validation'"), forecasts.conformal_shift(p.where("role = 'calibration'"), "price_cents"))


@query("d20_peer_quantile_forecast", sql("SELECT order_id, role, route, support, round(low,4) AS low, round(mid,4) AS mid, round(high,4) AS high FROM fp"))
def peer_forecast(shop):
    return rounded(predicted(shop).select("order_id", "role", "route", "support", "low", "mid", "high"), 4)


@query("d22_conformal_shift", sql("SELECT order_id, round(low,3) AS low, round(mid,3) AS mid, round(high,3) AS high FROM fc"))
def conformal(shop):
    return rounded(calibrated(shop).select("order_id", "low", "mid", "high"), 3)


@query("d23_forecast_routes", sql("""SELECT order_id, route, band NOT IN (SELECT band FROM fx WHERE role='fit') AS unseen_category, price_cents>high AS long_warning, price_cents>0 AND price_cents<low AS short_warning, price_cents=0 AS zero_warning, round(greatest(price_cents-high,0),3) AS excess_above_upper FROM fc"""))
def routes(shop):
    c = calibrated(shop)
    r = forecasts.forecast_routes(c, shop.__dict__["predicted_fit"], "band", "price_cents")
    return rounded(r.select("order_id", "route", "unseen_category", "long_warning", "short_warning", "zero_warning", "excess_above_upper"), 3)


@query("e22_interval_evaluation", sql("""SELECT route, raw_status, grouping_id(raw_status, route) AS grouping, count(*) AS orders, round(avg(abs(price_cents-mid)),2) AS absolute_error, round(avg(CAST(price_cents BETWEEN low AND high AS INT)),6) AS covered, round(avg(high-low),2) AS width
FROM fc GROUP BY GROUPING SETS ((route),(route,raw_status))"""))
def interval_evaluation(shop):
    e = forecasts.interval_evaluation(calibrated(shop), "price_cents", [["route"], ["route", "raw_status"]])
    return e.select("route", "raw_status", "grouping", "orders", F.round("absolute_error", 2).alias("absolute_error"), F.round("covered", 6).alias("covered"), F.round("width", 2).alias("width"))


@query("e23_horizon_scores", sql(" UNION ALL ".join(f"""SELECT route, {h}::DOUBLE AS horizon, count(*) AS orders, count(y) AS known_outcomes, round(avg(CASE WHEN y IS NULL THEN 0 ELSE abs(least(y,{h})-least(mid,{h})) END),2) AS mae_lower,
 round(avg(CASE WHEN y IS NULL THEN greatest(least(mid,{h}),{h}-least(mid,{h})) ELSE abs(least(y,{h})-least(mid,{h})) END),2) AS mae_upper FROM (SELECT route, mid, CASE WHEN raw_status='F' THEN price_cents::DOUBLE END AS y FROM fc) GROUP BY 1""" for h in [5000000, 20000000])))
def horizon(shop):
    return rounded(forecasts.horizon_scores(calibrated(shop), F.when(F.col("raw_status") == "F", F.col("price_cents").cast("double")), [5000000, 20000000], ["route"]), 2)


define("two", "SELECT order_id, 'peer' AS model, raw_status, price_cents>high AS lw, price_cents<low AND price_cents>0 AS sw, price_cents=0 AS zw FROM fc UNION ALL SELECT order_id, 'global', fc.raw_status, price_cents>g.high, price_cents<g.low AND price_cents>0, price_cents=0 FROM fc, (SELECT * FROM fq WHERE route='global') g")


def two_models(shop):
    c = calibrated(shop)
    peer = forecasts.forecast_routes(c, shop.__dict__["predicted_fit"], "band", "price_cents").withColumn("model", F.lit("peer"))
    base = forecasts.peer_quantile_forecast(c.drop("route", "support", "low", "mid", "high"), shop.__dict__["predicted_fit"], "price_cents", {})
    glob = forecasts.forecast_routes(base, shop.__dict__["predicted_fit"], "band", "price_cents").withColumn("model", F.lit("global"))
    cols = ["order_id", "model", "raw_status", "long_warning", "short_warning", "zero_warning"]
    return peer.select(*cols).unionByName(glob.select(*cols))


define("hroute", """SELECT DISTINCT order_id, CASE WHEN seller_count>1 THEN 'multi_seller_use_pair_context' WHEN done>0 THEN 'single_seller_with_prior_outcomes' WHEN prior>0 THEN 'single_seller_purchase_history_only' ELSE 'single_seller_no_prior_history' END AS history_route
 FROM (SELECT a.order_id, a.seller_count, (SELECT count(*) FROM pairs b WHERE b.seller_id=a.seller_id AND b.as_of_s<a.as_of_s) AS prior, (SELECT count(*) FROM outcome c WHERE c.seller_id=a.seller_id AND c.delivered_s<a.as_of_s) AS done FROM pairs a)""")
define("okzip", "SELECT zip FROM zscreen WHERE reasons NOT LIKE '%insufficient%'")
define("goq", "SELECT order_id, bool_and(distance_km IS NOT NULL AND customer_zip IN (SELECT zip FROM okzip) AND seller_zip IN (SELECT zip FROM okzip)) AS quality FROM dist GROUP BY 1")
define("anchor", "SELECT order_id, count(*) AS profiles_scored, count(*) FILTER (WHERE flag) AS profiles_with_warning FROM flg WHERE role='validation' AND candidate IN ('mad_raw_k25','mad_log1p_k25') GROUP BY 1")
define("dm", """SELECT order_id, count(*) AS models_forecast, count(*) FILTER (WHERE raw_status='F') AS models_evaluated, CASE WHEN bool_or(raw_status='F') THEN count(*) FILTER (WHERE raw_status='F' AND lw) END AS lw,
 CASE WHEN bool_or(raw_status='F') THEN count(*) FILTER (WHERE raw_status='F' AND sw) END AS sw, CASE WHEN bool_or(raw_status='F') THEN count(*) FILTER (WHERE raw_status='F' AND zw) END AS zw FROM two GROUP BY 1""")
define("cprior", "SELECT a.order_id, count(b.order_id) AS prior_orders FROM ord a LEFT JOIN ord b ON a.customer_id=b.customer_id AND b.purchased_at<a.purchased_at GROUP BY 1")
define("cev", """SELECT p.order_id, split, visible_events, list_distinct_n<visible_events AS has_equal_times, quality AS all_pairs_quality_eligible, history_route, prior_orders, payment_sum_cents-items_plus_freight_cents AS payment_difference_cents,
 profiles_scored, profiles_with_warning, models_forecast, models_evaluated, lw AS long_warnings, sw AS short_warnings, zw AS zero_warnings, visible_inversions, p.seller_count
 FROM (SELECT *, ((purchased_at IS NOT NULL)::INT+(approved_at IS NOT NULL)::INT+(carrier_at IS NOT NULL)::INT+(delivered_at IS NOT NULL)::INT)::BIGINT AS visible_events, len(list_distinct([purchased_at,approved_at,carrier_at,delivered_at])) AS list_distinct_n FROM perf) p
 LEFT JOIN ipay USING (order_id) LEFT JOIN (SELECT order_id, items_plus_freight_cents FROM iitem) USING (order_id) LEFT JOIN goq USING (order_id) LEFT JOIN hroute USING (order_id) LEFT JOIN cprior USING (order_id) LEFT JOIN anchor USING (order_id) LEFT JOIN dm USING (order_id)""")
_CODES = {"visible_milestone_inversion": "visible_inversions>0", "incomplete_visible_trace": "visible_events<4", "equal_time_order_unresolved": "has_equal_times", "geographic_context_withheld": "NOT all_pairs_quality_eligible",
          "multi_seller_no_individual_outcome_attribution": "seller_count>1", "limited_seller_history": "history_route<>'single_seller_with_prior_outcomes'", "no_prior_scoped_customer_purchase": "prior_orders=0",
          "observed_accounting_difference_not_fraud": "payment_difference_cents<>0", "business_anchor_warning": "profiles_with_warning>0", "delivery_long_interval_warning": "long_warnings>0",
          "delivery_short_interval_warning": "short_warnings>0", "delivery_zero_duration_warning": "zero_warnings>0", "no_validation_model_result_here": "profiles_scored IS NULL AND models_forecast IS NULL"}
_CASE_COLS = ["order_id", "split", "visible_events", "has_equal_times", "all_pairs_quality_eligible", "history_route", "prior_orders", "payment_difference_cents", "profiles_scored", "profiles_with_warning",
              "models_forecast", "models_evaluated", "long_warnings", "short_warnings", "zero_warnings"]
_CODED = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _CODES.items()) + ")"


def case_evidence(shop):
    """Every order with process, payment, customer, geography, seller, business and delivery evidence; both queries read one written table."""
    if "case_evidence" not in shop.__dict__:
        paid = features.payment_reconciliation(features.rollup_payments(shop.payments).join(
            features.rollup_items(shop.items).drop("item_count", "product_count", "seller_count"), "order_id")).select("order_id", "payment_difference_cents")
        hist.written_pairs(shop)  # read by the distances and by the routes
        places = hist.geo_order_quality(shop).select("order_id", "all_pairs_quality_eligible")
        routes_ = hist.history_route(shop).select("order_id", "history_route").distinct()
        prior = hist.customer_prior(shop).select("order_id", "prior_orders")
        anchors = det.flags(shop).where("role = 'validation' AND candidate IN ('mad_raw_k25', 'mad_log1p_k25')").groupBy("order_id").agg(
            F.count(F.lit(1)).alias("profiles_scored"), F.count(F.when(F.col("flag"), 1)).alias("profiles_with_warning"))
        models = evidence.signal_counts(two_models(shop), F.col("raw_status") == "F",
                                        {"long_warnings": "long_warning", "short_warnings": "short_warning", "zero_warnings": "zero_warning"})
        base = evidence.trace_shape(shop.performance, TIMES)
        wide = evidence.integrated_evidence(base, [paid, places, routes_, prior, anchors, models], evidence.case_codes())
        shop.__dict__["case_evidence"] = materialize(wide.select(*_CASE_COLS, "evidence_codes"), "case-evidence")
    return shop.__dict__["case_evidence"]


@query("a48_integrated_case_evidence", sql(f"SELECT {', '.join(_CASE_COLS)}, {_CODED} AS evidence_codes FROM cev"))
def integrated(shop):
    return case_evidence(shop).withColumn("evidence_codes", F.array_join("evidence_codes", ","))


@query("a48_evidence_coverage", sql(" UNION ALL ".join(f"SELECT split, '{n}' AS evidence_code, count(*) AS orders, count(*) FILTER (WHERE {c}) AS orders_with_code FROM cev GROUP BY 1" for n, c in _CODES.items())))
def evidence_coverage(shop):
    names = F.array(*[F.lit(n) for n, _ in evidence.case_codes()])
    return case_evidence(shop).select("split", "evidence_codes", F.explode(names).alias("evidence_code")).groupBy("split", "evidence_code").agg(
        F.count(F.lit(1)).alias("orders"), F.count(F.when(F.array_contains("evidence_codes", F.col("evidence_code")), 1)).alias("orders_with_code"))


@query("e35_model_outcome_overlap", sql("SELECT model, count(*) AS orders, count(*) FILTER (WHERE lw AND raw_status='F') AS warned_and_late, count(*) FILTER (WHERE lw AND raw_status<>'F') AS warned_not_late, count(*) FILTER (WHERE NOT lw AND raw_status='F') AS late_not_warned FROM two GROUP BY 1"))
def outcome_overlap(shop):
    return forecasts.model_outcome_overlap(two_models(shop), F.col("raw_status") == "F")


@query("e36_model_consensus_counts", sql("SELECT order_id, count(DISTINCT model) AS models_evaluated, count(*) FILTER (WHERE lw) AS long_warnings, count(*) FILTER (WHERE sw) AS short_warnings, count(*) FILTER (WHERE zw) AS zero_warnings, count(DISTINCT model)=2 AS complete_comparison, count(DISTINCT lw)>1 AS disagreement FROM two GROUP BY 1"))
def consensus(shop):
    return forecasts.model_consensus(two_models(shop), ["peer", "global"])


@query("a44_shift_decomposition", sql("""WITH c AS (SELECT discount_points AS g, count(*) FILTER (WHERE role='calibration') AS na, count(*) FILTER (WHERE role<>'calibration') AS nb, sum(quantity) FILTER (WHERE role='calibration') AS sa, sum(quantity) FILTER (WHERE role<>'calibration') AS sb FROM meas WHERE role<>'fit' GROUP BY 1 HAVING na>=20 AND nb>=20),
w AS (SELECT *, na/sum(na) OVER () AS pa, nb/sum(nb) OVER () AS pb, sa/na AS ma, sb/nb AS mb FROM c)
SELECT count(*) AS common_groups, round(sum(sa)/sum(na)-sum(sb)/sum(nb),6) AS gap, round(sum((pa-pb)*(ma+mb)/2),6) AS composition_component, round(sum((ma-mb)*(pa+pb)/2),6) AS within_group_component FROM w"""))
def decomposition(shop):
    return rounded(forecasts.shift_decomposition(shop.measures.where("role <> 'fit'"), "discount_points", F.col("role") == "calibration", "quantity"))


@query("a45_error_concentration", sql("""WITH e AS (SELECT role, abs(quantity-100) AS e, quantity-100 AS s, row_number() OVER (PARTITION BY role ORDER BY abs(quantity-100) DESC, order_id) AS rn, count(*) OVER (PARTITION BY role) AS n FROM meas)
SELECT role, max(n) AS orders, sum(e)::BIGINT AS total_error, sum(e) FILTER (WHERE rn<=ceil(n/10.0))::BIGINT AS worst_tenth_error, count(*) FILTER (WHERE s>0) AS under_predicted, round(sum(e) FILTER (WHERE rn<=ceil(n/10.0))/sum(e),6) AS worst_tenth_share, round(count(*) FILTER (WHERE s>0)/count(*),6) AS under_prediction_share FROM e GROUP BY 1"""))
def concentration(shop):
    e = shop.measures.select("role", F.abs(F.col("quantity") - 100).alias("e"), (F.col("quantity") - 100).alias("s"))
    return rounded(forecasts.error_concentration(e, ["role"], "e", "s"))


@query("a45_error_quantiles", sql("""SELECT role, count(*) AS orders, round(avg(quantity),6) AS actual_mean, round(avg(quantity-100),6) AS mean_signed_error, round(quantile_cont(quantity::DOUBLE,0.5),6) AS actual_median, round(quantile_cont(quantity::DOUBLE,0.9),6) AS actual_p90,
 round(quantile_cont(abs(quantity-100)::DOUBLE,0.9),6) AS absolute_error_p90 FROM meas GROUP BY 1"""))
def error_quantiles(shop):
    return rounded(forecasts.error_quantiles(shop.measures.withColumn("s", F.col("quantity") - 100), ["role"], "quantity", "s"))


@query("a46_fit_quantiles", sql(" UNION ALL ".join(f"""SELECT '{f}' AS feature, count(*) AS fit_rows, min({f}) AS fit_min, max({f}) AS fit_max, round(quantile_cont({f}::DOUBLE,0.01),6) AS fit_q01, round(quantile_cont({f}::DOUBLE,0.5),6) AS fit_median, round(quantile_cont({f}::DOUBLE,0.99),6) AS fit_q99
 FROM meas WHERE role='fit'""" for f in det.FEATURES)))
def fit_quantiles(shop):
    return rounded(forecasts.fit_quantiles(shop.measures, det.FEATURES, F.col("role") == "fit"))


@query("a46_group_support", sql("""WITH f AS (SELECT raw_status, quantity//50 AS b, count(*) AS k FROM meas WHERE role='fit' GROUP BY 1,2), l AS (SELECT role, raw_status, quantity//50 AS b, count(*) AS n FROM meas WHERE role<>'fit' GROUP BY 1,2,3)
SELECT role, sum(n)::BIGINT AS rows, coalesce(sum(n) FILTER (WHERE k IS NULL),0)::BIGINT AS unseen_rows, count(*) FILTER (WHERE k IS NULL) AS unseen_groups, min(coalesce(k,0))::BIGINT AS least_fit_rows FROM l LEFT JOIN f USING (raw_status, b) GROUP BY 1"""))
def group_support(shop):
    banded = shop.measures.withColumn("b", F.floor(F.col("quantity") / 50))
    return forecasts.group_support(banded, ["raw_status", "b"], F.col("role") == "fit", "role")


@query("a46_feature_shift", sql(" UNION ALL ".join(f"""SELECT '{f}' AS feature, role, (SELECT min({f}) FROM meas WHERE role='fit') AS fit_min, (SELECT max({f}) FROM meas WHERE role='fit') AS fit_max, count(*) AS rows, count(*) FILTER (WHERE {f}<(SELECT min({f}) FROM meas WHERE role='fit') OR {f}>(SELECT max({f}) FROM meas WHERE role='fit')) AS outside_rows,
 round(quantile_cont({f}::DOUBLE,0.5),6) AS median, round(count(*) FILTER (WHERE {f}<(SELECT min({f}) FROM meas WHERE role='fit') OR {f}>(SELECT max({f}) FROM meas WHERE role='fit'))/count(*),6) AS outside_fraction FROM meas WHERE role<>'fit' GROUP BY 2""" for f in det.FEATURES)))
def feature_shift(shop):
    return rounded(forecasts.feature_shift(shop.measures, det.FEATURES, F.col("role") == "fit", "role"))


@query("e27_batch_scope", """WITH b AS (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate>=TIMESTAMP '2001-01-01'), k AS (SELECT l_orderkey FROM lineitem WHERE l_shipdate<TIMESTAMP '1996-01-01')
SELECT count(*) AS batch_orders, count(*) FILTER (WHERE o_orderkey IN (SELECT l_orderkey FROM k)) AS overlap_known, count(*) FILTER (WHERE o_orderdate>=TIMESTAMP '2001-07-01') AS outside_window FROM b""")
def batch_scope(shop):
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    b = shop.table("orders").where(F.col("o_orderdate") >= day("2001-01-01"))
    known = shop.table("lineitem").where(F.col("l_shipdate") < day("1996-01-01")).select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("known", F.lit(True))
    return b.join(known, "o_orderkey", "left").agg(F.count(F.lit(1)).alias("batch_orders"), F.count("known").alias("overlap_known"),
                                                   F.count(F.when(F.col("o_orderdate") >= day("2001-07-01"), 1)).alias("outside_window"))


@query("d21_gbt_median_forecast")
def gbt(shop):
    m = shop.measures
    return forecasts.gbt_median_forecast(m.where("role = 'validation'"), m.where("role = 'fit'"), "price_cents", ["quantity", "discount_points"],
                                         ["raw_status"], iterations=5).select("order_id", "mid")


@query("e14_profile_ablation_compare", sql("""WITH p AS (SELECT order_id, month, bool_or(flag) FILTER (WHERE candidate='mad_raw_k25') AS l, bool_or(flag) FILTER (WHERE candidate='mad_log1p_k25') AS r FROM flg WHERE candidate IN ('mad_raw_k25','mad_log1p_k25') GROUP BY 1,2)
SELECT month, count(*) AS compared, count(*) FILTER (WHERE l AND r) AS both, count(*) FILTER (WHERE l AND NOT r) AS only_left, count(*) FILTER (WHERE NOT l AND r) AS only_right, count(*) FILTER (WHERE l<>r) AS changed_cases FROM p GROUP BY 1"""))
def ablation(shop):
    return evaluation.profile_compare(det.flags(shop), "mad_raw_k25", "mad_log1p_k25", ["month"])


@query("e20_holdout_evaluate", sql("""SELECT holdout_status, month, count(*) AS orders, count(*) FILTER (WHERE flag AND y) AS tp, count(*) FILTER (WHERE flag AND NOT y) AS fp FROM (SELECT *, CASE WHEN role='calibration' THEN 'reserved_for_calibration' WHEN score<=0 THEN 'no_positive_score' ELSE 'evaluated' END AS holdout_status
 FROM flg WHERE candidate='mad_raw_k25') GROUP BY 1,2"""))
def holdout(shop):
    f = evaluation.holdout_scope(det.flags(shop).where("candidate = 'mad_raw_k25'"), [("reserved_for_calibration", F.col("role") == "calibration"), ("no_positive_score", F.col("score") <= 0)])
    n = lambda c: F.count(F.when(c, 1))
    return f.groupBy("holdout_status", "month").agg(F.count(F.lit(1)).alias("orders"), n(F.col("flag") & F.col("y")).alias("tp"), n(F.col("flag") & ~F.col("y")).alias("fp"))


@query("e31_if_sensitivity", sql("""WITH s AS (SELECT order_id, max(score) FILTER (WHERE score_column='mad_log1p') AS score, max(score) FILTER (WHERE score_column='iqr_raw')>1.0 AS b FROM bs GROUP BY 1), q AS (SELECT c::DOUBLE AS contamination, (SELECT quantile_cont(score,1-c) FROM s) AS cut FROM (VALUES (0.01),(0.05),(0.1)) v(c)),
t AS (SELECT contamination, count(*) AS cases, count(*) FILTER (WHERE score>cut) AS flagged, count(*) FILTER (WHERE b) AS base_flagged, count(*) FILTER (WHERE score>cut AND b) AS both_flag FROM s CROSS JOIN q GROUP BY 1)
SELECT *, round(both_flag/nullif(flagged+base_flagged-both_flag,0),6) AS jaccard, round(((2*both_flag+cases-flagged-base_flagged)/cases-(flagged*base_flagged+(cases-flagged)*(cases-base_flagged))/(cases*cases))/(1-(flagged*base_flagged+(cases-flagged)*(cases-base_flagged))/(cases*cases)),6) AS kappa FROM t""".replace("(SELECT quantile_cont(score,1-c) FROM s)", "CASE c WHEN 0.01 THEN (SELECT quantile_cont(score,0.99) FROM s) WHEN 0.05 THEN (SELECT quantile_cont(score,0.95) FROM s) ELSE (SELECT quantile_cont(score,0.9) FROM s) END")))
def if_sensitivity(shop):
    s = det.scores(shop).groupBy("order_id").agg(F.max(F.when(F.col("score_column") == "mad_log1p", F.col("score"))).alias("score"),
                                                 F.max(F.when(F.col("score_column") == "iqr_raw", F.col("score"))).alias("base"))
    return rounded(evaluation.contamination_sensitivity(s, F.col("base") > 1.0, [0.01, 0.05, 0.1], width=0.01))


@query("e32_label_evaluation", sql("""WITH l AS (SELECT candidate, flag, CASE WHEN quantity>100 THEN y END AS y2 FROM flg JOIN meas USING (order_id)), c AS (SELECT candidate, count(*) FILTER (WHERE y2 AND flag) AS tp, count(*) FILTER (WHERE NOT y2 AND flag) AS fp, count(*) FILTER (WHERE y2 AND NOT flag) AS fn,
 count(*) FILTER (WHERE NOT y2 AND NOT flag) AS tn, count(*) FILTER (WHERE y2 IS NULL) AS unknown FROM l GROUP BY 1)
SELECT candidate, tp, fp, fn, tn, unknown, CASE WHEN tp+fp+fn+tn=0 THEN 'no_labels' WHEN tp+fn=0 OR fp+tn=0 THEN 'one_class_labels' WHEN unknown>0 THEN 'partially_labelled' ELSE 'fully_labelled' END AS label_status FROM c"""))
def label_evaluation(shop):
    labels = shop.measures.select("order_id", F.when(F.col("quantity") > 100, F.col("raw_status") == "F").alias("y"))
    return evaluation.label_evaluation(det.flags(shop).drop("y"), labels).select("candidate", "tp", "fp", "fn", "tn", "unknown", "label_status")


@query("a47_case_manual_label_stats", sql("""WITH r AS (SELECT order_id, count(*) AS n, count(DISTINCT score) AS d, max(score) AS s FROM rev GROUP BY 1) SELECT coalesce(fitness_band,'outside_scope') AS detector_group, count(*) AS cases, sum(n-1)::BIGINT AS duplicate_rows, count(*) FILTER (WHERE d>1) AS conflicting_cases, count(*) FILTER (WHERE d=1 AND s>=4) AS high_labels
FROM r LEFT JOIN ff ON case_id=order_id GROUP BY 1"""))
def manual_labels(shop):
    from ordertide.plans.cohort import funnel_flags
    r = shop.reviews.groupBy("order_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    g = r.join(funnel_flags(shop).select(F.col("case_id").alias("order_id"), "fitness_band"), "order_id", "left")
    n = lambda c: F.count(F.when(c, 1))
    return g.groupBy(F.coalesce("fitness_band", F.lit("outside_scope")).alias("detector_group")).agg(
        F.count(F.lit(1)).alias("cases"), F.sum(F.col("n") - 1).alias("duplicate_rows"), n(F.col("lo") < F.col("hi")).alias("conflicting_cases"),
        n((F.col("lo") == F.col("hi")) & (F.col("hi") >= 4)).alias("high_labels"))


@query("a51_source_rule_checks", sql("""SELECT order_id, 'timing' AS scope, CASE WHEN quality_conflict THEN 'conflict' WHEN promise_delta IS NULL THEN 'not_observed' WHEN promise_delta>0 THEN 'late' ELSE 'not_late' END AS outcome FROM perf
UNION ALL SELECT order_id, 'payment', CASE WHEN payment_sum_cents IS NULL OR items_plus_freight_cents IS NULL THEN 'no_child_records' WHEN payment_sum_cents=items_plus_freight_cents THEN 'matched' ELSE 'difference' END FROM perf LEFT JOIN ipay USING (order_id) LEFT JOIN (SELECT order_id, items_plus_freight_cents FROM iitem) USING (order_id)
UNION ALL SELECT order_id, 'contents', CASE WHEN item_count=0 THEN 'no_child_records' ELSE 'count_confirmed' END FROM perf"""))
def source_rules(shop):
    return evidence.source_rule_checks(shop.performance, shop.payments, shop.items)


@query("a52_finding_actions", sql("""WITH b AS (SELECT grp, list_sort(list(duration_s))[(19*count(*))//20+1]/86400.0 AS up FROM bank JOIN gstat USING (grp) GROUP BY 1)
SELECT order_id, stage, round(CASE WHEN assessment_status='assessable' THEN duration_s/86400.0-up END,6) AS margin_days, CASE WHEN assessment_status<>'assessable' THEN 'complete_missing_context' WHEN is_long THEN 'verify_long_stage_source' WHEN duration_s=0 THEN 'verify_tied_timestamps' ELSE 'no_action' END AS proposed_action
FROM sig s LEFT JOIN b USING (grp) WHERE assessment_status IN ('assessable','context_reference_unavailable')"""))
def findings(shop):
    return rounded(evidence.finding_actions(ranked(shop), peers.reference_groups(peer_plans.reference(shop))).select("order_id", "stage", "margin_days", "proposed_action"))
