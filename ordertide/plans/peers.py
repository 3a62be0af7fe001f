"""Peer references and delivery performance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordertide.operators import peers, performance
from ordertide.plans.ctes import define, sql
from ordertide.plans.registry import query, rounded
from ordertide.session import materialize

define("srow", """SELECT *, product_count=1 AND seller_count=1 AS product_attributable, CASE WHEN product_count=1 THEN first_product END AS product_id, CASE WHEN seller_count=1 THEN first_seller END AS single_seller_id FROM stage""")
define("bank", """SELECT order_id, duration_s, ended_at, k.lvl, k.grp FROM srow, LATERAL (VALUES (4,'category0|'||stage||'|'||customer_state||'|'||distance_band||'|'||seller_attribution_scope),
  (5,'category1|'||stage||'|'||distance_band||'|'||seller_attribution_scope)) k(lvl,grp) WHERE split='train' AND duration_eligible""")
define("gstat", "SELECT grp, count(*) AS ref_n, sum(duration_s)::BIGINT AS ref_sum_s, max(ended_at) AS latest_end FROM bank GROUP BY 1 HAVING count(*)>=30")
define("pick", """SELECT r.order_id, r.stage, r.duration_s, min(k.lvl) AS lvl, arg_min(k.grp, k.lvl) AS grp FROM srow r, LATERAL (VALUES (4,'category0|'||stage||'|'||customer_state||'|'||distance_band||'|'||seller_attribution_scope),
  (5,'category1|'||stage||'|'||distance_band||'|'||seller_attribution_scope)) k(lvl,grp) JOIN gstat USING (grp) WHERE r.duration_eligible AND r.split='validation' GROUP BY 1,2,3""")
define("peer", """SELECT p.*, g.ref_n, g.ref_sum_s, (SELECT count(*) FROM bank b WHERE b.grp=p.grp AND b.duration_s<=p.duration_s) AS ref_upto FROM pick p JOIN gstat g USING (grp)""")
define("sig", """SELECT s.order_id, s.split, s.stage, s.duration_s, s.customer_state, s.distance_band, s.purchase_month, s.seller_attribution_scope, s.performance_state, s.performance_eligible, p.lvl, p.grp, p.ref_n, p.ref_sum_s, p.ref_upto,
  CASE WHEN s.quality_conflict THEN 'source_conflict' WHEN s.duration_s IS NULL THEN 'endpoint_not_visible' WHEN NOT s.duration_eligible THEN 'parent_complete_case_policy' WHEN p.ref_n IS NULL THEN 'context_reference_unavailable' ELSE 'assessable' END AS assessment_status,
  p.ref_n IS NOT NULL AND s.duration_s>0 AND 20*p.ref_upto>19*p.ref_n AS is_long, p.ref_n IS NOT NULL AND s.duration_s>0 AND 20*p.ref_upto<p.ref_n AS is_short
 FROM srow s LEFT JOIN peer p USING (order_id, stage) WHERE s.split='validation'""")
define("score", """SELECT *, CASE WHEN ref_n IS NULL THEN NULL WHEN duration_s*ref_n<=ref_sum_s OR duration_s<=0 OR 20*ref_upto<=19*ref_n THEN 0.0 ELSE least(100.0, 100.0*(20*ref_upto-19*ref_n)/ref_n) END::DOUBLE AS delay_score,
  CASE WHEN ref_n IS NULL THEN 'unassessed' WHEN duration_s*ref_n<=ref_sum_s OR duration_s<=0 OR 20*ref_upto<=19*ref_n THEN 'none' WHEN 40*ref_upto<=39*ref_n THEN 'low' WHEN 100*ref_upto<=99*ref_n THEN 'medium' ELSE 'high' END AS severity FROM sig""")


def stage_rows(shop):
    """Stage rows with product context."""
    return performance.stage_rows(shop.performance).withColumns({
        "product_attributable": (F.col("product_count") == 1) & (F.col("seller_count") == 1),
        "product_id": F.when(F.col("product_count") == 1, F.col("first_product")),
        "single_seller_id": F.when(F.col("seller_count") == 1, F.col("first_seller"))})


def stage_table(shop):
    """``stage_rows`` used as reference and as candidates, so written once."""
    if "stage_table" not in shop.__dict__:
        shop.__dict__["stage_table"] = materialize(stage_rows(shop), "stage-rows")
    return shop.__dict__["stage_table"]


def reference(shop, rows=None):
    return (stage_table(shop) if rows is None else rows).where("split = 'train' AND duration_eligible")


def candidates(shop):
    return stage_table(shop).where("split = 'validation'")


def eligible_candidates(shop):
    return candidates(shop).where("duration_eligible")


def scored(shop):
    return peers.stage_delay_score(eligible_candidates(shop), reference(shop))


@query("j11_peer_reference_join", sql("SELECT order_id, stage, lvl::INTEGER AS level, grp AS \"group\", ref_n, ref_upto FROM peer"))
def peer_join(shop):
    return peers.select_peers(eligible_candidates(shop), reference(shop), product_levels=peers.PRODUCT_LEVELS).where("ref_n IS NOT NULL").select(
        "order_id", "stage", "level", "group", "ref_n", "ref_upto")


@query("w05_ecdf_rank", """WITH r AS (SELECT CAST(l_quantity AS BIGINT) AS q FROM lineitem WHERE l_shipdate<TIMESTAMP '1998-01-01'),
c AS (SELECT q, count(*) AS n FROM r GROUP BY 1),
g AS (SELECT l_returnflag, CAST(l_quantity AS BIGINT) AS q, count(*) AS lines FROM lineitem GROUP BY 1,2)
SELECT l_returnflag, q, lines, round((SELECT sum(n) FROM c WHERE c.q<=g.q)::DOUBLE/(SELECT count(*) FROM r),6) AS percentile FROM g""")
def ecdf_rank(shop):
    from ordertide.operators import ordered
    lines = shop.table("lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("q"), "l_shipdate")
    groups = lines.groupBy("l_returnflag", "q").agg(F.count(F.lit(1)).alias("lines"))
    ref = lines.where(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return rounded(ordered.ecdf(groups, ref, [], "q", width=ordered.UNITS).select(
        "l_returnflag", "q", "lines", (F.col("ref_upto") / F.col("ref_n")).alias("percentile")))


@query("w06_order_statistic", """SELECT l_suppkey, list_sort(list(c))[(19*count(*))//20+1] AS upper_cents, list_sort(list(c))[CAST(ceil(count(*)/20.0) AS BIGINT)] AS lower_cents
FROM (SELECT l_suppkey, CAST(round(l_extendedprice*100) AS BIGINT) AS c FROM lineitem) GROUP BY 1""")
def order_statistic(shop):
    from ordertide.operators import ordered
    d = ordered.ranks(shop.items.select(F.col("seller_id").alias("l_suppkey"), "price_cents"), ["l_suppkey"], "price_cents", width=ordered.UNITS)
    n = F.col("n_total")
    return ordered.pick_positions(d, ["l_suppkey"], "price_cents", {
        "upper_cents": F.floor(19 * n / 20), "lower_cents": F.ceil(n / 20) - 1}).drop("n_total")


@query("d14_peer_percentile_signal", sql("""SELECT order_id, stage, assessment_status, round(CASE WHEN assessment_status='assessable' THEN ref_upto/ref_n END,6) AS empirical_percentile,
 CASE WHEN assessment_status='assessable' THEN is_long END AS long_stage_warning, CASE WHEN assessment_status='assessable' THEN is_short END AS short_stage_note,
 CASE WHEN is_long THEN 'long_duration_warning' WHEN is_short THEN 'short_duration_note' WHEN assessment_status='assessable' AND duration_s=0 THEN 'zero_duration_note' WHEN assessment_status='assessable' THEN 'no_tail_signal_under_reference' ELSE 'not_assessable' END AS stage_signal FROM sig"""))
def peer_signal(shop):
    rows = candidates(shop)
    usable = rows.where("duration_eligible")
    rest = rows.where("NOT duration_eligible")
    out = peers.stage_signals(usable, reference(shop))
    blank = rest.select("order_id", "stage", F.when(F.col("quality_conflict"), "source_conflict").when(
        F.col("duration_s").isNull(), "endpoint_not_visible").otherwise("parent_complete_case_policy").alias("assessment_status"),
        F.lit("not_assessable").alias("stage_signal"))
    cols = ["order_id", "stage", "assessment_status", "empirical_percentile", "long_stage_warning", "short_stage_note", "stage_signal"]
    return rounded(out.select(*cols).unionByName(blank, allowMissingColumns=True))


@query("d15_reference_groups", sql("""SELECT g.grp AS "group", ref_n, latest_end, round(quantile_cont(duration_s::DOUBLE,0.5)/86400,6) AS median_days, round(quantile_cont(duration_s::DOUBLE,0.95)/86400,6) AS p95_days,
 round(list_sort(list(duration_s))[CAST(ceil(count(*)/20.0) AS BIGINT)]/86400.0,6) AS lower_boundary_days, round(list_sort(list(duration_s))[(19*count(*))//20+1]/86400.0,6) AS upper_boundary_days
 FROM gstat g JOIN bank USING (grp) GROUP BY 1,2,3"""))
def reference_groups(shop):
    return rounded(peers.reference_groups(reference(shop)).drop("member_fingerprint"))


@query("d16_product_stage_profile", sql("""SELECT product_id, stage, count(*) AS reference_n, round(avg(duration_s)/86400,6) AS mean_days, round(stddev_samp(duration_s)/86400,6) AS sd_days,
 round(quantile_cont(duration_s::DOUBLE,0.5)/86400,6) AS median_days, CASE WHEN count(*)<30 THEN 'sparse_descriptive_only' ELSE 'descriptive_product_history' END AS mean_support
 FROM srow WHERE split='train' AND duration_eligible AND product_attributable GROUP BY 1,2"""))
def product_profile(shop):
    return rounded(peers.product_stage_profile(reference(shop)))


@query("d17_stage_delay_score", sql("""SELECT order_id, stage, CASE WHEN ref_n IS NULL THEN 'unavailable' ELSE 'category_context_fallback' END AS reference_scope, ref_n, round(delay_score,6) AS delay_score, severity,
 round(ref_sum_s/ref_n/86400,6) AS reference_mean_days, delay_score>0 AS delay_warning FROM score WHERE assessment_status IN ('assessable','context_reference_unavailable')"""))
def stage_delay(shop):
    return rounded(scored(shop).select("order_id", "stage", "reference_scope", "ref_n", "delay_score", "severity", "reference_mean_days", "delay_warning"))


@query("f09_tail_score", sql("""SELECT severity, count(*) AS stages, round(sum(delay_score),4) AS score_sum, round(max(delay_score),6) AS score_max FROM score WHERE assessment_status IN ('assessable','context_reference_unavailable') GROUP BY 1"""))
def tail_score(shop):
    return scored(shop).groupBy("severity").agg(F.count(F.lit(1)).alias("stages"), F.round(F.sum("delay_score"), 4).alias("score_sum"),
                                                F.round(F.max("delay_score"), 6).alias("score_max"))


@query("a26_any_known_rollup", sql("""SELECT order_id, split, count(*) FILTER (WHERE a) AS assessed_stage_count, CASE WHEN count(*) FILTER (WHERE a)=3 THEN 'complete' WHEN count(*) FILTER (WHERE a)>0 THEN 'partial' ELSE 'unavailable' END AS assessment_coverage,
 count(*) FILTER (WHERE is_long) AS long_stage_warning_count, CASE WHEN bool_or(is_long) THEN true WHEN count(*) FILTER (WHERE a)=3 THEN false END AS long_stage_warning,
 coalesce(string_agg(stage,',' ORDER BY stage) FILTER (WHERE is_long),'') AS long_stages, max(CASE WHEN performance_eligible THEN CAST(performance_state='late' AS INT) END)=1 AS calendar_late_signal
 FROM (SELECT *, assessment_status='assessable' AS a FROM sig WHERE assessment_status IN ('assessable','context_reference_unavailable')) GROUP BY 1,2"""))
def any_known(shop):
    out = peers.order_signals(peers.stage_signals(eligible_candidates(shop), reference(shop)))
    return out.select("order_id", "split", "assessed_stage_count", "assessment_coverage", "long_stage_warning_count", "long_stage_warning",
                      F.array_join("long_stage_warning_stages", ",").alias("long_stages"), "calendar_late_signal")


@query("a27_max_stage_score", sql("""SELECT order_id, count(delay_score) AS scored_stages, CASE WHEN count(delay_score)=3 THEN 'complete' WHEN count(delay_score)>0 THEN 'partial' ELSE 'none' END AS score_coverage,
 round(max(delay_score),6) AS max_stage_delay_score, CASE WHEN bool_or(delay_score>0) THEN true WHEN count(delay_score)=3 THEN false END AS delay_warning,
 coalesce(string_agg(stage,',' ORDER BY stage) FILTER (WHERE delay_score>0),'') AS attention_stages FROM score WHERE assessment_status IN ('assessable','context_reference_unavailable') GROUP BY 1"""))
def max_score(shop):
    return rounded(peers.max_stage_score(scored(shop)).select("order_id", "scored_stages", "score_coverage", "max_stage_delay_score", "delay_warning",
                                                             F.array_join("attention_stages", ",").alias("attention_stages")))


RATE_SQL = """count(*) AS orders, count(*) FILTER (WHERE performance_eligible) AS comparable_orders, count(*) FILTER (WHERE seller_count=1) AS single_seller_orders, count(*) FILTER (WHERE seller_count>1) AS multi_seller_orders,
 count(*) FILTER (WHERE performance_state='early') AS early_orders, count(*) FILTER (WHERE performance_state='on_date') AS on_date_orders, count(*) FILTER (WHERE performance_state='late') AS late_orders,
 count(*) FILTER (WHERE performance_state='unknown') AS unknown_orders, count(*) FILTER (WHERE performance_state='excluded_source_conflict') AS excluded_source_conflict_orders,
 round(count(*) FILTER (WHERE performance_state='early')/nullif(count(*) FILTER (WHERE performance_eligible),0),6) AS early_rate, round(count(*) FILTER (WHERE performance_state='on_date')/nullif(count(*) FILTER (WHERE performance_eligible),0),6) AS on_date_rate,
 round(count(*) FILTER (WHERE performance_state='late')/nullif(count(*) FILTER (WHERE performance_eligible),0),6) AS late_rate,
 quantile_cont(days_early::DOUBLE,0.5) FILTER (WHERE performance_state='early') AS median_days_early, quantile_cont(days_late::DOUBLE,0.5) FILTER (WHERE performance_state='late') AS median_days_late,
 quantile_cont(promise_delta::DOUBLE,0.5) FILTER (WHERE performance_eligible) AS median_promise_delta"""


@query("a24_delivery_rates", sql(f"SELECT split, customer_state, {RATE_SQL} FROM perf GROUP BY 1,2"))
def delivery_rates(shop):
    return rounded(performance.delivery_rates(shop.performance, ["split", "customer_state"]))


@query("a24_grouped_rates", sql("""SELECT split, purchase_month, distance_band, grouping_id(distance_band, purchase_month, split) AS grouping, count(*) AS orders, count(*) FILTER (WHERE performance_eligible) AS comparable_orders,
 count(*) FILTER (WHERE performance_state='late') AS late_orders, round(count(*) FILTER (WHERE performance_state='late')/nullif(count(*) FILTER (WHERE performance_eligible),0),6) AS late_rate
 FROM perf GROUP BY GROUPING SETS ((split),(split,purchase_month),(split,distance_band))"""))
def grouped_rates(shop):
    return rounded(performance.grouped_rates(shop.performance, [["split"], ["split", "purchase_month"], ["split", "distance_band"]]))


@query("a25_entity_performance", sql(f"SELECT seller_id, seller_attribution_scope, {RATE_SQL} FROM (SELECT DISTINCT order_id, seller_id FROM item) JOIN perf USING (order_id) GROUP BY 1,2"))
def entity_performance(shop):
    from ordertide.operators import relations
    links = relations.entity_links(shop.items, "seller_id").select("order_id", "seller_id")
    return rounded(performance.delivery_rates(links.join(shop.performance, "order_id"), ["seller_id", "seller_attribution_scope"]))


@query("f03_promise_delta_days", sql("""SELECT order_id, promise_delta, days_early, days_late, performance_state, performance_eligible, delivery_visibility, post_cutoff_milestones, visible_inversions FROM perf"""))
def promise_delta(shop):
    return shop.performance.select("order_id", "promise_delta", "days_early", "days_late", "performance_state", "performance_eligible",
                                   "delivery_visibility", "post_cutoff_milestones", "visible_inversions")


MATCH_SQL = """WITH r AS (SELECT *, duration_s>86400*30 AS f FROM stage WHERE duration_eligible), own AS (SELECT stage, distance_band, customer_state AS group_value, count(*) AS t_n, count(*) FILTER (WHERE f) AS t_s FROM r GROUP BY 1,2,3),
cell AS (SELECT stage, distance_band, count(*) AS n, count(*) FILTER (WHERE f) AS s FROM r GROUP BY 1,2), b AS (SELECT o.*, n-t_n AS c_n, s-t_s AS c_s, t_n>=5 AND n-t_n>=5 AS used FROM own o JOIN cell USING (stage, distance_band)),
g AS (SELECT stage, group_value, sum(t_n)::BIGINT AS target_orders, coalesce(sum(t_n) FILTER (WHERE used),0)::BIGINT AS matched_target_orders, coalesce(sum(t_s) FILTER (WHERE used),0)::BIGINT AS matched_target_signals,
 coalesce(sum(c_n) FILTER (WHERE used),0)::BIGINT AS matched_comparator_orders, sum(t_s) FILTER (WHERE used)/sum(t_n) FILTER (WHERE used) AS tr, sum(t_n*c_s/c_n) FILTER (WHERE used)/sum(t_n) FILTER (WHERE used) AS cr FROM b GROUP BY 1,2)"""


def _matched(shop):
    rows = stage_table(shop).where("duration_eligible").withColumn("f", F.col("duration_s") > 86400 * 30)
    return peers.matched_comparison(rows, "customer_state", ["distance_band"], "f")


@query("j12_matched_comparison", sql(MATCH_SQL + """ SELECT stage, group_value, target_orders, matched_target_orders, matched_target_signals, matched_comparator_orders, round(tr,6) AS matched_target_rate, round(cr,6) AS matched_comparator_rate,
 round(matched_target_orders/target_orders,6) AS target_match_coverage, round(tr-cr,6) AS matched_rate_difference FROM g"""))
def matched(shop):
    return rounded(_matched(shop))


@query("a34_investigation_gate", sql(MATCH_SQL + """, s AS (SELECT *, CASE WHEN matched_target_orders=0 THEN 'no_supported_comparison_cells' WHEN matched_target_orders<40 OR matched_comparator_orders<100 THEN 'insufficient_matched_orders'
 WHEN matched_target_orders/target_orders<0.5 THEN 'insufficient_match_coverage' ELSE 'supported_descriptive_comparison' END AS comparison_status FROM g)
SELECT stage, group_value, comparison_status, coalesce(comparison_status='supported_descriptive_comparison' AND matched_target_signals>=5 AND tr-cr>0,false) AS investigation_candidate FROM s"""))
def gate(shop):
    return peers.investigation_gate(_matched(shop), 40, 100, 0.5, 5).select("stage", "group_value", "comparison_status", "investigation_candidate")


@query("j13_region_peer_comparison", sql("""WITH r AS (SELECT * FROM srow WHERE stage='transport' AND duration_eligible AND ended_at<TIMESTAMP '2000-01-01'), own AS (SELECT seller_attribution_scope, distance_band, customer_state, count(*) AS t_n, sum(duration_s)::BIGINT AS t_sum FROM r GROUP BY 1,2,3),
cell AS (SELECT seller_attribution_scope, distance_band, count(*) AS n, sum(duration_s)::BIGINT AS s FROM r GROUP BY 1,2), b AS (SELECT o.*, n-t_n AS c_n, s-t_sum AS c_sum, t_n>=5 AND n-t_n>=5 AS used FROM own o JOIN cell USING (seller_attribution_scope, distance_band))
SELECT customer_state, sum(t_n)::BIGINT AS target_total, coalesce(sum(t_n) FILTER (WHERE used),0)::BIGINT AS target_n, coalesce(sum(c_n) FILTER (WHERE used),0)::BIGINT AS control_n, count(*) FILTER (WHERE used) AS matched_cells,
 round(sum(t_sum) FILTER (WHERE used)/sum(t_n) FILTER (WHERE used)/86400,6) AS target_mean_days, round(sum(t_n*c_sum/c_n) FILTER (WHERE used)/sum(t_n) FILTER (WHERE used)/86400,6) AS control_mean_days,
 round(sum(t_sum) FILTER (WHERE used)/sum(t_n) FILTER (WHERE used)/86400-sum(t_n*c_sum/c_n) FILTER (WHERE used)/sum(t_n) FILTER (WHERE used)/86400,6) AS difference_days FROM b GROUP BY 1"""))
def region(shop):
    rows = stage_table(shop).where("stage = 'transport' AND duration_eligible").where(F.col("ended_at") < F.lit("2000-01-01").cast("timestamp_ntz"))
    return rounded(peers.region_peer_comparison(rows, ["seller_attribution_scope", "distance_band"], "customer_state", 5))


CG = """count(*) AS total_orders, count(*) FILTER (WHERE a) AS assessed_orders, count(*) FILTER (WHERE is_long) AS long_stage_orders, round(count(*) FILTER (WHERE is_long)/nullif(count(*) FILTER (WHERE a),0),6) AS long_stage_rate,
 count(*) FILTER (WHERE performance_eligible) AS comparable_orders, count(*) FILTER (WHERE performance_eligible AND performance_state='late') AS late_orders,
 round(count(*) FILTER (WHERE performance_eligible AND performance_state='late')/nullif(count(*) FILTER (WHERE performance_eligible),0),6) AS late_rate,
 count(*) FILTER (WHERE assessment_status='source_conflict') AS source_conflict_orders, count(*) FILTER (WHERE assessment_status='endpoint_not_visible') AS endpoint_not_visible_orders, count(*) FILTER (WHERE assessment_status='context_reference_unavailable') AS context_reference_unavailable_orders"""


@query("a33_context_group_stats", sql(" UNION ALL ".join(f"SELECT stage, '{d}' AS dimension, {v} AS group_value, {CG} FROM (SELECT *, assessment_status='assessable' AS a FROM sig WHERE assessment_status IN ('assessable','context_reference_unavailable')) GROUP BY 1,3"
                                                 for d, v in [("overall", "'all'"), ("customer_state", "customer_state"), ("purchase_month", "purchase_month"), ("distance_band", "distance_band")])))
def context_groups(shop):
    return rounded(peers.context_group_stats(peers.stage_signals(eligible_candidates(shop), reference(shop)),
                                             ["customer_state", "purchase_month", "distance_band"]))
