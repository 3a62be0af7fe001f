"""Category comparison, partitions, labels, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordertide.functions import clock, tristate
from ordertide.operators import cohort, ordered, process, quality, relations, sampling
from ordertide.plans.cleaning import eligible_orders, scoped
from ordertide.plans.ctes import define, sql
from ordertide.plans.registry import query, rounded
from ordertide.session import materialize
from ordertide.sources.star_schema import FUNNEL

define("gq", "SELECT *, CAST(epoch(delivered_at)-epoch(purchased_at) AS BIGINT) AS total_s, date_trunc('month',purchased_at)::DATE AS m FROM grouped")
define("cm", """SELECT category, month_start, coalesce(n,0) AS orders, coalesce(n,0)>=1 AS supported_month FROM (SELECT DISTINCT single_category_name AS category FROM gq WHERE category_scope='single_category') c CROSS JOIN
 (SELECT unnest(generate_series((SELECT min(m) FROM gq WHERE category_scope='single_category')::TIMESTAMP, (SELECT max(m) FROM gq WHERE category_scope='single_category')::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month_start) s
 LEFT JOIN (SELECT single_category_name AS category, m AS month_start, count(*) AS n FROM gq WHERE category_scope='single_category' GROUP BY 1,2) x USING (category, month_start)""")
define("cg", "SELECT category, sum(orders)::BIGINT AS single_category_orders, count(*) FILTER (WHERE supported_month) AS supported_months, sum(orders)>=100 AND count(*) FILTER (WHERE supported_month)>=10 AS candidate FROM cm GROUP BY 1")
define("cw", """SELECT first_month, last_month, months, (last_month + INTERVAL 1 MONTH)::DATE AS end_exclusive FROM (SELECT min(month_start) AS first_month, max(month_start) AS last_month, count(*) AS months FROM
 (SELECT month_start, year(month_start)*12+month(month_start)-row_number() OVER (ORDER BY month_start) AS g FROM (SELECT month_start FROM cm WHERE category IN (SELECT category FROM cg WHERE candidate) GROUP BY 1 HAVING bool_and(supported_month))) GROUP BY g) ORDER BY months DESC, first_month LIMIT 1""")
define("led", """SELECT g.*, candidate, w.*, coalesce(purchased_at::DATE>=first_month AND purchased_at::DATE<end_exclusive,false) AS in_window, CASE WHEN category_scope<>'single_category' THEN 'category_scope:'||category_scope WHEN NOT coalesce(candidate,false) THEN 'below_category_coverage_gate'
  WHEN NOT coalesce(purchased_at::DATE>=first_month AND purchased_at::DATE<end_exclusive,false) THEN 'outside_common_period' WHEN NOT completed_timing_eligible THEN 'timing_ineligible:'||usage_group ELSE 'included' END AS disposition
 FROM gq g LEFT JOIN cg ON cg.category=g.single_category_name LEFT JOIN cw w ON true""")


def orders(shop):
    if "cohort_orders" not in shop.__dict__:
        shop.__dict__["cohort_orders"] = materialize(scoped(shop).withColumn(
            "total_s", clock.seconds_between(F.col("purchased_at"), F.col("delivered_at"))), "cohort-orders")
    return shop.__dict__["cohort_orders"]


def gated(shop):
    months = cohort.category_months(orders(shop), 1)
    return months, cohort.coverage_gate(months, 100, 10)


def ledger(shop):
    months, gate = gated(shop)
    return cohort.selection_ledger(orders(shop), gate, cohort.common_window(months, gate))


@query("a12_category_profile", sql("""SELECT * FROM (SELECT unnest(cats) AS category, count(*) AS orders_with_category FROM gq WHERE cats IS NOT NULL GROUP BY 1) LEFT JOIN
 (SELECT single_category_name AS category, count(*) AS single_category_orders, count(*) FILTER (WHERE order_status='delivered') AS delivered_orders, count(*) FILTER (WHERE completed_timing_eligible) AS complete_orders, count(*) FILTER (WHERE missing_milestone_count>0) AS missing_timeline_orders,
  count(*) FILTER (WHERE has_reversed_milestones) AS reversed_timeline_orders, count(*) FILTER (WHERE seller_count>1) AS multi_seller_orders, count(DISTINCT m) AS purchase_months, min(purchased_at) AS first_purchase, max(purchased_at) AS last_purchase,
  round(quantile_cont(total_s::DOUBLE,0.5) FILTER (WHERE completed_timing_eligible)/86400,6) AS median_days, round(quantile_cont(total_s::DOUBLE,0.95) FILTER (WHERE completed_timing_eligible)/86400,6) AS p95_days FROM gq WHERE category_scope='single_category' GROUP BY 1) USING (category)
 LEFT JOIN (SELECT single_category_name AS category, count(DISTINCT seller_id) AS distinct_sellers FROM gq JOIN item USING (order_id) WHERE category_scope='single_category' GROUP BY 1) USING (category)"""))
def category_profile(shop):
    return rounded(cohort.category_profile(orders(shop), shop.items))


@query("a13_coverage_gate", sql("SELECT * FROM cg"))
def coverage_gate(shop):
    return gated(shop)[1]


@query("a13_category_months", sql("SELECT category, strftime(month_start,'%Y-%m') AS month, orders, supported_month FROM cm"))
def category_months(shop):
    return gated(shop)[0].select("category", F.date_format("month_start", "yyyy-MM").alias("month"), "orders", "supported_month")


@query("a14_common_window", sql("SELECT strftime(first_month,'%Y-%m') AS first_month, strftime(last_month,'%Y-%m') AS last_month, months FROM cw"))
def common_window(shop):
    return cohort.common_window(*gated(shop)).select(F.date_format("first_month", "yyyy-MM").alias("first_month"), F.date_format("last_month", "yyyy-MM").alias("last_month"), "months")


@query("a15_selection_ledger", sql("SELECT order_id, disposition FROM led"))
def selection_ledger(shop):
    return ledger(shop).select("order_id", "disposition")


@query("a16_category_overview", sql("""SELECT single_category_name AS category, count(*) AS single_category_orders, count(*) FILTER (WHERE in_window) AS period_orders, count(*) FILTER (WHERE in_window AND completed_timing_eligible) AS period_eligible,
 count(*) FILTER (WHERE disposition='included') AS comparison_orders, round((count(*) FILTER (WHERE in_window)-count(*) FILTER (WHERE in_window AND completed_timing_eligible))/nullif(count(*) FILTER (WHERE in_window),0),6) AS period_excluded_fraction
FROM led WHERE category_scope='single_category' GROUP BY 1"""))
def overview(shop):
    return rounded(cohort.category_overview(ledger(shop)))


def timed(shop):
    return orders(shop).where("category_scope = 'single_category' AND completed_timing_eligible").withColumn("category", F.col("single_category_name"))


define("inc", "SELECT *, single_category_name AS category FROM gq WHERE category_scope='single_category' AND completed_timing_eligible")


@query("a17_seller_composition", sql("""WITH b AS (SELECT category, count(*) AS comparison_orders, count(*) FILTER (WHERE seller_count=1) AS single_seller_orders, count(*) FILTER (WHERE seller_count>1) AS multi_seller_orders FROM inc GROUP BY 1),
p AS (SELECT category, seller_id, count(*) FILTER (WHERE seller_count=1) AS n FROM (SELECT DISTINCT order_id, seller_id FROM item) JOIN inc USING (order_id) GROUP BY 1,2)
SELECT category, comparison_orders, single_seller_orders, multi_seller_orders, count(*) AS distinct_sellers, max(n) AS largest_single_seller_orders, round(max(n)/nullif(single_seller_orders,0),6) AS largest_share FROM b JOIN p USING (category) GROUP BY 1,2,3,4"""))
def seller_composition(shop):
    return rounded(cohort.seller_composition(timed(shop), shop.items))


@query("a16_usage_group_exclusions", sql("SELECT single_category_name AS category, usage_group, count(*) AS orders, bool_or(coalesce(candidate,false)) AS category_candidate FROM led WHERE category_scope='single_category' AND in_window GROUP BY 1,2"))
def usage_exclusions(shop):
    return cohort.usage_group_exclusions(ledger(shop))


@query("a17_single_seller_states", sql("""SELECT category, count(*) AS single_seller_orders, count(*) FILTER (WHERE seller_state=customer_state) AS same_state_orders, round(count(*) FILTER (WHERE seller_state=customer_state)/count(*),6) AS same_state_fraction, round(quantile_cont(total_s::DOUBLE,0.5)/86400,6) AS median_total_days
FROM (SELECT order_id, category, customer_id, total_s FROM inc WHERE seller_count=1) JOIN (SELECT DISTINCT order_id, seller_id FROM item) USING (order_id) LEFT JOIN (SELECT seller_id, seller_state FROM sell) USING (seller_id) LEFT JOIN (SELECT customer_id, customer_state FROM cust) USING (customer_id) GROUP BY 1"""))
def seller_states(shop):
    return rounded(cohort.single_seller_states(timed(shop), shop.items, shop.customers, shop.sellers))


@query("a18_direct_standardization", sql("""WITH c AS (SELECT category, year(purchased_at)::BIGINT AS y, count(*) AS n, sum(total_s)::BIGINT AS s FROM inc GROUP BY 1,2), k AS (SELECT y FROM c WHERE n>=3 GROUP BY 1 HAVING count(*)=(SELECT count(DISTINCT category) FROM c))
SELECT category, sum(n)::BIGINT AS orders, coalesce(sum(n) FILTER (WHERE y IN (SELECT y FROM k)),0)::BIGINT AS supported_orders, (SELECT count(*) FROM k) AS common_strata, round(sum(s)/sum(n)/86400,6) AS raw_mean_days,
 round(sum(s) FILTER (WHERE y IN (SELECT y FROM k))/sum(n) FILTER (WHERE y IN (SELECT y FROM k))/86400,6) AS supported_mean_days, round(sum(s/n) FILTER (WHERE y IN (SELECT y FROM k))/(SELECT count(*) FROM k)/86400,6) AS standardized_mean_days FROM c GROUP BY 1"""))
def standardization(shop):
    return rounded(cohort.direct_standardization(timed(shop).withColumn("y", F.year("purchased_at")), "y", "total_s", 3))


@query("a19_tail_sensitivity", sql("""SELECT single_category_name AS category, scenario, count(*) AS orders, count(*) FILTER (WHERE completed_timing_eligible) AS eligible_orders, round(avg(total_s) FILTER (WHERE completed_timing_eligible)/86400,6) AS mean_days
FROM (SELECT *, 'common_window' AS scenario, end_exclusive AS e FROM led UNION ALL SELECT *, 'omit_last_purchase_month', last_month FROM led) WHERE category_scope='single_category' AND candidate AND purchased_at::DATE>=first_month AND purchased_at::DATE<e GROUP BY 1,2"""))
def tail(shop):
    return rounded(cohort.tail_sensitivity(ledger(shop)))


@query("a20_experiment_split", sql("""SELECT split, count(*) AS cohort_orders, count(*) FILTER (WHERE completed_timing_eligible) AS completed_orders, count(*) FILTER (WHERE timing_input_reason='completion_not_before_partition_cutoff') AS crossing_orders,
 count(*) FILTER (WHERE timing_input_reason='eligible_completed_timing') AS timing_input_orders, count(*) FILTER (WHERE missing_milestone_count>0) AS missing_orders, count(*) FILTER (WHERE has_reversed_milestones) AS reversed_orders, min(purchased_at) AS first_purchase, max(purchased_at) AS last_purchase FROM elig GROUP BY 1"""))
def experiment_split(shop):
    return cohort.split_summary(eligible_orders(shop))


@query("a21_outer_split_80_20", """WITH o AS (SELECT o_orderkey, o_orderstatus, CAST(epoch(o_orderdate) AS BIGINT) AS t FROM orders), b AS (SELECT t AS boundary FROM o ORDER BY t DESC LIMIT 1 OFFSET (SELECT (count(*)+4)//5-1 FROM orders))
SELECT o_orderstatus, CASE WHEN t>=boundary THEN 'test' ELSE 'development' END AS proposed_role, count(*) AS orders, min(t) AS first_s, max(t) AS last_s FROM o, b GROUP BY 1,2""")
def outer_split(shop):
    o = shop.table("orders").select("o_orderkey", "o_orderstatus", clock.seconds(F.col("o_orderdate")).alias("t"))
    return cohort.outer_split(o, "t").groupBy("o_orderstatus", "proposed_role").agg(F.count(F.lit(1)).alias("orders"), F.min("t").alias("first_s"), F.max("t").alias("last_s"))


@query("a22_inner_roles", sql("""SELECT CASE WHEN split='validation' THEN 'validation' WHEN split='test' THEN 'reserved_test' WHEN purchased_at>=TIMESTAMP '1998-01-01' THEN 'calibration' WHEN coalesce(delivered_at<TIMESTAMP '1998-01-01',false) THEN 'fit' ELSE 'deferred_at_inner_cutoff' END AS inner_role, count(*) AS orders FROM elig GROUP BY 1"""))
def inner_roles(shop):
    return cohort.inner_roles(eligible_orders(shop), "1998-01-01", F.col("delivered_at")).groupBy("inner_role").agg(F.count(F.lit(1)).alias("orders"))


@query("a23_data_quality_audit", sql("""SELECT 'status' AS section, order_status AS metric, count(*) AS value FROM quality GROUP BY 1,2 UNION ALL SELECT 'orders','orders',count(*) FROM quality UNION ALL SELECT 'orders','missing_carrier_at',count(*) FILTER (WHERE carrier_at IS NULL) FROM quality
UNION ALL SELECT 'orders','missing_delivered_at',count(*) FILTER (WHERE delivered_at IS NULL) FROM quality UNION ALL SELECT 'orders','orders_with_negative_duration',count(*) FILTER (WHERE negative_transition_count>0) FROM quality UNION ALL SELECT 'orders','reversed_orders',count(*) FILTER (WHERE has_reversed_milestones) FROM quality
UNION ALL SELECT 'event_log','events_per_case_min',(SELECT min(n) FROM (SELECT count(*) AS n FROM log GROUP BY case_id)) UNION ALL SELECT 'event_log','events_per_case_max',(SELECT max(n) FROM (SELECT count(*) AS n FROM log GROUP BY case_id)) UNION ALL SELECT 'event_log','events',(SELECT count(*) FROM log)"""))
def quality_audit(shop):
    return cohort.quality_metrics(quality.timeline_flags(shop.orders), shop.activity_log)


def funnel_flags(shop):
    return process.conformance(shop.funnel_log, FUNNEL).select(
        "case_id", "variant", "fitness", "fitness_band", (F.col("fitness") < 0.75).alias("low_fit"), F.col("reversed_flag").alias("reversed"), (F.col("missing_event_count") > 0).alias("missing"))


define("ff", "SELECT case_id, variant, fitness, CASE WHEN fitness>=1.0 THEN '1.0' WHEN fitness>=0.8 THEN '0.8-<1.0' WHEN fitness>=0.5 THEN '0.5-<0.8' ELSE '<0.5' END AS fitness_band, fitness<0.75 AS low_fit, reversed_flag AS reversed, missing_event_count>0 AS missing FROM conf2")


@query("a28_detector_overlap", sql("SELECT low_fit, reversed, missing, count(*) AS cases, round(100.0*count(*)/(SELECT count(*) FROM ff),6) AS percent FROM ff GROUP BY 1,2,3"))
def detector_overlap(shop):
    return rounded(cohort.overlap_groups(funnel_flags(shop), ["low_fit", "reversed", "missing"]))


@query("a28_vote_levels", sql("""SELECT votes, CASE votes WHEN 0 THEN 'none' WHEN 1 THEN 'single' WHEN 2 THEN 'majority' ELSE 'all' END AS level, count(*) AS cases, round(100.0*count(*)/(SELECT count(*) FROM ff),6) AS percent
FROM (SELECT coalesce(low_fit,false)::INT+coalesce(reversed,false)::INT+coalesce(missing,false)::INT AS votes FROM ff) GROUP BY 1"""))
def vote_levels(shop):
    return rounded(cohort.vote_levels(funnel_flags(shop), ["low_fit", "reversed", "missing"]))


@query("a29_variant_profiles", sql("SELECT fitness_band, variant, count(*) AS cases, count(*) FILTER (WHERE reversed) AS anomalies, round(count(*) FILTER (WHERE reversed)/count(*),6) AS anomaly_rate FROM ff GROUP BY 1,2"))
def variant_profiles(shop):
    return rounded(funnel_flags(shop).groupBy("fitness_band", "variant").agg(F.count(F.lit(1)).alias("cases"), F.count(F.when(F.col("reversed"), 1)).alias("anomalies")).withColumn(
        "anomaly_rate", F.col("anomalies") / F.col("cases")))


@query("a30_status_profile", sql("""SELECT order_status, category_scope, count(*) AS orders, round(100.0*count(*) FILTER (WHERE missing_milestone_count>0)/count(*),6) AS missing_percent, count(*) FILTER (WHERE status_delivery_conflict) AS conflicts FROM grouped GROUP BY 1,2"""))
def status_profile(shop):
    return rounded(scoped(shop).groupBy("order_status", "category_scope").agg(
        F.count(F.lit(1)).alias("orders"), (100 * F.count(F.when(F.col("missing_milestone_count") > 0, 1)) / F.count(F.lit(1))).alias("missing_percent"),
        F.count(F.when(F.col("status_delivery_conflict"), 1)).alias("conflicts")))


@query("a31_label_crosstab", """WITH l AS (SELECT CASE WHEN quality=1 THEN 'good' ELSE 'poor' END AS a, CASE WHEN toxic=1 THEN 'toxic' ELSE 'clean' END AS b FROM labels), s AS (SELECT * FROM (VALUES ('good'),('poor'),('unrated')) x(a), (VALUES ('toxic'),('clean'),('unsure')) y(b)),
c AS (SELECT s.a, s.b, count(l.a) AS cases FROM s LEFT JOIN l ON l.a=s.a AND l.b=s.b GROUP BY 1,2) SELECT a, b, cases, round(100.0*cases/(SELECT count(*) FROM l),6) AS percent_population, round(100.0*cases/nullif(sum(cases) OVER (PARTITION BY a),0),6) AS percent_row FROM c""")
def crosstab(shop):
    l = shop.table("labels").select(F.when(F.col("quality") == 1, "good").otherwise("poor").alias("a"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("b"))
    return rounded(cohort.label_crosstab(l, "a", "b", ["good", "poor", "unrated"], ["toxic", "clean", "unsure"]))


@query("a32_group_label_summary", """SELECT lang, source, count(*) AS documents, count(quality) AS labelled, round(avg(quality),6) AS good_rate, count(*) FILTER (WHERE quality<>toxic) AS disagreements FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1,2""")
def label_summary(shop):
    d = shop.table("documents").select("doc_id", "lang", "source").join(shop.table("labels"), "doc_id", "left")
    return rounded(d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("documents"), F.count("quality").alias("labelled"), F.avg("quality").alias("good_rate"),
                                                   F.count(F.when(F.col("quality") != F.col("toxic"), 1)).alias("disagreements")))


@query("a50_reference_label_join", sql("""WITH r AS (SELECT order_id, count(*) AS reference_rows, count(DISTINCT score) AS labels, max(score) AS s FROM rev GROUP BY 1) SELECT r.order_id, reference_rows, labels>1 AS conflicting, CASE WHEN labels=1 THEN s END AS label, f.case_id IS NOT NULL AS in_scope, fitness_band FROM r LEFT JOIN ff f ON f.case_id=r.order_id"""))
def reference_labels(shop):
    r = shop.reviews.groupBy("order_id").agg(F.count(F.lit(1)).alias("reference_rows"), (F.min("score") != F.max("score")).alias("conflicting"), F.max("score").alias("_s"))
    f = funnel_flags(shop).select(F.col("case_id").alias("order_id"), "fitness_band", F.lit(True).alias("in_scope"))
    return r.join(f, "order_id", "left").select("order_id", "reference_rows", "conflicting", F.when(~F.col("conflicting"), F.col("_s")).alias("label"),
                                                F.coalesce("in_scope", F.lit(False)).alias("in_scope"), "fitness_band")


@query("k02_round_robin_by_group", sql("""WITH r AS (SELECT case_id, variant, round(fitness,6) AS fitness, row_number() OVER (PARTITION BY variant ORDER BY round(fitness,6), case_id) AS round FROM ff) SELECT case_id, variant, fitness, round FROM r ORDER BY round, fitness, case_id LIMIT 100"""))
def round_robin(shop):
    f = funnel_flags(shop).select("case_id", "variant", F.round("fitness", 6).alias("fitness"))
    return sampling.round_robin(f, "variant", [F.col("fitness"), F.col("case_id")], 100)


@query("k03_stratified_equal_allocation", """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('review|'||doc_id), doc_id) AS stratum_rank, count(*) OVER (PARTITION BY lang) AS stratum_size FROM documents), c AS (SELECT * FROM r ORDER BY stratum_rank, lang LIMIT 90)
SELECT doc_id, lang, stratum_rank, stratum_size, count(*) OVER (PARTITION BY lang) AS allocated, round(count(*) OVER (PARTITION BY lang)/stratum_size,6) AS inclusion_probability, round(stratum_size/count(*) OVER (PARTITION BY lang),6) AS weight FROM c""")
def stratified(shop):
    return rounded(sampling.stratified_equal_allocation(shop.table("documents"), "lang", "doc_id", 90, "review"))


@query("k04_hash_sample", """SELECT o_orderkey, o_orderpriority, rn AS sample_rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('seed7|'||o_orderpriority||'|'||o_orderkey), o_orderkey) AS rn FROM orders) WHERE rn<=20""")
def hash_sample(shop):
    return sampling.hash_sample(shop.table("orders").select("o_orderkey", "o_orderpriority"), "seed7", "o_orderpriority", "o_orderkey", 20)


@query("k04_shortfall", "SELECT source, count(*) AS available, least(count(*),40) AS sampled, greatest(40-count(*),0) AS shortfall FROM documents GROUP BY 1")
def shortfall(shop):
    return sampling.shortfall(shop.table("documents"), "source", 40)


@query("k05_pilot_strata", sql("""WITH s AS (SELECT case_id, CASE WHEN reversed THEN 'warning' WHEN NOT missing THEN 'complete_below' ELSE 'partial' END AS sample_group FROM ff) SELECT case_id, sample_group, rn AS sample_rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_group ORDER BY sha256('pilot|'||sample_group||'|'||case_id), case_id) AS rn FROM s) WHERE rn<=10"""))
def pilot_strata(shop):
    g = sampling.disjoint_groups(funnel_flags(shop), [("warning", F.col("reversed")), ("complete_below", ~F.col("missing")), ("partial", F.lit(True))])
    return sampling.hash_sample(g.select("case_id", "sample_group"), "pilot", "sample_group", "case_id", 10)


@query("k06_nearest_boundary", """WITH m AS (SELECT o_orderkey, CAST(round(o_totalprice*100) AS BIGINT)-25000000 AS margin FROM orders), s AS (SELECT *, CASE WHEN margin>0 THEN 'above' ELSE 'at_or_below' END AS side FROM m)
SELECT o_orderkey, margin, side, rn AS margin_rank FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY abs(margin), o_orderkey) AS rn FROM s) WHERE rn<=15""")
def nearest(shop):
    m = shop.table("orders").select("o_orderkey", (F.round(F.col("o_totalprice") * 100).cast("long") - 25000000).alias("margin"))
    return sampling.nearest_boundary(m, "margin", "o_orderkey", 15)
