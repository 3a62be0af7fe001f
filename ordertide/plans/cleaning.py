"""P: cleaning, quality, eligibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordertide.functions import clock
from ordertide.operators import cleaning, process, quality
from ordertide.plans.ctes import define, sql
from ordertide.plans.registry import query
from ordertide.sources.star_schema import SPLIT_BOUNDS, STAGES, TIMES


@query("p01_normalize_text", """
WITH t AS (SELECT CASE WHEN p_size>25 THEN '  '||upper(p_name)||' ' ELSE p_name END AS p_name,
  CASE WHEN p_size>48 THEN '   ' ELSE p_brand END AS p_brand, CASE WHEN p_size<3 THEN '' ELSE p_type END AS p_type FROM part),
c AS (SELECT *, trim(p_name) AS n1, trim(p_brand) AS b1, p_type AS t1 FROM t)
SELECT 'p_name' AS column_name, 'trim_surrounding_whitespace' AS operation, count(*) FILTER (WHERE p_name<>n1) AS affected_cells FROM c
UNION ALL SELECT 'p_name','empty_string_to_missing', count(*) FILTER (WHERE n1='') FROM c
UNION ALL SELECT 'p_name','canonical_case', count(*) FILTER (WHERE n1<>lower(n1)) FROM c
UNION ALL SELECT 'p_brand','trim_surrounding_whitespace', count(*) FILTER (WHERE p_brand<>b1) FROM c
UNION ALL SELECT 'p_brand','empty_string_to_missing', count(*) FILTER (WHERE b1='') FROM c
UNION ALL SELECT 'p_brand','canonical_case', count(*) FILTER (WHERE b1<>upper(b1)) FROM c
UNION ALL SELECT 'p_type','trim_surrounding_whitespace', 0 FROM (SELECT 1)
UNION ALL SELECT 'p_type','empty_string_to_missing', count(*) FILTER (WHERE t1='') FROM c
UNION ALL SELECT 'p_type','canonical_case', 0 FROM (SELECT 1)""".replace(" 0 FROM (SELECT 1)", " CAST(0 AS BIGINT) FROM (SELECT 1)"))
def normalize_text(shop):
    size = F.col("p_size")
    messy = shop.table("part").select(
        F.when(size > 25, F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "))).otherwise(F.col("p_name")).alias("p_name"),
        F.when(size > 48, "   ").otherwise(F.col("p_brand")).alias("p_brand"),
        F.when(size < 3, "").otherwise(F.col("p_type")).alias("p_type"))
    return cleaning.normalize_text(messy, {"p_name": "text", "p_brand": "state", "p_type": "free"})[1]


@query("p02_nfc", """
SELECT doc_id, md5(nfc_normalize(replace(text,'é','e'||chr(769)))) AS text_md5, length(nfc_normalize(replace(text,'é','e'||chr(769)))) AS n FROM documents""")
def nfc(shop):
    split = shop.table("documents").select("doc_id", F.replace("text", F.lit("é"), F.lit("é")).alias("text"))
    return cleaning.nfc(split, "text").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"),
                                              F.length("text").cast("long").alias("n"))


@query("p03_pad_zip_validate_pattern", """
SELECT 'c_name' AS column_name, count(*) FILTER (WHERE NOT regexp_full_match(c_name,'Customer#[0-9]{9}')) AS violations FROM customer
UNION ALL SELECT 'zip', count(*) FILTER (WHERE NOT regexp_full_match(lpad(c_nationkey::VARCHAR,5,'0'),'0000[0-9]')) FROM customer
UNION ALL SELECT 'c_mktsegment', count(*) FILTER (WHERE NOT regexp_full_match(c_mktsegment,'[A-Z]{8,9}')) FROM customer""")
def pad_zip(shop):
    df = shop.table("customer").withColumn("zip", cleaning.pad_zip(F.col("c_nationkey").cast("string")))
    return cleaning.validate_pattern(df, {"c_name": "Customer#[0-9]{9}", "zip": "0000[0-9]", "c_mktsegment": "[A-Z]{8,9}"})


@query("p04_parse_exact", """
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN strftime(o_orderdate,'%Y-%m-%d') WHEN o_orderpriority LIKE '2%' THEN strftime(o_orderdate,'%Y-%-m-%d %H:%M:%S')
  ELSE strftime(o_orderdate,'%Y-%m-%d %H:%M:%S') END AS s FROM orders)
SELECT o_orderkey, CASE WHEN strftime(try_strptime(s,'%Y-%m-%d %H:%M:%S'),'%Y-%m-%d %H:%M:%S')=s THEN try_strptime(s,'%Y-%m-%d %H:%M:%S') END AS parsed FROM t""")
def parse_exact(shop):
    p = F.substring("o_orderpriority", 1, 1)
    text = (F.when(p == "1", F.date_format("o_orderdate", "yyyy-MM-dd"))
            .when(p == "2", F.date_format("o_orderdate", "yyyy-M-dd HH:mm:ss"))
            .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")))
    return shop.table("orders").select("o_orderkey", cleaning.parse_exact(text, "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("p05_to_numeric_finite", """
SELECT event_type, count(*) AS rows, count(CASE WHEN event_type NOT IN ('error','view','click') THEN 1 END) AS finite_rows,
 sum(CASE WHEN event_type NOT IN ('error','view','click') THEN CAST(regexp_extract(props,'([0-9]+)',1) AS DOUBLE) END) AS total FROM events GROUP BY 1""")
def numeric(shop):
    t = F.col("event_type")
    text = (F.when(t == "error", "NaN").when(t == "view", "Infinity").when(t == "click", "12x")
            .otherwise(F.regexp_extract("props", "([0-9]+)", 1)))
    value = cleaning.finite_number(text)
    return shop.table("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.count(value).alias("finite_rows"),
                                                          F.sum(value).alias("total"))


@query("p06_minor_units", """
WITH t AS (SELECT l_returnflag, CAST(CAST(l_extendedprice AS VARCHAR) AS DECIMAL(38,10)) AS a, CAST(CAST(l_extendedprice*1.5 AS VARCHAR) AS DECIMAL(38,10)) AS b FROM lineitem)
SELECT l_returnflag, sum(CAST(a*100 AS BIGINT))::BIGINT AS exact_cents, count(*) FILTER (WHERE a*100<>floor(a*100)) AS inexact_price,
 count(*) FILTER (WHERE b*100<>floor(b*100)) AS inexact_marked_up FROM t GROUP BY 1""")
def minor_units(shop):
    marked = F.col("l_extendedprice") * 1.5
    return shop.table("lineitem").groupBy("l_returnflag").agg(
        F.sum(cleaning.minor_units(F.col("l_extendedprice"))).alias("exact_cents"),
        F.count(F.when(cleaning.inexact_money(F.col("l_extendedprice")), 1)).alias("inexact_price"),
        F.count(F.when(cleaning.inexact_money(marked), 1)).alias("inexact_marked_up"))


@query("p07_drop_exact_duplicates", """
WITH k AS (SELECT user_id, event_type, min(event_id) AS kept_record FROM events GROUP BY 1,2)
SELECT event_id, kept_record FROM events JOIN k USING (user_id, event_type) WHERE event_id<>kept_record""")
def duplicates(shop):
    return cleaning.drop_exact_duplicates(shop.table("events").select("event_id", "user_id", "event_type"), "event_id")[1]


def _issue_tables(shop):
    counts = shop.items.groupBy("order_id").agg(F.count(F.lit(1)).alias("item_count"))
    paid = shop.payments.groupBy("order_id").agg(F.count(F.lit(1)).alias("payment_count"))
    orders = shop.orders.join(counts, "order_id", "left").join(paid, "order_id", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in ["item_count", "payment_count"]})
    reviews = shop.table("documents").select(
        F.col("doc_id").alias("review_id"), (F.col("n_chars") % 7).alias("score"), F.col("n_chars").alias("answered_s"),
        F.lit(200).alias("created_s"))
    return {"orders": orders, "items": shop.items, "payments": shop.payments, "products": shop.products, "reviews": reviews,
            "coordinates": shop.coordinates.withColumn("lng", F.col("lng") * 3), "customers": shop.customers,
            "zips": shop.coordinates.select("zip")}


def _sql_issue(table, key, field, code, condition, value, action, source):
    return (f"SELECT '{table}' AS table_name, ({key})::VARCHAR AS record_key, '{field}' AS field, '{code}' AS issue_code, "
            f"({value})::VARCHAR AS observed_value, '{action}' AS action FROM {source} WHERE {condition}")


_KM, _TE, _RV = "retain_missing_no_imputation", "retain_temporal_evidence", "retain_for_review"
_REVERSED = " OR ".join(f"{TIMES[j]}<{TIMES[i]}" for i in range(4) for j in range(i + 1, 4))
ISSUES_SQL = " UNION ALL ".join([
    *[_sql_issue("orders", "order_id", t, "missing_timestamp", f"{t} IS NULL", "NULL", _KM, "ord") for t in TIMES],
    *[_sql_issue("orders", "order_id", f"{s}_days", "negative_transition_duration", f"{b}<{a}",
                 f"CAST(round((epoch({b})-epoch({a}))/86400) AS BIGINT)", _TE, "ord") for s, a, b in STAGES],
    _sql_issue("orders", "order_id", "purchased_at", "recorded_milestones_out_of_order", f"({_REVERSED})",
               "strftime(purchased_at,'%Y-%m-%d %H:%M:%S')", _TE, "ord"),
    _sql_issue("orders", "order_id", "order_status", "delivered_without_delivery_timestamp",
               "order_status='delivered' AND delivered_at IS NULL", "order_status", _RV, "ord"),
    _sql_issue("orders", "order_id", "order_status", "non_delivered_status_with_delivery_timestamp",
               "order_status<>'delivered' AND delivered_at IS NOT NULL", "order_status", _RV, "ord"),
    *[_sql_issue("orders", "order_id", c, "missing_child_records",
                 f"order_id NOT IN (SELECT l_orderkey FROM lineitem)", "0", _KM, "ord") for c in ["item_count", "payment_count"]],
    _sql_issue("payments", "order_id||':'||payment_sequential", "payment_installments", "zero_payment_field_needs_context",
               "payment_installments=0", "payment_installments", _RV, "pay"),
    _sql_issue("payments", "order_id||':'||payment_sequential", "payment_type", "undefined_payment_type",
               "payment_type='not_defined'", "payment_type", _RV, "pay"),
    _sql_issue("products", "product_id", "category", "missing_product_attribute", "category IS NULL", "NULL", _KM, "prod"),
    _sql_issue("products", "product_id", "weight_g", "zero_physical_measurement", "weight_g=0", "weight_g",
               "retain_exclude_this_measurement", "prod"),
    _sql_issue("reviews", "doc_id", "score", "invalid_review_score", "n_chars%7 NOT BETWEEN 1 AND 5", "n_chars%7", _RV, "documents"),
    _sql_issue("reviews", "doc_id", "answered_s", "review_answer_before_creation", "n_chars<200", "n_chars", _RV, "documents"),
    _sql_issue("coordinates", "record", "lat", "invalid_earth_coordinate", "abs(lat)>90", "'lat'", "retain_exclude_this_coordinate", "geo"),
    _sql_issue("coordinates", "record", "lng", "invalid_earth_coordinate", "abs(lng*3)>180", "'lng'", "retain_exclude_this_coordinate", "geo"),
    _sql_issue("customers", "customer_id", "customer_zip", "unmatched_optional_reference",
               "customer_zip NOT IN (SELECT zip FROM geo)", "customer_zip", "retain_no_inferred_mapping", "cust")])


@query("p08_quality_issues", sql(ISSUES_SQL))
def quality_issues(shop):
    return quality.quality_issues(_issue_tables(shop))


@query("p09_issue_actions", sql(f"SELECT issue_code, CASE issue_code {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in quality.ISSUE_ACTIONS.items())} END AS usage_action, count(*) AS issues FROM ({ISSUES_SQL}) GROUP BY 1,2"))
def issue_actions(shop):
    return quality.issue_actions(quality.quality_issues(_issue_tables(shop))).groupBy("issue_code", "usage_action").agg(
        F.count(F.lit(1)).alias("issues"))


define("scoped", """SELECT o.*, coalesce(item_count,0) AS item_count, coalesce(product_count,0) AS product_count, coalesce(sc,0) AS seller_count,
  coalesce(kc,0) AS known_category_count, coalesce(mc,0) AS missing_category_item_count, cats,
  CASE WHEN item_count IS NULL THEN 'no_items' WHEN kc=0 THEN 'unknown_only' WHEN mc>0 THEN 'partially_unknown' WHEN kc>1 THEN 'mixed_category' ELSE 'single_category' END AS category_scope,
  CASE WHEN kc=1 AND mc=0 THEN cats[1] END AS single_category_name
 FROM ord o LEFT JOIN (SELECT order_id, count(*) AS item_count, count(DISTINCT product_id) AS product_count, count(DISTINCT seller_id) AS sc,
   count(DISTINCT category) AS kc, count(*)-count(category) AS mc, list_sort(list(DISTINCT category) FILTER (WHERE category IS NOT NULL)) AS cats
   FROM item LEFT JOIN prod USING (product_id) GROUP BY 1) i USING (order_id)""")
define("flagged", f"""SELECT *, CAST(carrier_at IS NULL AS BIGINT)+CAST(delivered_at IS NULL AS BIGINT) AS missing_milestone_count,
  CAST(coalesce(approved_at<purchased_at,false) AS BIGINT)+CAST(coalesce(carrier_at<approved_at,false) AS BIGINT)+CAST(coalesce(delivered_at<carrier_at,false) AS BIGINT) AS negative_transition_count,
  coalesce(approved_at<purchased_at,false) OR coalesce(carrier_at<purchased_at,false) OR coalesce(delivered_at<purchased_at,false) OR coalesce(carrier_at<approved_at,false)
   OR coalesce(delivered_at<approved_at,false) OR coalesce(delivered_at<carrier_at,false) AS has_reversed_milestones,
  (order_status='delivered')<>(delivered_at IS NOT NULL) AS status_delivery_conflict FROM scoped""")
define("quality", """SELECT *, order_status='delivered' AND missing_milestone_count=0 AND NOT has_reversed_milestones AS completed_timing_eligible,
  missing_milestone_count>0 OR has_reversed_milestones OR status_delivery_conflict AS temporal_review_required FROM flagged""")
define("grouped", """SELECT *, CASE WHEN status_delivery_conflict THEN 'status_delivery_conflict' WHEN has_reversed_milestones THEN 'recorded_timeline_reversal'
  WHEN order_status='delivered' AND missing_milestone_count>0 THEN 'delivered_missing_milestones' WHEN completed_timing_eligible THEN 'completed_timing_available'
  WHEN order_status IN ('canceled','unavailable') THEN 'canceled_or_unavailable_incomplete' ELSE 'nonfinal_status_cutoff_unknown' END AS usage_group FROM quality""")


def scoped(shop):
    return quality.usage_group(quality.timeline_flags(quality.scoped_orders(shop.orders, shop.items, shop.products)))


@query("p10_category_scope", sql("""SELECT order_id, item_count, product_count, seller_count, known_category_count, missing_category_item_count,
 category_scope, single_category_name, coalesce(array_to_string(cats,','),'') AS categories FROM scoped"""))
def category_scope(shop):
    return quality.scoped_orders(shop.orders, shop.items, shop.products).select(
        "order_id", "item_count", "product_count", "seller_count", "known_category_count", "missing_category_item_count",
        "category_scope", "single_category_name", F.coalesce(F.array_join("categories", ","), F.lit("")).alias("categories"))


@query("p11_duration_columns", sql("""SELECT order_id, round((epoch(approved_at)-epoch(purchased_at))/86400,6) AS approval_days,
 round((epoch(carrier_at)-epoch(approved_at))/86400,6) AS handling_days, round((epoch(delivered_at)-epoch(carrier_at))/86400,6) AS transport_days,
 round((epoch(delivered_at)-epoch(purchased_at))/86400,6) AS total_days FROM ord"""))
def durations(shop):
    cols = ["approval_days", "handling_days", "transport_days", "total_days"]
    return quality.duration_columns(shop.orders).select("order_id", *[F.round(c, 6).alias(c) for c in cols])


FLAGS = ["missing_milestone_count", "negative_transition_count", "has_reversed_milestones", "status_delivery_conflict",
         "completed_timing_eligible", "temporal_review_required"]


@query("p12_timeline_flags", sql(f"SELECT order_id, {', '.join(FLAGS)} FROM quality"))
def timeline_flags(shop):
    return quality.timeline_flags(shop.orders).select("order_id", *FLAGS)


@query("p13_usage_group", sql("""SELECT order_id, usage_group, usage_group IN ('status_delivery_conflict','recorded_timeline_reversal','delivered_missing_milestones') AS source_verification_priority,
 concat_ws(',', CASE WHEN order_status<>'delivered' THEN 'not_delivered_status' END, CASE WHEN missing_milestone_count>0 THEN 'missing_milestones' END,
  CASE WHEN has_reversed_milestones THEN 'reversed_recorded_timeline' END) AS reasons FROM grouped"""))
def usage_group(shop):
    return quality.usage_group(quality.timeline_flags(shop.orders)).select(
        "order_id", "usage_group", "source_verification_priority", F.array_join("timing_exclusion_reasons", ",").alias("reasons"))


@query("p14_duration_state", sql(" UNION ALL ".join(f"""SELECT '{s}' AS stage, CASE WHEN d IS NULL THEN 'missing_endpoint' WHEN d<0 THEN 'negative_observed' WHEN d=0 THEN 'zero_observed' ELSE 'positive_observed' END AS state,
 coalesce(d>=0,false) AS nonnegative_observed, count(*) AS orders FROM (SELECT epoch({b})-epoch({a}) AS d FROM ord) GROUP BY 1,2,3""" for s, a, b in STAGES)))
def duration_state(shop):
    pieces = ", ".join(f"'{s}', {s}_days" for s, _, _ in STAGES)
    long = quality.duration_columns(shop.orders).select(F.expr(f"stack({len(STAGES)}, {pieces}) AS (stage, d)"))
    return long.groupBy("stage", quality.duration_state(F.col("d")).alias("state"),
                        F.coalesce(F.col("d") >= 0, F.lit(False)).alias("nonnegative_observed")).agg(F.count(F.lit(1)).alias("orders"))


@query("p15_measurement_policy", sql("""SELECT product_id, weight_g>0 AS weight_g_usable, CASE WHEN weight_g>0 THEN weight_g END AS weight_g_feature,
 (SELECT count(DISTINCT order_id) FROM item i WHERE i.product_id=prod.product_id AND NOT (prod.weight_g>0)) AS orders_to_review FROM prod"""))
def measurement_policy(shop):
    policy = quality.measurement_policy(shop.products, ["weight_g"])
    bad = policy.where(~F.col("weight_g_usable")).select("product_id")
    affected = shop.items.join(bad, "product_id", "left_semi").groupBy("product_id").agg(
        F.count_distinct("order_id").alias("orders_to_review"))
    return policy.join(affected, "product_id", "left").select(
        "product_id", "weight_g_usable", "weight_g_feature", F.coalesce("orders_to_review", F.lit(0)).alias("orders_to_review"))


def import_source(shop):
    text = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    base = quality.scoped_orders(shop.orders, shop.items, shop.products).select(
        F.concat_ws("-", F.lit("a"), "order_id").alias("source_record"), F.col("order_id").cast("string").alias("order_id"),
        F.concat(F.lit(" "), F.col("order_status")).alias("order_status"),
        F.coalesce("single_category_name", F.lit("")).alias("category"),
        clock.split_of(F.col("purchased_at"), SPLIT_BOUNDS).alias("split"),
        text(clock.cutoff_of(F.col("purchased_at"), SPLIT_BOUNDS)).alias("cutoff"),
        text("purchased_at").alias("purchased_at"), text("approved_at").alias("approved_at"), text("carrier_at").alias("carrier_at"),
        F.when(F.col("priority").startswith("3"), F.date_format("delivered_at", "yyyy-MM-dd")).otherwise(F.date_format("delivered_at", "yyyy-MM-dd HH:mm:ss")).alias("delivered_at"),
        text("estimated_at").alias("estimated_at"), "priority")
    again = base.where(F.col("priority").startswith("1")).withColumns({
        "source_record": F.concat(F.lit("b"), F.col("source_record")), "order_id": F.concat("order_id", F.lit(" "))})
    changed = base.where(F.col("priority").startswith("2")).withColumns({
        "source_record": F.concat(F.lit("c"), F.col("source_record")), "category": F.lit("OTHER")})
    return base.unionByName(again).unionByName(changed).drop("priority")


IMPORT_MAP = {"delivered": "delivered", "shipped": "shipped", "canceled": "canceled"}
define("imp0", """SELECT 'a-'||order_id AS source_record, order_id::VARCHAR AS order_id, order_status AS raw_status,
  CASE WHEN order_status<>'processing' THEN order_status END AS order_status, coalesce(single_category_name,'') AS category,
  CASE WHEN purchased_at<TIMESTAMP '1999-01-01' THEN 'train' WHEN purchased_at<TIMESTAMP '2000-06-01' THEN 'validation' ELSE 'test' END AS split,
  CASE WHEN purchased_at<TIMESTAMP '1999-01-01' THEN TIMESTAMP '1999-01-01' WHEN purchased_at<TIMESTAMP '2000-06-01' THEN TIMESTAMP '2000-06-01' ELSE TIMESTAMP '2002-01-01' END AS cutoff,
  purchased_at, approved_at, carrier_at, CASE WHEN priority NOT LIKE '3%' THEN delivered_at END AS delivered_at, priority LIKE '3%' AND delivered_at IS NOT NULL AS bad_delivery, priority FROM scoped""")
define("imp", """SELECT *, CASE WHEN priority LIKE '1%' THEN 'duplicate_id_identical_rows' WHEN priority LIKE '2%' AND category<>'OTHER' THEN 'duplicate_id_conflicting_rows' END AS dup, priority LIKE '1%' AS collision
 FROM (SELECT * FROM imp0 UNION ALL SELECT * REPLACE ('b'||source_record AS source_record) FROM imp0 WHERE priority LIKE '1%')
UNION ALL SELECT * REPLACE ('c'||source_record AS source_record, 'OTHER' AS category), 'duplicate_id_conflicting_rows', false FROM imp0 WHERE priority LIKE '2%'""")
define("imp2", f"""SELECT *, list_sort(list_filter([CASE WHEN dup IS NOT NULL THEN dup END, CASE WHEN collision THEN 'normalized_id_collision' END,
  CASE WHEN order_status IS NULL THEN 'unmapped_status' END, CASE WHEN bad_delivery THEN 'invalid_timestamp' END,
  CASE WHEN category='' THEN 'missing_required_value' END], lambda x: x IS NOT NULL)) AS codes,
  ({" OR ".join(f"coalesce({TIMES[j]}<{TIMES[i]},false)" for i in range(4) for j in range(i + 1, 4))}) AS rev,
  CAST(carrier_at IS NULL AS INT)+CAST(delivered_at IS NULL AS INT) AS miss,
  ({" OR ".join(f"coalesce({t}>=cutoff,false)" for t in TIMES)}) AS crosses FROM imp""")


@query("p16_import_validate", sql("""SELECT source_record, order_id, order_status, CASE WHEN len(codes)>0 THEN 'quarantined' ELSE 'accepted' END AS disposition,
 array_to_string(codes,',') AS blocking_codes,
 CASE WHEN len(codes)>0 THEN 'quarantined' WHEN split='test' THEN 'reserved_test_not_used' WHEN category<>'LARGE' THEN 'outside_selected_category'
  WHEN NOT (order_status='delivered' AND miss=0 AND NOT rev) THEN 'timing_ineligible' WHEN crosses THEN 'completion_not_before_partition_cutoff' ELSE 'eligible_completed_timing' END AS timing_input_reason,
 CASE WHEN len(codes)>0 THEN 0 ELSE CAST(rev AS BIGINT)+CAST((order_status='delivered')<>(delivered_at IS NOT NULL) AS BIGINT)+CAST(miss>0 AS BIGINT)
  +CAST(approved_at=purchased_at AS BIGINT)+CAST(coalesce(carrier_at=approved_at,false) AS BIGINT)+CAST(coalesce(delivered_at=carrier_at,false) AS BIGINT)
  +CAST(order_status='delivered' AND miss=0 AND NOT rev AND crosses AS BIGINT) END AS note_count FROM imp2"""))
def import_validate(shop):
    ledger = cleaning.import_validate(import_source(shop), TIMES, "estimated_at", IMPORT_MAP, "LARGE", "yyyy-MM-dd HH:mm:ss")
    return ledger.select("source_record", "order_id", "order_status", "disposition",
                         F.array_join("blocking_codes", ",").alias("blocking_codes"), "timing_input_reason",
                         F.when(F.col("disposition") == "quarantined", 0).otherwise(F.size("issues")).cast("long").alias("note_count"))


@query("p17_duplicate_groups", """
SELECT user_id::VARCHAR AS user_id, count(*) AS records, CASE WHEN min(event_type)<>max(event_type) OR min(value)<>max(value) THEN 'duplicate_id_conflicting_rows' ELSE 'duplicate_id_identical_rows' END AS kind,
 concat_ws(',', CASE WHEN min(event_type)<>max(event_type) THEN 'event_type' END, CASE WHEN min(value)<>max(value) THEN 'value' END) AS conflicting
FROM events GROUP BY 1 HAVING count(*)>1""")
def duplicate_groups(shop):
    df = shop.table("events").select(F.col("user_id").cast("string").alias("user_id"), "event_type", "value")
    return cleaning.duplicate_groups(df, "user_id").withColumn("conflicting", F.array_join("conflicting", ","))


def eligible_orders(shop):
    df = scoped(shop).withColumns({"split": clock.split_of(F.col("purchased_at"), SPLIT_BOUNDS),
                                   "cutoff": clock.cutoff_of(F.col("purchased_at"), SPLIT_BOUNDS)})
    return quality.timing_eligibility(df, "LARGE")


define("elig", f"""SELECT *, CASE WHEN split='test' THEN 'reserved_test_not_used' WHEN coalesce(single_category_name,'')<>'LARGE' THEN 'outside_selected_category'
  WHEN NOT completed_timing_eligible THEN 'timing_ineligible' WHEN {" OR ".join(f"coalesce({t}>=cutoff,false)" for t in TIMES)} THEN 'completion_not_before_partition_cutoff' ELSE 'eligible_completed_timing' END AS timing_input_reason
 FROM (SELECT *, CASE WHEN purchased_at<TIMESTAMP '1999-01-01' THEN 'train' WHEN purchased_at<TIMESTAMP '2000-06-01' THEN 'validation' ELSE 'test' END AS split,
  CASE WHEN purchased_at<TIMESTAMP '1999-01-01' THEN TIMESTAMP '1999-01-01' WHEN purchased_at<TIMESTAMP '2000-06-01' THEN TIMESTAMP '2000-06-01' ELSE TIMESTAMP '2002-01-01' END AS cutoff FROM grouped)""")


@query("p18_timing_eligibility", sql("SELECT order_id, split, timing_input_reason, timing_input_reason='eligible_completed_timing' AS timing_input_eligible FROM elig"))
def timing_eligibility(shop):
    return eligible_orders(shop).select("order_id", "split", "timing_input_reason", "timing_input_eligible")


@query("p19_visible_before", sql(f"""SELECT order_id, {', '.join(f"CASE WHEN {t}<least(cutoff, TIMESTAMP '2000-01-01') THEN {t} END AS {t}" for t in TIMES)},
 {'+'.join(f"CAST(coalesce({t}>=least(cutoff, TIMESTAMP '2000-01-01'),false) AS BIGINT)" for t in TIMES)} AS hidden_values FROM elig"""))
def visible_before(shop):
    df = shop.orders.withColumn("cutoff", clock.cutoff_of(F.col("purchased_at"), SPLIT_BOUNDS))
    return quality.visible_before(df, TIMES, F.col("cutoff"), F.lit("2000-01-01").cast("timestamp_ntz")).select(
        "order_id", *TIMES, "hidden_values")


def disposition_input(shop):
    p = shop.performance
    visible = sum((F.col(t).isNotNull().cast("long") for t in TIMES[1:]), F.col(TIMES[0]).isNotNull().cast("long"))
    paid = shop.payments.groupBy("order_id").agg(F.sum("payment_cents").alias("payment_cents"))
    return p.join(paid, "order_id", "left").select(
        "order_id", "split", visible.alias("visible_events"), F.col("source_missing_milestones").alias("missing_events"),
        F.col("post_cutoff_milestones").alias("hidden_events"), F.col("visible_inversions").alias("inverted_pairs"),
        (F.size(quality.equal_pairs()) > 0).alias("has_equal_times"), F.col("performance_eligible").alias("timing_input_eligible"),
        "payment_cents", (~F.col("quality_conflict")).alias("geography_eligible"), "distance_band", "seller_count",
        F.col("product_count").alias("prior_comparable_orders"), F.col("days_late").alias("prior_reviewed_orders"))


@query("p20_business_scope_support", sql("""
WITH b AS (SELECT p.*, pc, CAST(purchased_at IS NOT NULL AS BIGINT)+CAST(approved_at IS NOT NULL AS BIGINT)+CAST(carrier_at IS NOT NULL AS BIGINT)+CAST(delivered_at IS NOT NULL AS BIGINT) AS vis,
  coalesce(purchased_at=approved_at,false) OR coalesce(purchased_at=carrier_at,false) OR coalesce(purchased_at=delivered_at,false) OR coalesce(approved_at=carrier_at,false) OR coalesce(approved_at=delivered_at,false) OR coalesce(carrier_at=delivered_at,false) AS eq,
  coalesce(product_count>0 AND days_late>0,false) AS sup FROM perf p LEFT JOIN (SELECT order_id, sum(payment_cents)::BIGINT AS pc FROM pay GROUP BY 1) y USING (order_id))
SELECT split, analysis_scope, support_state, recommended_use, reasons, count(*) AS orders FROM (
 SELECT split, 'process_evidence' AS analysis_scope, CASE WHEN vis=4 THEN 'available' ELSE 'partial' END AS support_state, CASE WHEN vis=4 THEN 'retain_evidence' ELSE 'retain_partial_evidence' END AS recommended_use,
  concat_ws(',', CASE WHEN source_missing_milestones>0 THEN 'source_milestones_missing' END, CASE WHEN post_cutoff_milestones>0 THEN 'events_not_visible_at_cutoff' END,
   CASE WHEN visible_inversions>0 THEN 'recorded_inversion_not_verified_entry_error' END, CASE WHEN eq THEN 'equal_times_not_observed_causal_order' END) AS reasons FROM b
 UNION ALL SELECT split, 'completed_timing', CASE WHEN performance_eligible THEN 'available' ELSE 'withheld' END, CASE WHEN performance_eligible THEN 'retain_evidence' ELSE 'withhold_from_named_analysis' END,
  CASE WHEN performance_eligible THEN '' ELSE 'preserve_saved_timing_eligibility_and_inner_cutoff' END FROM b
 UNION ALL SELECT split, 'payment_order_features', CASE WHEN pc>=0 THEN 'available' ELSE 'withheld' END, CASE WHEN pc>=0 THEN 'retain_evidence' ELSE 'withhold_from_named_analysis' END,
  CASE WHEN pc>=0 THEN '' ELSE 'missing_or_negative:payment_cents,' END||'retrospective_snapshot_not_verified_event_time_availability' FROM b
 UNION ALL SELECT split, 'geographic_context', CASE WHEN NOT quality_conflict THEN 'available' ELSE 'withheld' END, CASE WHEN NOT quality_conflict THEN 'retain_evidence' ELSE 'withhold_from_named_analysis' END,
  'inherited_provisional_zip_screen_not_verified_road_distance' FROM b
 UNION ALL SELECT split, 'seller_history', CASE WHEN seller_count=1 AND sup THEN 'available' ELSE 'withheld' END, CASE WHEN seller_count=1 AND sup THEN 'retain_evidence' ELSE 'withhold_from_named_analysis' END,
  concat_ws(',', 'prior_category_scoped_history_not_causal_seller_fault', CASE WHEN seller_count<>1 THEN 'multi_seller_order_level_outcome_not_attributed' END, CASE WHEN NOT sup THEN 'required_prior_outcomes_unavailable_not_zero' END) FROM b
) GROUP BY 1,2,3,4,5"""))
def business_scope_support(shop):
    return quality.scope_support(disposition_input(shop)).groupBy(
        "split", "analysis_scope", "support_state", "recommended_use", F.array_join("reasons", ",").alias("reasons")).agg(
        F.count(F.lit(1)).alias("orders"))


def evidence_codes(shop):
    p = shop.performance
    return p.withColumn("evidence_codes", quality.tristate.reasons([
        ("calendar_late", quality.tristate.known_true(F.col("performance_eligible") & (F.col("days_late") > 0))),
        ("recorded_inversion", F.col("visible_inversions") > 0), ("hidden_events", F.col("post_cutoff_milestones") > 0)]))


@query("p21_case_query", sql("""SELECT order_id, purchased_at, purchase_month, visible_inversions FROM perf WHERE split='validation' AND visible_inversions>0
 ORDER BY purchased_at, order_id LIMIT 50 OFFSET 20"""))
def case_query(shop):
    return quality.case_query(evidence_codes(shop), split="validation", code="recorded_inversion", offset=20, limit=50).select(
        "order_id", "purchased_at", "purchase_month", "visible_inversions")


@query("p21_case_query_counts", sql("""SELECT split, code, count(*) AS orders FROM (
 SELECT split, unnest([CASE WHEN performance_eligible AND days_late>0 THEN 'calendar_late' END, CASE WHEN visible_inversions>0 THEN 'recorded_inversion' END,
  CASE WHEN post_cutoff_milestones>0 THEN 'hidden_events' END]) AS code FROM perf) WHERE code IS NOT NULL GROUP BY 1,2"""))
def case_query_counts(shop):
    return evidence_codes(shop).select("split", F.explode("evidence_codes").alias("code")).groupBy("split", "code").agg(
        F.count(F.lit(1)).alias("orders"))


@query("p22_missing_feature_list", sql("""SELECT order_id, concat_ws(',', CASE WHEN carrier_at IS NULL THEN 'carrier_at' END, CASE WHEN delivered_at IS NULL THEN 'delivered_at' END,
 CASE WHEN promise_delta IS NULL THEN 'promise_delta' END) AS missing_features FROM perf"""))
def missing_features(shop):
    return shop.performance.select("order_id", F.array_join(
        quality.missing_feature_list(["carrier_at", "delivered_at", "promise_delta"]), ",").alias("missing_features"))


@query("p23_distance_band", """
WITH e AS (SELECT CASE WHEN len(embedding)>0 THEN abs(CAST(embedding[2] AS DOUBLE))*9000 END AS km FROM embeddings)
SELECT CASE WHEN km IS NULL THEN 'unavailable' WHEN km<50 THEN '0_to_50' WHEN km<200 THEN '50_to_200' WHEN km<500 THEN '200_to_500' WHEN km<1000 THEN '500_to_1000'
 WHEN km<2000 THEN '1000_to_2000' ELSE '2000_plus' END AS band, count(*) AS points FROM e GROUP BY 1""")
def distance_band(shop):
    km = F.abs(F.element_at("embedding", 2).cast("double")) * 9000
    return shop.table("embeddings").groupBy(quality.distance_band(km).alias("band")).agg(F.count(F.lit(1)).alias("points"))
