"""SQL definitions of the order model, shared by the SQL checks. Independent of the Spark mapping."""

from __future__ import annotations

import re

CTES = {
    "ord": """SELECT o_orderkey AS order_id, o_custkey AS customer_id,
  CASE WHEN o_orderstatus='F' THEN 'delivered' WHEN o_orderstatus='O' THEN 'shipped'
       WHEN o_orderpriority LIKE '5%' THEN 'canceled' ELSE 'processing' END AS order_status,
  o_orderdate AS purchased_at, o_orderdate + to_days(CAST(substr(o_orderpriority,1,1) AS INTEGER)-1) AS approved_at,
  o_orderdate + INTERVAL 30 DAY AS estimated_at, CAST(round(o_totalprice*100) AS BIGINT) AS total_cents,
  o_orderpriority AS priority, s.carrier_at, s.delivered_at
 FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS carrier_at,
   max(l_shipdate) FILTER (WHERE l_returnflag<>'R') AS delivered_at FROM lineitem GROUP BY 1) s ON l_orderkey=o_orderkey""",
    "item": """SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS item_no, l_partkey AS product_id, l_suppkey AS seller_id,
  CAST(round(l_extendedprice*100) AS BIGINT) AS price_cents,
  (CAST(round(l_extendedprice*100) AS BIGINT)*CAST(round(l_tax*100) AS BIGINT))//100 AS freight_cents,
  l_shipdate AS shipping_limit_at FROM lineitem""",
    "pay": """SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS payment_sequential,
  CASE WHEN l_returnflag='N' THEN 'not_defined' ELSE l_returnflag END AS payment_type,
  CAST(l_linenumber-1 AS BIGINT) AS payment_installments,
  (CAST(round(l_extendedprice*100) AS BIGINT)*(100-CAST(round(l_discount*100) AS BIGINT)))//100 AS payment_cents FROM lineitem""",
    "prod": """SELECT p_partkey AS product_id, p_brand AS brand, CASE WHEN p_size<=45 THEN p_type END AS category,
  CAST(p_size-1 AS BIGINT) AS weight_g FROM part""",
    "cust": """SELECT c_custkey AS customer_id, n_name AS customer_state, lpad(CAST(c_nationkey//2 AS VARCHAR),5,'0') AS customer_zip
 FROM customer LEFT JOIN nation ON c_nationkey=n_nationkey""",
    "sell": """SELECT s_suppkey AS seller_id, n_name AS seller_state, lpad(CAST(s_nationkey//2 AS VARCHAR),5,'0') AS seller_zip
 FROM supplier LEFT JOIN nation ON s_nationkey=n_nationkey""",
    "geo": """SELECT vec_id AS record, lpad(CAST(label AS VARCHAR),5,'0') AS zip, CAST(embedding[1] AS DOUBLE)*90 AS lat,
  CAST(embedding[2] AS DOUBLE)*180 AS lng, 'S'||CAST(CAST(floor(abs(CAST(embedding[3] AS DOUBLE))*2) AS BIGINT) AS VARCHAR) AS state FROM embeddings""",
    "log": """SELECT order_id AS case_id, u.rank, u.activity, u.ts FROM ord, LATERAL (VALUES (CAST(0 AS BIGINT),'Purchased',purchased_at),(1,'Approved',approved_at),
  (2,'Handed to Carrier',carrier_at),(3,'Delivered',delivered_at)) u(rank,activity,ts) WHERE u.ts IS NOT NULL""",
    "fun": """SELECT CAST(user_id AS VARCHAR)||'@'||strftime(date_trunc('week',ts),'%Y-%m-%d') AS case_id, event_type AS activity,
  CAST(CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS BIGINT) AS rank, min(ts) AS ts
 FROM events WHERE event_type IN ('signup','view','click','purchase') GROUP BY 1,2,3""",
    "rev": """SELECT event_id AS review_id, CAST(user_id AS VARCHAR)||'@'||strftime(date_trunc('week',ts),'%Y-%m-%d') AS order_id,
  user_id % 10 AS seller_id, event_id % 5 + 1 AS score, CAST(epoch(date_trunc('hour',ts)) AS BIGINT) AS answered_s
 FROM events WHERE event_type IN ('click','error')""",
    "ctx": """SELECT o.*, c.customer_state, coalesce(i.seller_count,0) AS seller_count, coalesce(i.product_count,0) AS product_count,
  coalesce(i.item_count,0) AS item_count, i.first_product, i.first_seller,
  CASE WHEN total_cents<10000000 THEN 'low' WHEN total_cents<25000000 THEN 'middle' ELSE 'high' END AS distance_band
 FROM ord o LEFT JOIN cust c USING (customer_id) LEFT JOIN (SELECT order_id, count(DISTINCT seller_id) AS seller_count,
   count(DISTINCT product_id) AS product_count, count(*) AS item_count, min(product_id) AS first_product, min(seller_id) AS first_seller
   FROM item GROUP BY 1) i USING (order_id)""",
    "perf0": """SELECT *, CASE WHEN purchased_at<TIMESTAMP '1999-01-01' THEN 'train' WHEN purchased_at<TIMESTAMP '2000-06-01' THEN 'validation' ELSE 'test' END AS split,
  CASE WHEN purchased_at<TIMESTAMP '1999-01-01' THEN TIMESTAMP '1999-01-01' WHEN purchased_at<TIMESTAMP '2000-06-01' THEN TIMESTAMP '2000-06-01' ELSE TIMESTAMP '2002-01-01' END AS cutoff,
  (order_status='delivered') <> (delivered_at IS NOT NULL) AS status_delivery_conflict FROM ctx""",
    "perf1": """SELECT order_id, customer_id, split, cutoff, customer_state, distance_band, seller_count, product_count, item_count, first_product, first_seller,
  order_status, estimated_at, status_delivery_conflict, strftime(purchased_at,'%Y-%m') AS purchase_month,
  CASE WHEN seller_count=1 THEN 'single_seller_order' ELSE 'multi_seller_order' END AS seller_attribution_scope,
  CASE WHEN purchased_at<cutoff THEN purchased_at END AS purchased_at, CASE WHEN approved_at<cutoff THEN approved_at END AS approved_at,
  CASE WHEN carrier_at<cutoff THEN carrier_at END AS carrier_at, CASE WHEN delivered_at<cutoff THEN delivered_at END AS delivered_at,
  CAST(carrier_at IS NULL AS BIGINT)+CAST(delivered_at IS NULL AS BIGINT) AS source_missing_milestones,
  CAST(coalesce(purchased_at>=cutoff,false) AS BIGINT)+CAST(coalesce(approved_at>=cutoff,false) AS BIGINT)+CAST(coalesce(carrier_at>=cutoff,false) AS BIGINT)+CAST(coalesce(delivered_at>=cutoff,false) AS BIGINT) AS post_cutoff_milestones,
  CASE WHEN delivered_at IS NULL THEN 'source_missing' WHEN delivered_at>=cutoff THEN 'at_or_after_cutoff' ELSE 'visible' END AS delivery_visibility
 FROM perf0""",
    "perf2": """SELECT *, CAST(coalesce(approved_at<purchased_at,false) AS BIGINT)+CAST(coalesce(carrier_at<purchased_at,false) AS BIGINT)+CAST(coalesce(delivered_at<purchased_at,false) AS BIGINT)
  +CAST(coalesce(carrier_at<approved_at,false) AS BIGINT)+CAST(coalesce(delivered_at<approved_at,false) AS BIGINT)+CAST(coalesce(delivered_at<carrier_at,false) AS BIGINT) AS visible_inversions,
  datediff('day', CAST(estimated_at AS DATE), CAST(delivered_at AS DATE)) AS promise_delta FROM perf1""",
    "perf": """SELECT *, (visible_inversions>0 OR status_delivery_conflict) AS quality_conflict,
  CASE WHEN promise_delta<0 THEN -promise_delta WHEN promise_delta>=0 THEN 0 END AS days_early, CASE WHEN promise_delta>0 THEN promise_delta WHEN promise_delta<=0 THEN 0 END AS days_late,
  (promise_delta IS NOT NULL AND NOT (visible_inversions>0 OR status_delivery_conflict)) AS performance_eligible,
  CASE WHEN visible_inversions>0 OR status_delivery_conflict THEN 'excluded_source_conflict' WHEN promise_delta IS NULL THEN 'unknown'
   WHEN promise_delta<0 THEN 'early' WHEN promise_delta=0 THEN 'on_date' ELSE 'late' END AS performance_state FROM perf2""",
    "stage": """SELECT p.order_id, p.split, p.purchase_month, p.customer_state, p.distance_band, p.seller_attribution_scope, p.performance_state, p.quality_conflict, p.cutoff,
  p.product_count, p.item_count, p.seller_count, p.first_product, p.first_seller, p.performance_eligible, p.days_late,
  u.stage, u.s AS started_at, u.e AS ended_at, CAST(epoch(u.e)-epoch(u.s) AS BIGINT) AS duration_s,
  coalesce(CAST(epoch(u.e)-epoch(u.s) AS BIGINT)>=0, false) AND NOT p.quality_conflict AS duration_eligible
 FROM perf p, LATERAL (VALUES ('approval',purchased_at,approved_at),('handling',approved_at,carrier_at),('transport',carrier_at,delivered_at)) u(stage,s,e)""",
    "meas": """SELECT l.*, o_orderdate AS purchased_at, o_orderstatus AS raw_status,
  CASE WHEN o_orderdate<TIMESTAMP '1998-01-01' THEN 'fit' WHEN o_orderdate<TIMESTAMP '2000-01-01' THEN 'calibration' ELSE 'validation' END AS role
 FROM (SELECT l_orderkey AS order_id, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity, sum(CAST(round(l_extendedprice*100) AS BIGINT))::BIGINT AS price_cents,
   sum(CAST(round(l_discount*100) AS BIGINT))::BIGINT AS discount_points FROM lineitem GROUP BY 1) l JOIN orders ON o_orderkey=l.order_id""",
}


def define(name: str, text: str) -> None:
    CTES[name] = text


def _needed(text: str, found: list[str]) -> list[str]:
    for name in CTES:
        if name not in found and re.search(rf"\b(?:FROM|JOIN|from|join)\s+\(?{name}\b|,\s*{name}\s+\w\b", text):
            _needed(CTES[name], found)
            if name not in found:
                found.append(name)
    return found


def sql(body: str) -> str:
    """Prefix a SELECT with the definitions it uses."""
    names = _needed(body, [])
    if not names:
        return body.strip()
    head = ",\n".join(f"{n} AS MATERIALIZED (\n{CTES[n]}\n)" for n in names)
    text = body.strip()
    if re.match(r"(?is)with\s", text):
        return f"WITH {head},\n{text[4:].lstrip()}"
    return f"WITH {head}\n{text}"
