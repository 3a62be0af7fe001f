"""Process mining over the event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordertide.functions import clock
from ordertide.operators import performance, process, quality
from ordertide.plans.ctes import define, sql
from ordertide.plans.registry import query
from ordertide.sources.star_schema import FUNNEL

# Independent fitness on the four-step net: which steps miss their input token, which tokens stay.
define("conf", """SELECT case_id, string_agg(activity,' -> ' ORDER BY ts, rank) AS variant, count(*) AS n, count(DISTINCT ts)<count(*) AS has_equal_times,
  list(rank ORDER BY ts, rank) AS r, bool_or(rank=3) AS has3 FROM fun GROUP BY 1""")
define("conf1", """SELECT *, n AS event_count, len(list_filter(r, lambda x: x>0 AND (list_position(r,x-1) IS NULL OR list_position(r,x-1)>list_position(r,x)))) AS miss0,
  len(list_filter(r, lambda x: x<3 AND (list_position(r,x+1) IS NULL OR list_position(r,x+1)<list_position(r,x)))) + CASE WHEN list_position(r,0) IS NULL THEN 1 ELSE 0 END AS rem,
  CASE WHEN has3 THEN 0 ELSE 1 END AS miss1 FROM conf""")
define("conf2", """SELECT *, 0.5*(1-(miss0+miss1)/(n+1.0))+0.5*(1-rem/(n+1.0)) AS fitness, 4-n AS missing_event_count,
  coalesce(list_position(r,1)<list_position(r,0),false) OR coalesce(list_position(r,2)<list_position(r,1),false) OR coalesce(list_position(r,3)<list_position(r,2),false) AS reversed_flag FROM conf1""")
BAND = "CASE WHEN fitness>=1.0 THEN '1.0' WHEN fitness>=0.8 THEN '0.8-<1.0' WHEN fitness>=0.5 THEN '0.5-<0.8' ELSE '<0.5' END"


@query("a07_activity_times", sql("""SELECT case_id, min(ts) FILTER (WHERE activity='signup') AS signup, min(ts) FILTER (WHERE activity='view') AS view,
 min(ts) FILTER (WHERE activity='click') AS click, min(ts) FILTER (WHERE activity='purchase') AS purchase FROM fun GROUP BY 1"""))
def activity_times(shop):
    return process.activity_times(shop.funnel_log, FUNNEL)


@query("a08_trace_variant", sql("SELECT case_id, variant, event_count, has_equal_times FROM conf1"))
def trace_variant(shop):
    return process.trace_variant(shop.funnel_log).drop("ranks")


@query("a09_variant_statistics", sql("""SELECT variant, max(event_count) AS event_count, round(max(fitness),6) AS fitness, count(*) AS case_count,
 round(100.0*count(*)/(SELECT count(*) FROM conf2),6) AS case_percent FROM conf2 GROUP BY 1"""))
def variant_statistics(shop):
    return process.variant_statistics(process.conformance(shop.funnel_log, FUNNEL)).withColumns(
        {c: F.round(c, 6) for c in ["fitness", "case_percent"]})


@query("a10_directly_follows", sql("""
WITH keep AS (SELECT case_id FROM conf WHERE NOT has_equal_times), e AS (SELECT activity AS source, lead(activity) OVER (PARTITION BY case_id ORDER BY ts, rank) AS target FROM fun WHERE case_id IN (SELECT case_id FROM keep))
SELECT source, target, count(*) AS edge_count FROM e WHERE target IS NOT NULL GROUP BY 1,2"""))
def directly_follows(shop):
    return process.directly_follows(shop.funnel_log)


@query("a10_directly_follows_orders", sql("""
WITH l AS (SELECT g.*, split FROM log g JOIN perf p ON p.order_id=g.case_id), keep AS (SELECT case_id FROM l GROUP BY 1 HAVING count(DISTINCT ts)=count(*)),
e AS (SELECT split, activity AS source, lead(activity) OVER (PARTITION BY case_id ORDER BY ts, rank) AS target FROM l WHERE case_id IN (SELECT case_id FROM keep))
SELECT split, source, target, count(*) AS edge_count FROM e WHERE target IS NOT NULL GROUP BY 1,2,3"""))
def directly_follows_orders(shop):
    log = shop.activity_log.join(shop.orders.select(F.col("order_id").alias("case_id"), clock.split_of(
        F.col("purchased_at"), [("train", "1999-01-01"), ("validation", "2000-06-01"), ("test", "2002-01-01")]).alias("split")), "case_id")
    return process.directly_follows(log, ["split"])


DUR = """count(*) AS rows, count(v) AS eligible_rows, count(*) FILTER (WHERE duration_s IS NULL) AS unknown_rows, count(*) FILTER (WHERE duration_s<0) AS negative_rows,
 count(*) FILTER (WHERE duration_s=0) AS zero_rows, round(avg(v)/86400,6) AS mean_days, round(min(v)/86400,6) AS min_days, round(max(v)/86400,6) AS max_days,
 round(quantile_cont(v,0.05)/86400,6) AS p05_days, round(quantile_cont(v,0.25)/86400,6) AS q25_days, round(quantile_cont(v,0.5)/86400,6) AS median_days,
 round(quantile_cont(v,0.75)/86400,6) AS q75_days, round(quantile_cont(v,0.95)/86400,6) AS p95_days"""
DAYS = ["mean_days", "min_days", "max_days", "p05_days", "q25_days", "median_days", "q75_days", "p95_days"]


@query("a11_duration_summary", sql(f"SELECT split, stage, {DUR} FROM (SELECT *, CASE WHEN duration_eligible THEN duration_s::DOUBLE END AS v FROM stage) GROUP BY 1,2"))
def duration_summary(shop):
    stages = performance.stage_rows(shop.performance)
    return process.duration_summary(stages, ["split", "stage"], "duration_s", F.col("duration_eligible")).withColumns(
        {c: F.round(c, 6) for c in DAYS})


@query("a11_duration_summary_all", sql(f"SELECT {DUR} FROM (SELECT *, duration_s::DOUBLE AS v FROM stage)"))
def duration_summary_all(shop):
    return process.duration_summary(performance.stage_rows(shop.performance), [], "duration_s").withColumns(
        {c: F.round(c, 6) for c in DAYS})


@query("w08_equal_time_events", sql("""SELECT case_id, activity, n AS same_time_events FROM (SELECT *, count(*) OVER (PARTITION BY case_id, ts) AS n FROM log) WHERE n>1"""))
def equal_time_events(shop):
    return process.equal_time_events(shop.activity_log).select("case_id", "activity", "same_time_events")


@query("f04_stage_durations", sql("""SELECT order_id, stage, duration_s, duration_eligible, CASE WHEN duration_s IS NULL THEN 'endpoint_not_visible' WHEN duration_s<0 THEN 'negative_recorded_duration'
 WHEN duration_s=0 THEN 'zero_recorded_duration' ELSE 'positive_observed' END AS duration_state FROM stage"""))
def stage_durations(shop):
    return performance.stage_rows(shop.performance).select("order_id", "stage", "duration_s", "duration_eligible", "duration_state")


@query("f05_calendar_parts", """SELECT strftime(o_orderdate,'%Y-%m') AS month, (isodow(o_orderdate)-1)::BIGINT AS weekday, strftime(o_orderdate,'%Y-%m')||CASE WHEN day(o_orderdate)<=15 THEN '-H1' ELSE '-H2' END AS half_month,
 strftime(date_trunc('week',o_orderdate),'%Y-%m-%d') AS week_start, strftime(o_orderdate,'%Y-%m')='1999-01' AS month_contains_cutoff, count(*) AS orders FROM orders GROUP BY 1,2,3,4,5""")
def calendar_parts(shop):
    d = F.col("o_orderdate")
    return shop.table("orders").groupBy(
        clock.month(d).alias("month"), F.weekday(d).cast("long").alias("weekday"), clock.half_month(d).alias("half_month"),
        clock.iso_week_start(d).alias("week_start"),
        clock.month_contains(d, F.lit("1999-01-01").cast("timestamp_ntz")).alias("month_contains_cutoff")).agg(F.count(F.lit(1)).alias("orders"))


_T = ["purchased_at", "approved_at", "carrier_at", "delivered_at"]
_PAIRS = [(a, b) for i, a in enumerate(_T) for b in _T[i + 1:]]


@query("f06_pairwise_inversions", sql(f"""SELECT order_id, concat_ws(',', {','.join(f"CASE WHEN {b}<{a} THEN '{a}>{b}' END" for a, b in _PAIRS)}) AS inversions,
 concat_ws(',', {','.join(f"CASE WHEN {b}={a} THEN '{a}>{b}' END" for a, b in _PAIRS)}) AS ties FROM ord"""))
def inversions(shop):
    return shop.orders.select("order_id", F.array_join(quality.pairwise_inversions(), ",").alias("inversions"),
                              F.array_join(quality.equal_pairs(), ",").alias("ties"))


@query("f07_trace_fitness", sql("SELECT case_id, round(fitness,6) AS fitness FROM conf2"))
def trace_fitness(shop):
    return process.conformance(shop.funnel_log, FUNNEL).select("case_id", F.round("fitness", 6).alias("fitness"))


@query("f08_fitness_band", sql(f"SELECT case_id, {BAND} AS fitness_band, missing_event_count, reversed_flag FROM conf2"))
def fitness_band(shop):
    return process.conformance(shop.funnel_log, FUNNEL).select("case_id", "fitness_band", "missing_event_count", "reversed_flag")


@query("k01_lowest_fitness", sql("SELECT case_id, round(fitness,6) AS fitness, variant FROM conf2 ORDER BY round(fitness,6), case_id LIMIT 25"))
def lowest(shop):
    df = process.conformance(shop.funnel_log, FUNNEL).withColumn("fitness", F.round("fitness", 6))
    return process.lowest(df, [F.col("fitness"), F.col("case_id")], 25).select("case_id", "fitness", "variant")
