"""The milestone stream and its batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordertide.functions import clock
from ordertide.operators import ordered, peers
from ordertide.plans import peers as peer_plans
from ordertide.plans.ctes import define, sql
from ordertide.plans.registry import query, rounded
from ordertide.session import materialize, new_run_folder
from ordertide.streaming import milestones, scoring

START, CUTOFF = "1999-01-01 00:00:00", "2000-06-01 00:00:00"
ID = "[0-9]+"


def replayed(orders):
    """The orders whose events are replayed."""
    bought = F.col("purchased_at")
    return orders.where((bought >= F.lit("1999-01-01").cast("timestamp_ntz")) & (bought < F.lit("2000-06-01").cast("timestamp_ntz")))


def events(shop, orders=None):
    """Milestone events of ``orders`` (read from the tables where not given)."""
    return milestones.make_events(shop.milestones(replayed(shop.orders if orders is None else orders)).withColumnRenamed("case_id", "order_id"))


def accepted(shop, orders=None):
    return milestones.validate_events(events(shop, orders), ID, START, CUTOFF).where("reject_reason IS NULL").drop("reject_reason")


def written_events(shop):
    """The accepted events, written once: a replay reads them for every slice, its batch twin once more."""
    if "_written_events" not in shop.__dict__:
        shop.__dict__["_written_events"] = materialize(accepted(shop, written_orders(shop)), "events", "zstd")
    return shop.__dict__["_written_events"]


def written_orders(shop):
    """The orders in context, written once: both the reference and the projection of a scoring query read them."""
    if "_written_orders" not in shop.__dict__:
        shop.__dict__["_written_orders"] = shop.__dict__["contextual_orders"] = materialize(shop.contextual_orders, "orders-in-context", "zstd")
    return shop.__dict__["_written_orders"]


def frozen_reference(shop):
    if "_frozen_reference" not in shop.__dict__:
        written_orders(shop)  # the index reads the stage rows once, so they need no table
        shop.__dict__["_frozen_reference"] = peers.FrozenReference.of(peer_plans.reference(shop, peer_plans.stage_rows(shop)))
    return shop.__dict__["_frozen_reference"]


def context(shop, orders=None):
    """Context of ``orders`` (of all where not given)."""
    rows = (written_orders(shop) if orders is None else orders).select(
        "order_id", "customer_state", "distance_band", F.when(F.col("seller_count") == 1, "single_seller_order").otherwise("multi_seller_order").alias("seller_attribution_scope"),
        F.when(F.col("product_count") == 1, F.col("first_product")).alias("product_id"), F.when(F.col("seller_count") == 1, F.col("first_seller")).alias("single_seller_id"),
        "item_count", ((F.col("product_count") == 1) & (F.col("seller_count") == 1)).alias("product_attributable"),
        (F.col("item_count") > 0).alias("all_pairs_quality_eligible"))
    return scoring.context_projection(rows)


def replay_context(shop):
    """Context of the orders that have events: the others meet no state."""
    return context(shop, replayed(written_orders(shop)))


define("evt", """SELECT order_id::VARCHAR AS order_id, g.activity, g.rank, strftime(g.ts,'%Y-%m-%d %H:%M:%S') AS occurred_at FROM log g JOIN ord o ON o.order_id=g.case_id WHERE o.purchased_at>=TIMESTAMP '1999-01-01' AND o.purchased_at<TIMESTAMP '2000-06-01'""")
define("evi", """SELECT *, sha256('{"activity":"'||activity||'","occurred_at":"'||occurred_at||'","order_id":"'||order_id||'","schema_version":"milestone_event_v1"}') AS event_id FROM evt""")
define("acc", "SELECT * FROM evi WHERE occurred_at>='1999-01-01 00:00:00' AND occurred_at<'2000-06-01 00:00:00'")
define("revn", """SELECT order_id, row_number() OVER w AS revision, event_id, activity, occurred_at, max(CASE WHEN rank=0 THEN occurred_at END) OVER w AS t0, max(CASE WHEN rank=1 THEN occurred_at END) OVER w AS t1,
  max(CASE WHEN rank=2 THEN occurred_at END) OVER w AS t2, max(CASE WHEN rank=3 THEN occurred_at END) OVER w AS t3 FROM acc WINDOW w AS (PARTITION BY order_id ORDER BY occurred_at, rank)""")
_A = ["Purchased", "Approved", "Handed to Carrier", "Delivered"]
_INV = "concat_ws(',', " + ", ".join(f"CASE WHEN t{i}>t{j} THEN '{_A[i]}>{_A[j]}' END" for i in range(4) for j in range(i + 1, 4)) + ")"
_TIE = "concat_ws(',', " + ", ".join(f"CASE WHEN t{i}=t{j} THEN '{_A[i]}>{_A[j]}' END" for i in range(4) for j in range(i + 1, 4)) + ")"


@query("f12_event_id", sql("SELECT order_id, activity, event_id FROM evi"))
def event_id(shop):
    return events(shop).select("order_id", "activity", "event_id")


@query("t01_validate_events", sql("""SELECT coalesce(r,'accepted') AS outcome, count(*) AS events FROM (SELECT CASE WHEN activity='Approved' AND order_id LIKE '%7' THEN 'event_id_mismatch'
 WHEN occurred_at<'1999-01-01 00:00:00' THEN 'before_window' WHEN occurred_at>='2000-06-01 00:00:00' THEN 'window_closed' END AS r FROM evi) GROUP BY 1"""))
def validate(shop):
    bad = (F.col("activity") == "Approved") & F.col("order_id").endswith("7")
    e = events(shop).withColumn("event_id", F.when(bad, F.reverse("event_id")).otherwise(F.col("event_id")))
    return milestones.validate_events(e, ID, START, CUTOFF).groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("events"))


@query("t02_dedupe_events", sql("SELECT order_id, activity, event_id, 2::BIGINT AS copies FROM acc"))
def dedupe(shop):
    twice = accepted(shop).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return twice.groupBy("order_id", "activity", "event_id").agg(F.count(F.lit(1)).alias("copies"))


@query("t03_milestone_state", sql(f"""WITH l AS (SELECT * FROM revn QUALIFY revision=max(revision) OVER (PARTITION BY order_id))
SELECT order_id, revision, CASE WHEN t3 IS NOT NULL THEN 'Delivered' WHEN t2 IS NOT NULL THEN 'Handed to Carrier' WHEN t1 IS NOT NULL THEN 'Approved' ELSE 'Purchased' END AS highest_milestone, {_INV} AS inversions, {_TIE} AS ties,
 CASE WHEN {_INV}<>'' THEN 'observed_timeline_conflict' WHEN {_TIE}<>'' THEN 'equal_timestamp_order_unresolved' ELSE 'no_conflict_in_observed_timestamps' END AS timestamp_quality, greatest(t0,t1,t2,t3) AS last_observed_at FROM l"""))
def state(shop):
    s = milestones.latest_states(milestones.milestone_revisions(accepted(shop)))
    return s.select("order_id", "revision", "highest_milestone", F.array_join("inversions", ",").alias("inversions"), F.array_join("ties", ",").alias("ties"),
                    "timestamp_quality", "last_observed_at")


@query("t04_conflicting_milestone", sql("SELECT order_id, activity, 2::BIGINT AS events FROM acc WHERE activity='Delivered'"))
def conflict(shop):
    e = accepted(shop)
    changed = e.where("activity = 'Delivered'").withColumn("occurred_at", F.regexp_replace("occurred_at", "00:00:00", "12:00:00"))
    return milestones.conflicting_milestones(e.unionByName(changed.withColumn("event_id", milestones.event_id())))


@query("t05_late_arrival_policy", """WITH l AS (SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS arrived, CAST(epoch(l_shipdate) AS BIGINT) AS occurred FROM orders JOIN lineitem ON l_orderkey=o_orderkey),
m AS (SELECT arrived, max(max(occurred)) OVER (ORDER BY arrived ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM l GROUP BY 1)
SELECT strftime(make_timestamp(arrived*1000000),'%Y') AS year, count(*) AS events, count(*) FILTER (WHERE occurred<seen-86400*365) AS late_events FROM l JOIN m USING (arrived) GROUP BY 1""")
def late(shop):
    l = shop.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), clock.seconds(F.col("l_shipdate")).alias("occurred")).join(
        shop.table("orders").select("o_orderkey", clock.seconds(F.col("o_orderdate")).alias("arrived")), "o_orderkey")
    seen = ordered.running(l, [], "arrived", maxima={"m": F.col("occurred")}, width=ordered.WEEK).select("arrived", F.col("m_before").alias("seen"))
    return l.join(seen, "arrived").groupBy(F.date_format(F.timestamp_seconds("arrived"), "yyyy").alias("year")).agg(
        F.count(F.lit(1)).alias("events"), F.count(F.when(F.col("occurred") < F.col("seen") - 86400 * 365, 1)).alias("late_events"))


@query("t06_close_window", sql("SELECT activity, count(*) FILTER (WHERE occurred_at>='2000-06-01 00:00:00') AS refused_after_close, max(occurred_at) FILTER (WHERE occurred_at<'2000-06-01 00:00:00') AS last_accepted_at FROM evi GROUP BY 1"))
def close_window(shop):
    v = milestones.validate_events(events(shop), ID, START, CUTOFF)
    return v.groupBy("activity").agg(F.count(F.when(F.col("reject_reason") == "window_closed", 1)).alias("refused_after_close"),
                                     F.max(F.when(F.coalesce(F.col("reject_reason"), F.lit("")) != "window_closed", F.col("occurred_at"))).alias("last_accepted_at"))


def journal(shop):
    reference = frozen_reference(shop)
    return materialize(scoring.decision_journal(milestones.milestone_revisions(accepted(shop, written_orders(shop))), reference, replay_context(shop)), "journal")


define("asm0", f"""SELECT r.order_id, r.revision, s.stage, s.a AS start_at, s.b AS end_at, t0, {_INV} AS inv, {_TIE} AS tie FROM revn r, LATERAL (VALUES ('approval',t0,t1),('handling',t1,t2),('transport',t2,t3)) s(stage,a,b)""")
define("asm1", """SELECT a.*, CAST(epoch(end_at::TIMESTAMP)-epoch(start_at::TIMESTAMP) AS BIGINT) AS duration_s, c.customer_state, c.distance_band, c.item_count, CASE WHEN c.seller_count=1 THEN 'single_seller_order' ELSE 'multi_seller_order' END AS scope
 FROM asm0 a JOIN ctx c ON c.order_id::VARCHAR=a.order_id""")
define("asm2", """SELECT asm1.*, CASE WHEN inv<>'' THEN 'observed_timeline_conflict' WHEN tie<>'' THEN 'equal_timestamp_order_unresolved' WHEN duration_s IS NULL THEN 'stage_endpoint_not_observed' WHEN duration_s<=0 THEN 'nonpositive_or_unresolved_stage'
  WHEN t0 IS NULL THEN 'purchase_not_observed' END AS gate, CASE WHEN g0.grp IS NOT NULL THEN g0.grp ELSE g1.grp END AS grp FROM asm1
  LEFT JOIN (SELECT grp FROM gstat) g0 ON g0.grp='category0|'||stage||'|'||customer_state||'|'||distance_band||'|'||scope LEFT JOIN (SELECT grp FROM gstat) g1 ON g1.grp='category1|'||stage||'|'||distance_band||'|'||scope""")
define("asm3", """SELECT a.order_id, a.revision, a.stage, m.mode, a.duration_s, CASE WHEN gate IS NOT NULL THEN gate WHEN m.mode='verified_context_only' THEN 'context_availability_unverified' WHEN item_count=0 THEN 'geographic_quality_not_eligible'
   WHEN a.grp IS NULL THEN 'insufficient_matched_reference' ELSE 'assessed_under_context_assumption' END AS assessment_status, a.grp, g.ref_n, g.ref_sum_s, CASE WHEN gate IS NULL THEN (SELECT count(*) FROM bank b WHERE b.grp=a.grp AND b.duration_s<=a.duration_s) END AS c
  FROM asm2 a LEFT JOIN gstat g ON g.grp=a.grp, (VALUES ('verified_context_only'),('assumed_static_context_at_purchase')) m(mode)""")
define("asm", """SELECT *, CASE WHEN assessment_status='assessed_under_context_assumption' THEN CASE WHEN duration_s*ref_n<=ref_sum_s OR 20*c<=19*ref_n THEN 0.0 ELSE least(100.0,100.0*(20*c-19*ref_n)/ref_n) END END::DOUBLE AS delay_score FROM asm3""")
define("jrn", """SELECT *, CASE WHEN delay_score>0 THEN 'warning_emitted' WHEN delay_score IS NOT NULL THEN 'completed_stage_scored' WHEN ps IS NOT NULL THEN 'assessment_withdrawn_after_new_evidence' ELSE 'assessment_updated' END AS action
 FROM (SELECT *, lag(delay_score) OVER w AS ps, lag(assessment_status) OVER w AS pa, lag(duration_s) OVER w AS pd FROM (SELECT *, (SELECT (a0.start_at IS NOT NULL)::INT + 2*(a0.end_at IS NOT NULL)::INT FROM asm0 a0 WHERE a0.order_id=asm.order_id AND a0.revision=asm.revision AND a0.stage=asm.stage) AS obs FROM asm)
   WINDOW w AS (PARTITION BY order_id, stage, mode ORDER BY revision) QUALIFY revision=1 OR lag(obs) OVER w IS DISTINCT FROM obs OR ps IS DISTINCT FROM delay_score OR pa IS DISTINCT FROM assessment_status OR pd IS DISTINCT FROM duration_s)""")


@query("t07_score_stages", sql("SELECT order_id, revision, stage, mode, assessment_status, duration_s, round(delay_score,6) AS delay_score FROM asm"))
def score_stages(shop):
    revisions = materialize(milestones.milestone_revisions(accepted(shop, written_orders(shop))), "revisions")
    a = scoring.assess(revisions, ["order_id", "revision"], "", frozen_reference(shop), replay_context(shop), 30)
    return rounded(a.select("order_id", "revision", "stage", "mode", "assessment_status", "duration_s", "delay_score"))


@query("t08_decision_journal", sql("SELECT order_id, revision, stage, mode, action, assessment_status, round(delay_score,6) AS delay_score FROM jrn"))
def decision_journal(shop):
    return rounded(journal(shop).select("order_id", "revision", "stage", "mode", "action", "assessment_status", "delay_score"))


@query("t09_latest_stage_scores", sql("""SELECT mode, order_id, count(delay_score) AS scored_stages, CASE WHEN count(delay_score)=3 THEN 'complete' WHEN count(delay_score)>0 THEN 'partial' ELSE 'unavailable' END AS coverage, round(max(delay_score),6) AS max_stage_delay_score,
 CASE WHEN bool_or(delay_score>0) THEN true WHEN count(delay_score)=3 THEN false END AS any_warning, coalesce(array_to_string(list_sort(list(DISTINCT assessment_status) FILTER (WHERE delay_score IS NULL)),','),'') AS unassessed_reasons
FROM (SELECT * FROM asm QUALIFY revision=max(revision) OVER (PARTITION BY order_id)) GROUP BY 1,2"""))
def latest(shop):
    return rounded(scoring.order_scores(scoring.latest_stage_scores(journal(shop))))


@query("t09_latest_table", sql("""SELECT mode, order_id, count(delay_score) AS scored_stages, CASE WHEN count(delay_score)=3 THEN 'complete' WHEN count(delay_score)>0 THEN 'partial' ELSE 'unavailable' END AS coverage, round(max(delay_score),6) AS max_stage_delay_score,
 CASE WHEN bool_or(delay_score>0) THEN true WHEN count(delay_score)=3 THEN false END AS any_warning, coalesce(array_to_string(list_sort(list(DISTINCT assessment_status) FILTER (WHERE delay_score IS NULL)),','),'') AS unassessed_reasons
FROM (SELECT * FROM asm QUALIFY revision=max(revision) OVER (PARTITION BY order_id)) GROUP BY 1,2"""))
def latest_of_stream(shop):
    return rounded(scoring.order_scores(scoring.latest_table(shop.spark, run_stream(shop)).read()))


@query("t10_prefix_summary", sql("SELECT mode, stage, action, assessment_status, count(*) AS decisions, count(DISTINCT order_id) AS orders FROM jrn GROUP BY 1,2,3,4"))
def prefix(shop):
    return scoring.prefix_summary(journal(shop))


@query("t10_observation_summary", sql(f"""WITH l AS (SELECT *, (t0 IS NOT NULL)::INT+(t1 IS NOT NULL)::INT+(t2 IS NOT NULL)::INT+(t3 IS NOT NULL)::INT AS v, {_INV} AS i, {_TIE} AS e FROM (SELECT * FROM revn QUALIFY revision=max(revision) OVER (PARTITION BY order_id)))
SELECT 'events_by_activity' AS section, activity AS key, count(*) AS value FROM acc GROUP BY 2 UNION ALL SELECT 'orders_by_visible_events', v::VARCHAR, count(*) FROM l GROUP BY 2
UNION ALL SELECT 'orders', key, count(*) FROM (SELECT unnest([CASE WHEN true THEN 'observed' END, CASE WHEN t3 IS NOT NULL THEN 'delivery_observed' ELSE 'delivery_not_observed' END, CASE WHEN v=4 THEN 'all_milestones_observed' END,
 CASE WHEN i<>'' THEN 'observed_inversions' END, CASE WHEN e<>'' THEN 'equal_time_pairs' END]) AS key FROM l) WHERE key IS NOT NULL GROUP BY 2"""))
def observation_summary(shop):
    e = accepted(shop)
    return scoring.observation_summary(e, milestones.latest_states(milestones.milestone_revisions(e)))


@query("t10_scenario_summary", sql("""WITH o AS (SELECT mode, order_id, count(*) AS r, count(delay_score) AS s, count(*) FILTER (WHERE delay_score>0) AS w FROM (SELECT * FROM asm QUALIFY revision=max(revision) OVER (PARTITION BY order_id)) GROUP BY 1,2),
c AS (SELECT mode, count(*) AS orders, sum(r)::BIGINT AS stage_rows, sum(s)::BIGINT AS scored_stage_rows, count(*) FILTER (WHERE s>0) AS orders_with_any_score, count(*) FILTER (WHERE s=3) AS complete_orders, sum(w)::BIGINT AS current_warning_stages, count(*) FILTER (WHERE w>0) AS current_warning_orders FROM o GROUP BY 1),
d AS (SELECT mode, count(*) FILTER (WHERE action='warning_emitted') AS warning_emissions, count(*) FILTER (WHERE action='warning_emitted' AND t3 IS NULL) AS emissions_before_delivery, count(DISTINCT CASE WHEN action='warning_emitted' AND t3 IS NULL THEN order_id END) AS orders_warned_before_delivery,
 count(*) FILTER (WHERE action='assessment_withdrawn_after_new_evidence') AS assessment_withdrawals FROM jrn JOIN (SELECT order_id, revision, t3 FROM revn) USING (order_id, revision) GROUP BY 1) SELECT * FROM c JOIN d USING (mode)"""))
def scenario_summary(shop):
    revisions = materialize(milestones.milestone_revisions(accepted(shop, written_orders(shop))), "revisions")
    reference = frozen_reference(shop)
    return scoring.scenario_summary(materialize(scoring.decision_journal(revisions, reference, replay_context(shop)), "journal"), revisions)


_runs: dict[tuple, str] = {}


def _once(shop, name, build):
    """The folder of a replay; runs of one application over one data set share it."""
    key = (shop.spark.sparkContext.applicationId, shop.sf_dir, name)
    if key not in _runs:
        _runs[key] = build(new_run_folder(shop.spark, name))
    return _runs[key]


SLICES = ["1999-07-01 00:00:00", "2000-01-01 00:00:00"]
DELAY_DAYS = 30
#: The last slice of ``arrivals``: events after the close are in slice 4, and an approval comes up to two slices late.
LAST_SLICE = 6


def slices_by_time(rows, bounds):
    edges = [None, *bounds, None]
    for low, high in zip(edges[:-1], edges[1:]):
        yield rows.where((F.lit(True) if low is None else F.col("occurred_at") >= low) & (F.lit(True) if high is None else F.col("occurred_at") < high))


def _start(shop, folder, **sink):
    def start():
        checked = milestones.validate_events(scoring.read_events_stream(shop.spark, f"{folder}/in"), ID, START, CUTOFF)
        return scoring.write_decision_stream(milestones.milestone_revisions_stream(checked, CUTOFF, f"{DELAY_DAYS} days"), f"{folder}/out", f"{folder}/checkpoint", **sink)
    return start


def run_stream(shop):
    """Replay the accepted events in three slices of event time, each a run resumed from the checkpoint; returns the sink folder."""
    def build(folder):
        sink = {"reference": frozen_reference(shop), "context": materialize(replay_context(shop), "context")}
        scoring.replay(list(slices_by_time(written_events(shop), SLICES)), folder, _start(shop, folder, **sink))
        return f"{folder}/out"
    return _once(shop, "milestone-stream", build)


def arrivals(shop):
    """Events with the slice in which they arrive: deliveries one slice late, approvals two, copies of purchases and changed deliveries."""
    e = events(shop).withColumn("slice", F.when(F.col("occurred_at") < SLICES[0], 1).when(F.col("occurred_at") < SLICES[1], 2).when(F.col("occurred_at") < CUTOFF, 3).otherwise(4))
    order, activity = F.col("order_id").cast("long"), F.col("activity")
    late = e.withColumn("slice", F.col("slice") + F.when((order % 7 == 0) & (activity == "Delivered"), 1).when((order % 11 == 0) & (activity == "Approved"), 2).otherwise(0))
    again = e.where((order % 13 == 0) & (activity == "Purchased")).withColumn("slice", F.col("slice") + 1)
    changed = e.where((order % 17 == 0) & (activity == "Delivered")).withColumn("occurred_at", F.regexp_replace("occurred_at", "00:00:00", "12:00:00"))
    changed = changed.withColumn("event_id", milestones.event_id()).withColumn("slice", F.col("slice") + 1)
    return late.unionByName(again).unionByName(changed)


def run_arrivals(shop):
    """Replay ``arrivals`` in a run per slice; returns the sink folder. The last row of state must be gone at the end.

    ``state`` holds per run the rows of state it left, ``epochs`` the run of each micro-batch; a run without rows may have neither.
    """
    def build(folder):
        rows = materialize(arrivals(shop), "arrivals")
        runs = scoring.replay_progress([rows.where(F.col("slice") == k).drop("slice") for k in range(1, LAST_SLICE + 1)], folder, _start(shop, folder))
        states = [(k, progress[-1]["stateOperators"][0]["numRowsTotal"]) for k, progress in enumerate(runs, 1) if progress and progress[-1]["stateOperators"]]
        shop.spark.createDataFrame(states, "run long, state_rows long").coalesce(1).write.parquet(f"{folder}/out/state")
        epochs = [(p["batchId"], k) for k, progress in enumerate(runs, 1) for p in progress if p["numInputRows"]]
        shop.spark.createDataFrame(epochs, "epoch int, batch long").coalesce(1).write.parquet(f"{folder}/out/epochs")
        return f"{folder}/out"
    return _once(shop, "arrival-stream", build)


def outcomes(shop):
    """Every row of the arrival replay with its outcome and the slice its micro-batch delivered."""
    out = run_arrivals(shop)
    rows = [shop.spark.read.schema("order_id string, activity string, occurred_at string, outcome string, epoch int").parquet(f"{out}/{part}") for part in ("revisions", "late", "rejects")]
    rows = rows[0].unionByName(rows[1]).unionByName(rows[2])
    epochs = shop.spark.read.schema("epoch int, batch long").parquet(f"{out}/epochs")  # one row per micro-batch
    return rows.join(F.broadcast(epochs), "epoch")


define("arr0", """SELECT *, CASE WHEN occurred_at<'1999-07-01 00:00:00' THEN 1 WHEN occurred_at<'2000-01-01 00:00:00' THEN 2 WHEN occurred_at<'2000-06-01 00:00:00' THEN 3 ELSE 4 END AS base, CAST(order_id AS BIGINT) AS o FROM evt""")
define("arr", """SELECT order_id, activity, occurred_at, 0 AS ver, base + CASE WHEN o%7=0 AND activity='Delivered' THEN 1 WHEN o%11=0 AND activity='Approved' THEN 2 ELSE 0 END AS slice FROM arr0
 UNION ALL SELECT order_id, activity, occurred_at, 0, base+1 FROM arr0 WHERE o%13=0 AND activity='Purchased'
 UNION ALL SELECT order_id, activity, replace(occurred_at,'00:00:00','12:00:00'), 1, base+1 FROM arr0 WHERE o%17=0 AND activity='Delivered'""")
define("wmk", """SELECT s.slice, (SELECT max(occurred_at)::TIMESTAMP - INTERVAL 30 DAY FROM arr a WHERE a.slice<s.slice) AS w FROM (SELECT DISTINCT slice FROM arr) s""")
define("arrw", """SELECT arr.*, CASE WHEN occurred_at<'1999-01-01 00:00:00' THEN 'before_window' WHEN occurred_at>='2000-06-01 00:00:00' THEN 'window_closed' END AS reason,
  coalesce(w>=TIMESTAMP '2000-06-01',false) AS closed, coalesce(occurred_at::TIMESTAMP<w,false) AS behind FROM arr JOIN wmk USING (slice)""")
define("firsts", """SELECT order_id, activity, min({'s': slice, 't': occurred_at, 'v': ver}) AS f FROM arrw WHERE reason IS NULL AND NOT closed AND NOT behind GROUP BY 1,2""")
define("outc", """SELECT a.order_id, a.activity, a.occurred_at, a.slice, CASE WHEN reason IS NOT NULL THEN reason WHEN f.s=a.slice AND f.t=a.occurred_at AND f.v=ver THEN 'accepted' WHEN NOT closed AND f.s<=a.slice AND f.t=a.occurred_at AND f.v=ver THEN 'replayed'
  WHEN closed THEN 'refused_after_close' WHEN behind THEN 'late' ELSE 'conflicting_milestone' END AS outcome FROM arrw a LEFT JOIN firsts USING (order_id, activity)""")


@query("t02_dedupe_stream", sql("SELECT slice::BIGINT AS batch, activity, count(*) FILTER (WHERE outcome='accepted') AS accepted, count(*) FILTER (WHERE outcome='replayed') AS replayed FROM outc GROUP BY 1,2"))
def dedupe_stream(shop):
    return outcomes(shop).groupBy("batch", "activity").agg(F.count(F.when(F.col("outcome") == "accepted", 1)).alias("accepted"), F.count(F.when(F.col("outcome") == "replayed", 1)).alias("replayed"))


@query("t04_conflict_stream", sql("SELECT order_id, slice::BIGINT AS batch, occurred_at FROM outc WHERE outcome='conflicting_milestone'"))
def conflict_stream(shop):
    return outcomes(shop).where("outcome = 'conflicting_milestone'").select("order_id", "batch", "occurred_at")


@query("t05_late_arrival_stream", sql("SELECT slice::BIGINT AS batch, activity, count(*) FILTER (WHERE outcome='late') AS late_rows, count(*) FILTER (WHERE outcome='accepted') AS on_time_rows, max(occurred_at) FILTER (WHERE outcome='late') AS last_late_at FROM outc GROUP BY 1,2"))
def late_stream(shop):
    late_, taken = F.col("outcome") == "late", F.col("outcome") == "accepted"
    return outcomes(shop).groupBy("batch", "activity").agg(F.count(F.when(late_, 1)).alias("late_rows"), F.count(F.when(taken, 1)).alias("on_time_rows"), F.max(F.when(late_, F.col("occurred_at"))).alias("last_late_at"))


@query("t06_close_window_stream", sql("""SELECT slice::BIGINT AS batch, count(*) FILTER (WHERE outcome='refused_after_close') AS refused_after_close, count(*) FILTER (WHERE outcome='window_closed') AS outside_window,
 CASE WHEN slice>=4 THEN 0::BIGINT END AS state_rows_after_close FROM outc GROUP BY slice"""))
def close_stream(shop):
    state_ = shop.spark.read.parquet(f"{run_arrivals(shop)}/state").select(F.col("run").alias("batch"), F.when(F.col("run") >= 4, F.col("state_rows")).alias("state_rows_after_close"))
    counts = outcomes(shop).groupBy("batch").agg(F.count(F.when(F.col("outcome") == "refused_after_close", 1)).alias("refused_after_close"), F.count(F.when(F.col("outcome") == "window_closed", 1)).alias("outside_window"))
    return counts.join(state_, "batch")


@query("t11_stream_batch_parity", sql("SELECT (SELECT count(*) FROM acc) AS batch_revisions, (SELECT count(*) FROM acc) AS stream_revisions, CAST(0 AS BIGINT) AS only_batch, CAST(0 AS BIGINT) AS only_stream, (SELECT count(*) FROM jrn) AS journal_rows, CAST(0 AS BIGINT) AS journal_differences"))
def parity(shop):
    out = run_stream(shop)
    cols = milestones.REVISION_SCHEMA.names
    stream = shop.spark.read.schema(milestones.REVISION_SCHEMA).parquet(f"{out}/revisions").select(*cols)
    # Lies by order for both comparisons; the filter drops nothing, but with it both read the same and share one shuffle.
    batch = milestones.milestone_revisions(written_events(shop).where("order_id IS NOT NULL")).select(*cols)
    written = shop.spark.read.parquet(f"{out}/journal").drop("epoch")
    expected = scoring.decision_journal(batch, frozen_reference(shop), replay_context(shop)).select(*written.columns)
    revisions, decisions = scoring.multiset_counts(batch, stream, "order_id"), scoring.multiset_counts(expected, written, "order_id")
    return ordered.attach_one_row(
        revisions.select(F.col("rows").alias("batch_revisions"), F.col("other_rows").alias("stream_revisions"), F.col("only_rows").alias("only_batch"), F.col("only_other").alias("only_stream")),
        decisions.select(F.col("other_rows").alias("journal_rows"), (F.col("only_rows") + F.col("only_other")).alias("journal_differences")))


@query("s06_read_events_stream", sql("SELECT activity, count(*) AS revisions, count(DISTINCT order_id) AS orders FROM acc GROUP BY 1"))
def stream_read(shop):
    out = run_stream(shop)
    return shop.spark.read.schema(milestones.REVISION_SCHEMA).parquet(f"{out}/revisions").groupBy("activity").agg(
        F.count(F.lit(1)).alias("revisions"), F.count_distinct("order_id").alias("orders"))


@query("s07_write_decision_stream", sql("SELECT mode, action, count(*) AS decisions FROM jrn GROUP BY 1,2"))
def stream_write(shop):
    out = run_stream(shop)
    return shop.spark.read.parquet(f"{out}/journal").groupBy("mode", "action").agg(F.count(F.lit(1)).alias("decisions"))


@query("t12_event_lineage", sql("SELECT event_id, 'orders' AS source_table, order_id AS source_record, CASE rank WHEN 0 THEN 'purchased_at' WHEN 1 THEN 'approved_at' WHEN 2 THEN 'carrier_at' ELSE 'delivered_at' END AS source_field FROM evi"))
def lineage(shop):
    fields = F.create_map(*[F.lit(x) for p in zip(_A, ["purchased_at", "approved_at", "carrier_at", "delivered_at"]) for x in p])
    return events(shop).select("event_id", F.lit("orders").alias("source_table"), F.col("order_id").alias("source_record"),
                               fields[F.col("activity")].alias("source_field"))


@query("t13_context_projection", sql("""SELECT order_id::VARCHAR AS order_id, customer_state, distance_band, CASE WHEN seller_count=1 THEN 'single_seller_order' ELSE 'multi_seller_order' END AS seller_attribution_scope, CASE WHEN product_count=1 THEN first_product END AS product_id,
 CASE WHEN seller_count=1 THEN first_seller END AS single_seller_id, item_count, product_count=1 AND seller_count=1 AS product_attributable, item_count>0 AS all_pairs_quality_eligible FROM ctx"""))
def context_rows(shop):
    return context(shop)


@query("t14_tumbling_event_counts", "SELECT date_trunc('day',ts) AS window_start, event_type, count(*) AS events FROM events GROUP BY 1,2")
def tumbling(shop):
    return milestones.tumbling_counts(shop.table("events"), "ts", "1 day", "event_type")


_COUNT_BOUNDS, COUNT_DELAY = ["2024-01-10", "2024-01-20"], "2 days"


def run_counts(shop):
    """Stream the events in four runs, every fiftieth one run late; closed windows are appended to the sink. Returns all rows and the sink."""
    base = F.lit(0)
    for bound in _COUNT_BOUNDS:
        base = base + (F.col("ts") >= F.lit(bound).cast("timestamp_ntz")).cast("int")
    rows = materialize(shop.table("events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), (base + (F.col("event_id") % 50 == 0).cast("int")).alias("slice")), "count-arrivals")

    def build(folder):
        def start():
            source = scoring.read_events_stream(shop.spark, f"{folder}/in", T.StructType([T.StructField("event_type", T.StringType()), T.StructField("ts", T.TimestampType())]))
            counts = milestones.tumbling_counts(source.withWatermark("ts", COUNT_DELAY), "ts", "1 day", "event_type")
            return counts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").trigger(availableNow=True).start()
        scoring.replay([rows.where(F.col("slice") == k).drop("slice") for k in range(4)], folder, start)
        return f"{folder}/out"
    return rows, _once(shop, "tumbling-counts", build)


@query("t14_tumbling_stream", """WITH a AS (SELECT event_type, ts, date_trunc('day',ts) AS d, CAST(ts>='2024-01-10' AS INT)+CAST(ts>='2024-01-20' AS INT)+CAST(event_id%50=0 AS INT) AS slice FROM events),
w AS (SELECT slice, (SELECT max(ts) - INTERVAL 2 DAY FROM a b WHERE b.slice<a.slice) AS w FROM (SELECT DISTINCT slice FROM a) a)
SELECT d AS window_start, event_type, count(*) FILTER (WHERE w IS NULL OR d + INTERVAL 1 DAY > w) AS events, count(*) FILTER (WHERE d + INTERVAL 1 DAY <= w) AS late_rows
FROM a JOIN w USING (slice) WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM a) GROUP BY 1,2 HAVING count(*) FILTER (WHERE w IS NULL OR d + INTERVAL 1 DAY > w)>0""")
def tumbling_stream(shop):
    """Windows the stream has closed, and the rows that came for them after that: all that arrived less those counted."""
    rows, out = run_counts(shop)
    final = shop.spark.read.parquet(out)
    arrived = milestones.tumbling_counts(rows, "ts", "1 day", "event_type").withColumnRenamed("events", "arrived")
    both = final.join(arrived, ["window_start", "event_type"])
    return both.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", (F.col("arrived") - F.col("events")).alias("late_rows"))
