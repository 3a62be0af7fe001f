"""The milestone stream over several runs: outcomes, closing, retried epochs, the latest table and the frozen reference."""

import itertools
import random
import re
import uuid

from pyspark.sql import functions as F

from ordertide.operators import peers
from ordertide.session import new_run_folder
from ordertide.streaming import milestones, scoring


def events(spark, rows):
    made = spark.createDataFrame(rows, "order_id string, activity string, occurred_at string").withColumn("schema_version", F.lit(milestones.SCHEMA_VERSION))
    return made.withColumn("event_id", milestones.event_id()).select(*milestones.EVENT_SCHEMA.names)


def test_outcomes_over_runs(spark):
    folder = new_run_folder(spark, f"stream-test-{uuid.uuid4().hex[:6]}")
    slices = [
        [("1", "Purchased", "2000-01-10 00:00:00"), ("2", "Purchased", "2000-01-01 00:00:00"), ("x", "Purchased", "2000-01-02 00:00:00")],
        [("1", "Purchased", "2000-01-10 00:00:00"), ("1", "Approved", "2000-01-08 00:00:00"), ("2", "Approved", "2000-01-03 00:00:00"),
         ("2", "Purchased", "2000-01-09 00:00:00"), ("3", "Delivered", "2000-03-01 00:00:00")],
        [("3", "Purchased", "2000-01-30 00:00:00"), ("1", "Purchased", "2000-01-10 00:00:00")],
    ]

    def start():
        source = scoring.read_events_stream(spark, f"{folder}/in")
        checked = milestones.validate_events(source, "[0-9]+", "2000-01-01 00:00:00", "2000-02-01 00:00:00")
        return scoring.write_decision_stream(milestones.milestone_revisions_stream(checked, "2000-02-01 00:00:00", "5 days"), f"{folder}/out", f"{folder}/checkpoint")

    runs = scoring.replay([events(spark, rows) for rows in slices], folder, start)
    read = lambda part: sorted(tuple(r) for r in spark.read.parquet(f"{folder}/out/{part}").select("order_id", "activity", "occurred_at", "outcome").collect())
    assert read("revisions") == [("1", "Approved", "2000-01-08 00:00:00", "accepted"), ("1", "Purchased", "2000-01-10 00:00:00", "accepted"), ("2", "Purchased", "2000-01-01 00:00:00", "accepted")]
    assert read("late") == [("2", "Approved", "2000-01-03 00:00:00", "late")]
    assert read("rejects") == [("1", "Purchased", "2000-01-10 00:00:00", "refused_after_close"), ("1", "Purchased", "2000-01-10 00:00:00", "replayed"),
                               ("2", "Purchased", "2000-01-09 00:00:00", "conflicting_milestone"), ("3", "Delivered", "2000-03-01 00:00:00", "window_closed"),
                               ("3", "Purchased", "2000-01-30 00:00:00", "refused_after_close"), ("x", "Purchased", "2000-01-02 00:00:00", "invalid_order_id")]
    assert runs[0]["stateOperators"][0]["numRowsTotal"] > 0 and runs[-1]["stateOperators"][0]["numRowsTotal"] == 0


def results(spark, rows):
    fields = "order_id string, stage string, mode string, revision long, delay_score double"
    made = spark.createDataFrame(rows, fields)
    return made.selectExpr("order_id", "stage", "mode", "revision", "1L AS duration_s", "'a' AS observation_status", "'b' AS assessment_status", "40L AS ref_n",
                           "delay_score", "'none' AS severity", "false AS delay_warning")


def test_latest_table_survives_retries_and_folding(spark):
    table = scoring.latest_table(spark, new_run_folder(spark, "latest-test"), compact_after=3)
    assert table.read().count() == 0
    want = {}
    for epoch in range(7):
        rows = [(str(k), "transport", "m", epoch, float(10 * epoch + k)) for k in range(epoch % 3, 5)]
        assert table.apply(results(spark, rows), epoch)
        assert not table.apply(results(spark, [("0", "transport", "m", 99, -1.0)]), epoch)  # a retried epoch changes nothing
        want |= {r[0]: (r[3], r[4]) for r in rows}
        assert {r["order_id"]: (r["revision"], r["delay_score"]) for r in table.read().collect()} == want
    assert len(table.epochs()[0]) < 3 and table.epochs()[1] >= 0


def test_an_epoch_written_half_is_not_read(spark):
    path = new_run_folder(spark, "latest-test")
    table = scoring.latest_table(spark, path)
    table.apply(results(spark, [("1", "s", "m", 1, 1.0)]), 0)
    results(spark, [("1", "s", "m", 2, 2.0)]).write.parquet(f"{path}/latest/changes/1")  # written, never entered
    assert table.read().first()["revision"] == 1
    assert table.apply(results(spark, [("1", "s", "m", 3, 3.0)]), 1)
    assert table.read().first()["revision"] == 3


def test_frozen_reference_ranks_like_counting(spark):
    rng = random.Random(4)
    durations = [rng.choice([0, 5, 70_000, 70_001, 140_000, 900_000]) + rng.randint(0, 3) for _ in range(90)]
    reference = spark.createDataFrame([("transport", "near", "one", d, "2000-01-01") for d in durations],
                                      "stage string, distance_band string, seller_attribution_scope string, duration_s long, ended_at string")
    levels = [["distance_band", "seller_attribution_scope"]]
    halves = reference.limit(40)
    whole = peers.FrozenReference.of(reference, levels, [], 30)
    grown = peers.FrozenReference.of(halves, levels, [], 30).added(reference.exceptAll(halves))
    probes = sorted({*durations, -3, 1, 60_000, 65_536, 131_072, 400_000, 899_999, 2_000_000})
    rows = spark.createDataFrame([(k, d) for k, d in enumerate(probes)], "order_id int, duration_s long").selectExpr(
        "order_id", "'transport' AS stage", "'near' AS distance_band", "'one' AS seller_attribution_scope", "duration_s")
    for frozen in (whole, grown):
        got = {r["duration_s"]: (r["ref_upto"], r["ref_n"], r["ref_sum_s"]) for r in peers.select_peers(rows, frozen).collect()}
        assert got == {d: (sum(x <= d for x in durations), 90, sum(durations)) for d in probes}
    assert list(itertools.chain(peers.FrozenReference.of(halves, levels, [], 41).statistics.collect())) == []


def test_the_arrival_replay_delivers_every_slice(spark, tmp_path):
    """An approval after the close that comes two slices late, and no rows in the second and fifth slice."""
    import duckdb

    import __spark_entry__ as entry
    from tests.harness import compare

    orders = [(11, "2000-05-30", "5-LOW"), (22, "1999-03-01", "5-LOW"), (7, "1999-03-02", "2-HIGH")]
    lines = [(11, "2000-07-15", "N"), (22, "1999-03-08", "N"), (7, "1999-03-09", "N")]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate string, o_orderpriority string").selectExpr(
        "o_orderkey", "1L AS o_custkey", "'F' AS o_orderstatus", "10.0D AS o_totalprice", "CAST(o_orderdate AS timestamp_ntz) AS o_orderdate", "o_orderpriority").coalesce(
        1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_shipdate string, l_returnflag string").selectExpr(
        "l_orderkey", "CAST(l_shipdate AS timestamp_ntz) AS l_shipdate", "l_returnflag").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("t02_dedupe_stream", "t05_late_arrival_stream", "t06_close_window_stream"):
        ok, rows, note = compare(con, spark, entry.queries()[name], entry.oracle_sql()[name], str(tmp_path))
        assert ok and rows, f"{name}: {note}"


def test_lines_are_not_copied_for_distinct_counts(spark):
    """Two distinct counts in one aggregate copy every line per counted column, and the copies are shuffled."""
    from ordertide.sources.star_schema import Shop

    plan = Shop(spark, "/root/testdata/sf0.001").contextual_orders._jdf.queryExecution().executedPlan().toString()
    assert "count(distinct" in plan and "Expand" not in plan


def test_category_scope_copies_no_lines(spark):
    from ordertide.operators import quality
    from ordertide.sources.star_schema import Shop

    shop = Shop(spark, "/root/testdata/sf0.001")
    assert "Expand" not in quality.scoped_orders(shop.orders, shop.items, shop.products)._jdf.queryExecution().executedPlan().toString()


def test_revisions_that_lie_by_order_are_not_dealt_again(spark):
    """A journal of batch revisions is read where their orders lie: no shuffle after theirs carries an event."""
    rows = [("1", "Purchased", "2000-01-01 00:00:00"), ("1", "Approved", "2000-01-03 00:00:00"), ("2", "Purchased", "2000-01-02 00:00:00")]
    reference = spark.createDataFrame([("approval", "near", "one", "SP", 86400 * d, "1999-01-01") for d in range(1, 4)],
                                      "stage string, distance_band string, seller_attribution_scope string, customer_state string, duration_s long, ended_at string")
    context = spark.createDataFrame([("1", "SP", "near", "one", 5, 6, 1, True, True)], "order_id string, customer_state string, distance_band string, seller_attribution_scope string, "
                                    "product_id long, single_seller_id long, item_count long, product_attributable boolean, all_pairs_quality_eligible boolean")
    frozen = peers.FrozenReference.of(reference, product_levels=[], minimum=3)
    made = scoring.decision_journal(milestones.milestone_revisions(events(spark, rows)), frozen, context)
    plan = spark._jvm.PythonSQLUtils.explainString(made._jdf.queryExecution(), "formatted")
    dealt = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert dealt and not any("event_id" in columns or "_steps" in columns for columns in dealt)
    scored = {(r["order_id"], r["revision"]): r["ref_n"] for r in made.where("stage = 'approval' AND mode = 'assumed_static_context_at_purchase'").collect()}
    assert scored == {("1", 1): None, ("1", 2): 3, ("2", 1): None}


def test_multiset_counts_are_those_of_except_all(spark):
    rng = random.Random(5)
    rows = lambda n: [(str(rng.randint(0, 9)), rng.choice(["a", "b", None]), rng.choice([1.0, None, 2.5])) for _ in range(n)]
    fields = "order_id string, s string, d double"
    a, b = spark.createDataFrame(rows(90), fields), spark.createDataFrame([*rows(70), ("99", None, None), ("99", None, None)], fields)
    for left, right in ((a, b), (a, a), (a.limit(0), b), (a.limit(0), a.limit(0))):
        assert tuple(scoring.multiset_counts(left, right, "order_id").first()) == (left.count(), right.count(), left.exceptAll(right).count(), right.exceptAll(left).count())
