"""Pinned semantics: token replay, tri-state, Fleiss example, streams, snapshots, sampling."""

import pytest
from pyspark.sql import functions as F

from ordertide.functions import tristate
from ordertide.operators import cleaning, detectors, evaluation, process, relations, sampling
from ordertide.session import new_run_folder
from ordertide.sources import tables
from ordertide.streaming import milestones, scoring


def test_trace_fitness_pinned_cases(spark):
    cases = [([0, 1, 2, 3], 1.0), ([0, 1, 2], 0.75), ([0, 2, 3], 0.75), ([0, 2, 1, 3], 0.8), ([0], 0.5)]
    df = spark.createDataFrame([(r, f) for r, f in cases], "r array<long>, f double")
    for row in df.select("f", process.trace_fitness(F.col("r"), 4).alias("g")).collect():
        assert abs(row.f - row.g) < 1e-12


def test_any_known(spark):
    df = spark.createDataFrame([("a", True), ("a", None), ("a", False), ("b", False), ("b", False), ("c", False), ("c", None)], "k string, f boolean")
    assert {r.k: r.x for r in df.groupBy("k").agg(tristate.any_known(F.col("f")).alias("x")).collect()} == {"a": True, "b": False, "c": None}


def test_fleiss_worked_example(spark):
    table = [[0, 0, 0, 0, 14], [0, 2, 6, 4, 2], [0, 0, 3, 5, 6], [0, 3, 9, 2, 0], [2, 2, 8, 1, 1], [7, 7, 0, 0, 0], [3, 2, 6, 3, 0],
             [2, 5, 3, 2, 2], [6, 5, 2, 1, 0], [0, 2, 2, 3, 7]]
    rows = [(s, j) for s, counts in enumerate(table) for j, c in enumerate(counts) for _ in range(c)]
    k = evaluation.fleiss_kappa(spark.createDataFrame(rows, "subject long, label long")).first().fleiss_kappa
    assert round(k, 3) == 0.210


def test_bootstrap_interval_holds_the_weighted_kappa(spark):
    rows = [(1, 1)] * 40 + [(2, 2)] * 30 + [(3, 3)] * 20 + [(1, 2)] * 6 + [(3, 1)] * 4 + [(None, 1)]
    df = spark.createDataFrame(rows, "a int, b int")
    point = evaluation.cohen_kappa(df, "a", "b", weighted=True).first().kappa
    got = evaluation.bootstrap_kappa(df, "a", "b").first()
    assert got.replicates == got.valid == 2000 and got.lower < point < got.upper and got.upper - got.lower < 0.35
    assert got == evaluation.bootstrap_kappa(df, "a", "b").first()
    one = evaluation.bootstrap_kappa(df.where("a = 1 AND b = 1"), "a", "b").first()
    assert (one.valid, one.lower, one.upper) == (0, None, None)
    assert evaluation.bootstrap_kappa(df.limit(0), "a", "b").first().valid == 0


def test_duplicate_ids_quarantine_every_member(spark):
    df = spark.createDataFrame([("1", "x"), ("1", "y"), ("2", "x"), ("3", "z"), ("3", "z")], "id string, v string")
    got = {r.id: (r.records, r.kind, r.conflicting) for r in cleaning.duplicate_groups(df, "id").collect()}
    assert got == {"1": (2, "duplicate_id_conflicting_rows", ["v"]), "3": (2, "duplicate_id_identical_rows", [])}


def test_join_cardinality_is_enforced(spark):
    a = spark.createDataFrame([(1,), (2,)], "k long")
    b = spark.createDataFrame([(1, "x"), (1, "y")], "k long, v string")
    with pytest.raises(ValueError, match="repeats its key"):
        relations.join_checked(a, b, ["k"])


def test_snapshot_refuses_overwrite_and_detects_change(spark):
    path = new_run_folder(spark, "snapshot-test")
    df = spark.range(20).withColumn("v", F.col("id") * 2)
    tables.write_snapshot({"t": df}, path)
    assert tables.read_snapshot(spark, path, "t", df.schema, ["id"]).count() == 20
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_snapshot({"t": df}, path)
    spark.range(1).withColumn("v", F.col("id")).write.mode("append").parquet(f"{path}/t")
    with pytest.raises(ValueError, match="differs from its manifest"):
        tables.read_snapshot(spark, path, "t", df.schema, ["id"])


def test_zero_iqr_is_an_error(spark):
    df = spark.createDataFrame([(i, 5) for i in range(10)], "order_id long, x long")
    with pytest.raises(Exception, match="zero IQR or MAD"):
        detectors.fit_statistics(df, ["x"]).collect()


def test_isolation_forest_ranks_an_outlier_first(spark):
    rows = [(i, "fit", float(i % 7), float(i % 5)) for i in range(300)] + [(999, "q", 60.0, 80.0), (1000, "q", 3.0, 2.0)]
    df = spark.createDataFrame(rows, "order_id long, role string, a double, b double")
    nodes = detectors.isolation_forest_fit(df.where("role = 'fit'"), ["a", "b"], trees=40, samples=64)
    s = {r.order_id: r.score for r in detectors.isolation_forest_score(df.where("role = 'q'"), ["a", "b"], nodes, 40, 64).collect()}
    assert s[999] > 0.6 > s[1000]


def test_allocation_fills_strata_equally(spark):
    df = spark.createDataFrame([(i, "big" if i < 90 else "small") for i in range(95)], "id long, s string")
    got = sampling.stratified_equal_allocation(df, "s", "id", 20, "x").groupBy("s").count().collect()
    assert {r.s: r["count"] for r in got} == {"small": 5, "big": 15}


EVENTS = [("1", "Purchased", "2024-01-01 00:00:00"), ("1", "Approved", "2024-01-02 00:00:00"), ("1", "Delivered", "2024-01-05 00:00:00"),
          ("1", "Handed to Carrier", "2024-01-06 00:00:00"), ("2", "Purchased", "2024-01-03 00:00:00"), ("2", "Approved", "2024-01-03 00:00:00")]


def _events(spark, rows=EVENTS):
    log = spark.createDataFrame(rows, "order_id string, activity string, t string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    return milestones.make_events(log)


def test_validation_reasons(spark):
    e = _events(spark)
    bad = e.withColumn("event_id", F.lit("x"))
    got = milestones.validate_events(e.unionByName(bad), "[0-9]+", "2024-01-02 00:00:00", "2024-01-06 00:00:00").groupBy("reject_reason").count()
    assert {r.reject_reason: r["count"] for r in got.collect()} == {None: 4, "event_id_mismatch": 6, "before_window": 1, "window_closed": 1}


def test_stream_replays_conflicts_and_matches_batch(spark):
    folder = new_run_folder(spark, "stream-test")
    e = _events(spark)
    conflict = _events(spark, [("2", "Approved", "2024-01-04 00:00:00")])
    e.write.json(f"{folder}/in/a")
    e.unionByName(conflict).write.json(f"{folder}/in/b")
    source = spark.readStream.schema(milestones.EVENT_SCHEMA).json(f"{folder}/in/*")
    q = (milestones.milestone_revisions_stream(source).writeStream.format("parquet").option("path", f"{folder}/out")
         .option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.schema(milestones.REVISION_SCHEMA).parquet(f"{folder}/out")
    counts = {r.outcome: r["count"] for r in out.groupBy("outcome").count().collect()}
    assert counts == {"accepted": 6, "replayed": 6, "conflicting_milestone": 1}
    batch = milestones.milestone_revisions(e)
    accepted = out.where("outcome = 'accepted'")
    assert accepted.exceptAll(batch.select(*accepted.columns)).isEmpty() and batch.count() == 6


def test_withdrawal_after_new_evidence(spark):
    revisions = milestones.milestone_revisions(_events(spark))
    reference = spark.createDataFrame([(100 + i, "approval", 3600 * (i + 1)) for i in range(40)], "order_id long, stage string, duration_s long").withColumns({
        "customer_state": F.lit("S"), "distance_band": F.lit("low"), "seller_attribution_scope": F.lit("single_seller_order"), "product_id": F.lit(1),
        "single_seller_id": F.lit(1), "item_count": F.lit(1), "product_attributable": F.lit(False), "ended_at": F.lit("2023-01-01").cast("timestamp_ntz")})
    context = spark.createDataFrame([("1",), ("2",)], "order_id string").withColumns({
        "customer_state": F.lit("S"), "distance_band": F.lit("low"), "seller_attribution_scope": F.lit("single_seller_order"), "product_id": F.lit(1),
        "single_seller_id": F.lit(1), "item_count": F.lit(1), "product_attributable": F.lit(False), "all_pairs_quality_eligible": F.lit(True)})
    j = scoring.decision_journal(revisions, reference, context).where("order_id = '1' AND stage = 'approval' AND mode = 'assumed_static_context_at_purchase'")
    assert [r.action for r in j.orderBy("revision").collect()] == ["assessment_updated", "completed_stage_scored", "assessment_withdrawn_after_new_evidence"]
