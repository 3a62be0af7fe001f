"""Evidence codes of single rows: each condition alone, unknown conditions, and counts of evaluated models."""

import datetime

from pyspark.sql import functions as F

from ordertide.operators import evidence, history

CLEAN = {"order_id": 1, "visible_inversions": 0, "visible_events": 4, "has_equal_times": False, "all_pairs_quality_eligible": True, "seller_count": 1,
         "history_route": "single_seller_with_prior_outcomes", "prior_orders": 2, "payment_difference_cents": 0, "profiles_scored": 2, "profiles_with_warning": 0,
         "models_forecast": 2, "long_warnings": 0, "short_warnings": 0, "zero_warnings": 0}
SCHEMA = ("order_id long, visible_inversions long, visible_events long, has_equal_times boolean, all_pairs_quality_eligible boolean, seller_count long, history_route string, "
          "prior_orders long, payment_difference_cents long, profiles_scored long, profiles_with_warning long, models_forecast long, long_warnings long, short_warnings long, zero_warnings long")
CHANGES = [{"visible_inversions": 1}, {"visible_events": 3}, {"has_equal_times": True}, {"all_pairs_quality_eligible": False}, {"seller_count": 2}, {"history_route": "single_seller_no_prior_history"},
           {"prior_orders": 0}, {"payment_difference_cents": -1}, {"profiles_with_warning": 1}, {"long_warnings": 1}, {"short_warnings": 2}, {"zero_warnings": 1}, {"profiles_scored": None, "models_forecast": None}]


def test_each_condition_gives_its_code_and_no_other(spark):
    rows = [{**CLEAN, **c, "order_id": i} for i, c in enumerate(CHANGES)] + [{**CLEAN, "order_id": 100}, {k: None for k in CLEAN} | {"order_id": 101}, {**CLEAN, "order_id": 102, "seller_count": 3, "prior_orders": 0}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    got = {r.order_id: r.evidence_codes for r in evidence.integrated_evidence(df, [], evidence.case_codes()).collect()}
    names = [n for n, _ in evidence.case_codes()]
    assert len(names) == 13 and [got[i] for i in range(13)] == [[n] for n in names]
    assert got[100] == [] and got[101] == ["no_validation_model_result_here"] and got[102] == [names[4], names[6]]


def test_warnings_count_only_where_the_outcome_is_known(spark):
    df = spark.createDataFrame([(1, True, True), (1, True, False), (2, False, True), (3, True, None), (3, False, True)], "order_id long, known boolean, w boolean")
    got = {r.order_id: (r.models_forecast, r.models_evaluated, r.warned) for r in evidence.signal_counts(df, F.col("known"), {"warned": "w"}).collect()}
    assert got == {1: (2, 2, 1), 2: (1, 0, None), 3: (2, 1, 0)}


def test_trace_shape(spark):
    day = lambda d: datetime.datetime(2000, 1, d)
    df = spark.createDataFrame([(1, day(1), day(1), None), (2, day(1), day(2), day(3)), (3, None, None, None)], "id long, a timestamp_ntz, b timestamp_ntz, c timestamp_ntz")
    got = {r.id: (r.visible_events, r.has_equal_times) for r in evidence.trace_shape(df, ["a", "b", "c"]).collect()}
    assert got == {1: (2, True), 2: (3, False), 3: (0, False)}


def test_history_seen_is_the_sign_of_the_prior_counts(spark):
    pairs = spark.createDataFrame([(1, 7, 1, 10), (2, 7, 1, 10), (3, 7, 2, 20), (4, 7, 1, 31), (5, 8, 1, 5), (6, None, 1, 9), (7, None, 1, 10), (8, 8, 1, None), (9, 9, 1, 3), (10, 9, 1, 4)],
                                  "order_id long, seller_id long, seller_count long, as_of_s long")
    outcomes = spark.createDataFrame([(7, 20), (7, 30), (9, 4), (9, None), (11, 1)], "seller_id long, delivered_s long")
    sign = lambda df: {r.order_id: (min(r.prior_orders, 1), min(r.prior_completed_orders, 1)) for r in df.collect()}
    assert sign(history.seller_history_seen(pairs, outcomes)) == sign(history.seller_prior_counts(pairs, outcomes))


def test_case_evidence_reads_lines_once_for_pairs_and_once_for_measures(spark):
    from ordertide.plans import evidence as plans
    from ordertide.plans import history as hist
    from ordertide.sources.star_schema import Shop

    shop = Shop(spark, "/root/testdata/sf0.001")
    plans.predicted(shop)
    hist.written_pairs(shop)
    for df in (shop.__dict__["predicted_fit"], hist.pairs(shop)):
        assert "l_orderkey" not in df._jdf.queryExecution().optimizedPlan().toString()
