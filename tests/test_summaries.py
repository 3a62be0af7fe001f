"""Small summaries against values worked out by hand or by plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordertide.operators import cohort, evaluation, evidence, forecasts, geography, peers
from ordertide.streaming import milestones, scoring


def test_global_and_context_agree_with_plain_python(spark):
    draw = random.Random(3)
    stages = ["approval", "handling", "transport"]
    history = {s: [draw.randrange(0, 400) for _ in range(50)] for s in stages}
    rows = []
    for k in range(60):
        for s in stages[: 2 if k == 0 else 3]:
            n = draw.randrange(30, 60)
            rows.append((f"o{k}", s, draw.randrange(0, 450), draw.randrange(0, n + 1), n, k != 1, k != 2, "late" if k % 3 else "early"))
    d = peers.DURATION
    table = spark.createDataFrame(rows, f"order_id string, stage string, {d} long, ref_upto long, ref_n long, assessable boolean, performance_eligible boolean, performance_state string")
    reference = spark.createDataFrame([(s, v) for s, vs in history.items() for v in vs], f"stage string, {d} long")
    got = {(r.order_id, r.upper): (r.global_warning, r.context_warning) for r in evidence.global_and_context(table, reference, [0.5, 0.9]).collect()}
    want = {}
    for k in range(3, 60):
        own = [r for r in rows if r[0] == f"o{k}"]
        for u in (0.5, 0.9):
            want[f"o{k}", u] = (any(r[2] > 0 and sum(v <= r[2] for v in history[r[1]]) > u * 50 for r in own), any(r[2] > 0 and r[3] > u * r[4] for r in own))
    assert got == want
    flags = evidence.global_and_context(table, reference, [0.5, 0.9])
    summary = {(r.method, r.upper): r for r in evidence.method_sensitivity(flags).collect()}
    assert summary["global_ecdf", 0.5].warning_orders == sum(w[0] for (_, u), w in want.items() if u == 0.5)
    assert summary["context_ecdf", 0.9].context_only_warnings == sum(w[1] and not w[0] for (_, u), w in want.items() if u == 0.9)
    assert evidence.method_disagreements(flags).count() == sum(a != b for a, b in want.values())
    assert evidence.global_and_context(table.limit(0), reference, [0.5]).count() == 0


def test_vote_levels_count_unknown_as_not_raised(spark):
    cases = spark.createDataFrame([(True, True, True), (True, None, False), (None, None, None), (True, True, None)], "a boolean, b boolean, c boolean")
    got = {r.votes: (r.level, r.cases, r.percent) for r in cohort.vote_levels(cases, ["a", "b", "c"]).collect()}
    assert got == {0: ("none", 1, 25.0), 1: ("single", 1, 25.0), 2: ("majority", 1, 25.0), 3: ("all", 1, 25.0)}


def test_calibration_gap_without_calibration_cases_is_unknown(spark):
    flags = spark.createDataFrame([("x", "calibration", True), ("x", "calibration", False), ("x", "validation", False), ("y", "validation", True)],
                                  "candidate string, role string, flag boolean")
    got = {r.candidate: (r.calibration_rate, r.validation_rate, r.gap_pp) for r in evaluation.calibration_gap(flags).collect()}
    assert got == {"x": (0.5, 0.0, -50.0), "y": (None, 1.0, None)}


def test_group_support_with_unknown_groups(spark):
    rows = spark.createDataFrame([("fit", "a"), ("fit", None), ("late", "a"), ("late", None), ("late", "b"), ("late", "b")], "role string, g string")
    r = forecasts.group_support(rows, ["g"], F.col("role") == "fit", "role").first()
    assert (r.rows, r.unseen_rows, r.unseen_groups, r.least_fit_rows) == (4, 2, 1, 0)


def test_single_seller_states_with_unknown_state(spark):
    orders = spark.createDataFrame([(1, "c", 1, 10, 86400), (2, "c", 1, 11, 3 * 86400), (3, "c", 2, 10, 9), (4, "c", 1, 12, 2 * 86400)],
                                   "order_id long, category string, seller_count long, customer_id long, total_s long")
    items = spark.createDataFrame([(1, 5), (1, 5), (2, 5), (3, 5), (3, 6), (4, 7)], "order_id long, seller_id long")
    sellers = spark.createDataFrame([(5, "X"), (6, "X")], "seller_id long, seller_state string")
    customers = spark.createDataFrame([(10, "X"), (11, "Y"), (12, "X")], "customer_id long, customer_state string")
    r = cohort.single_seller_states(orders, items, customers, sellers).first()
    assert (r.single_seller_orders, r.same_state_orders, r.median_total_days) == (3, 1, 2.0) and r.same_state_fraction == pytest.approx(1 / 3)


def test_observation_summary_of_two_orders(spark):
    a, b, c, d = milestones.SLOTS
    states = spark.createDataFrame([("1", "t", "t", "t", "t", ["x"], []), ("2", "t", None, None, None, [], [])],
                                   f"order_id string, {a} string, {b} string, {c} string, {d} string, inversions array<string>, ties array<string>")
    events = spark.createDataFrame([("Purchased",), ("Purchased",), ("Delivered",)], "activity string")
    got = {(r.section, r.key): r.value for r in scoring.observation_summary(events, states).collect()}
    assert got == {("events_by_activity", "Purchased"): 2, ("events_by_activity", "Delivered"): 1, ("orders_by_visible_events", "4"): 1, ("orders_by_visible_events", "1"): 1,
                   ("orders", "observed"): 2, ("orders", "delivery_observed"): 1, ("orders", "delivery_not_observed"): 1, ("orders", "all_milestones_observed"): 1,
                   ("orders", "observed_inversions"): 1}


def test_rank_correlation_reads_its_rows_once(spark):
    """The rows come out of several joins; both rankings and the correlation share one pass over them."""
    rows = [("a" if i % 3 else "b", (i * 7) % 13, (i * 5) % 11) for i in range(60)]
    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    df = spark.createDataFrame(rows, "k string, x long, y long").withColumn("x", F.udf(seen, "long").asNondeterministic()("x"))
    got = {r.k: (r.paired_orders, r.spearman_rho) for r in geography.spearman(df, ["k"], "x", "y", width=1 << 16).collect()}
    assert read.value == len(rows)
    for k in "ab":
        x, y = (np.array([r[c] for r in rows if r[0] == k]) for c in (1, 2))
        mean_rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
        assert got[k][0] == len(x) and abs(got[k][1] - np.corrcoef(mean_rank(x), mean_rank(y))[0, 1]) < 1e-12
