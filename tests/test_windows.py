"""Stability over training windows against counts per order, and fits of several populations at once."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from ordertide.operators import detectors, evaluation

WINDOWS = ["w0", "w1", "w2"]


def flags(spark, seed=3):
    rng = random.Random(seed)
    rows = [(w, o, c, c[0], rng.random() < (0.5 if c != "never" else 0)) for o in range(60) for c in ["a1", "b1", "never"] for w in WINDOWS]
    return rows, spark.createDataFrame(rows, "window string, order_id long, candidate string, family string, flag boolean")


def test_stability_changes_and_agreement_equal_counts(spark):
    rows, df = flags(spark)
    by = {(w, o, c): f for w, o, c, _, f in rows}
    votes = evaluation.window_votes(df, WINDOWS)
    for r in evaluation.window_stability(votes, WINDOWS).collect():
        own = [[by[(w, o, r.candidate)] for w in WINDOWS] for o in range(60)]
        sums = [sum(v[i] for v in own) for i in range(3)]
        changed = sum(0 < sum(v) < 3 for v in own)
        assert (r.scored_cases_per_window, r.windows_evaluated, r.min_flagged_cases, r.max_flagged_cases) == (60, 3, min(sums), max(sums))
        assert (r.cases_flagged_in_every_window, r.cases_flagged_in_any_window) == (sum(all(v) for v in own), sum(any(v) for v in own))
        assert r.cases_with_changed_decision == changed and r.changed_decision_fraction == pytest.approx(changed / 60)
        assert r.flag_rate_range_pp == pytest.approx(100 * (max(sums) - min(sums)) / 60)
    got = {(r.order_id, r.candidate): (r.windows_flagged, r.flagged_windows) for r in evaluation.window_changes(votes, WINDOWS).collect()}
    want = {}
    for o, c in itertools.product(range(60), ["a1", "b1", "never"]):
        named = [w for w in WINDOWS if by[(w, o, c)]]
        if 0 < len(named) < 3:
            want[(o, c)] = (len(named), named)
    assert got == want
    pairs = evaluation.window_agreement(votes, WINDOWS).collect()
    assert len(pairs) == 9
    for r in pairs:
        cells = [(by[(r.left_window, o, r.candidate)], by[(r.right_window, o, r.candidate)]) for o in range(60)]
        assert [r.both_flag, r.left_only, r.right_only, r.neither_flag] == [cells.count(x) for x in [(True, True), (True, False), (False, True), (False, False)]]
        assert r.jaccard_overlap == (None if r.candidate == "never" else pytest.approx(r.both_flag / r.union_flags))


def test_a_window_that_lacks_an_order_stops_the_job(spark):
    rows, df = flags(spark)
    for broken in [df.where("NOT (window = 'w1' AND order_id = 7)"), df.withColumn("flag", F.when(F.col("order_id") != 7, F.col("flag"))),
                   df.unionByName(df.where("order_id = 7 AND window = 'w0'"))]:
        with pytest.raises(Exception, match="one decision of every window"):
            evaluation.window_votes(broken, WINDOWS).collect()
    assert evaluation.window_votes(df.where("false"), WINDOWS).count() == 0


def test_fits_by_key_equal_separate_fits(spark):
    rng = random.Random(9)
    rows = [(o, "fit" if o < 150 else "validation", rng.randint(0, 40), rng.randint(0, 900)) for o in range(200)]
    df = spark.createDataFrame(rows, "order_id long, role string, a long, b long")
    starts = {"all": 0, "late": 70}
    fits = [df.where(F.col("role") == "fit").where(F.col("order_id") >= s).withColumn("window", F.lit(w)) for w, s in starts.items()]
    both = fits[0].unionByName(fits[1])
    joint = detectors.base_scores(df, ["a", "b"], *[detectors.fit_statistics(both, ["a", "b"], log, ["window"]) for log in [False, True]], ["window"])
    got = {(r.window, r.order_id, r.score_column): r.score for r in joint.collect()}
    want = {}
    for w, f in zip(starts, fits):
        one = detectors.base_scores(df, ["a", "b"], *[detectors.fit_statistics(f, ["a", "b"], log) for log in [False, True]])
        want |= {(w, r.order_id, r.score_column): r.score for r in one.collect()}
    assert got == want and len(got) == 2 * 200 * 8
