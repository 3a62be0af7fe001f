"""Chunked ordered primitives against brute force, including one hot key and metamorphic checks."""

import random

import numpy as np
from pyspark.sql import functions as F

from ordertide.operators import evaluation, history, ordered, peers, process

RNG = random.Random(11)
ROWS = [("hot" if RNG.random() < 0.4 else f"k{RNG.randint(0, 6)}", RNG.randint(-40, 400), RNG.randint(0, 9)) for _ in range(600)]


def frame(spark):
    return spark.createDataFrame(ROWS, "k string, t long, v long")


def test_running_matches_brute_force_for_any_chunk_width(spark):
    for width in [1, 7, 1000]:
        got = {(r.k, r.t): (r.s_before, r.s_upto, r.s_total, r.m_before) for r in ordered.running(
            frame(spark), ["k"], "t", {"s": F.col("v")}, {"m": F.col("v")}, width=width).collect()}
        for k, t, _ in ROWS:
            own = [(a, v) for kk, a, v in ROWS if kk == k]
            earlier = [v for a, v in own if a < t]
            assert got[(k, t)] == (sum(earlier), sum(v for a, v in own if a <= t), sum(v for _, v in own), max(earlier, default=None))


def test_running_with_split_points_and_descending(spark):
    a = ordered.running(frame(spark).withColumn("t", F.col("t") / 3), ["k"], "t", {"s": F.col("v")}, descending=True).collect()
    for r in a:
        assert r.s_before == sum(v for k, t, v in ROWS if k == r.k and t / 3 > r.t)


def test_quantiles_equal_numpy_linear(spark):
    got = {r.k: (r.a, r.b, r.n) for r in ordered.quantiles(frame(spark), ["k"], "t", {"a": .05, "b": .5}, count="n", width=13).collect()}
    for k in {r[0] for r in ROWS}:
        x = np.array([t for kk, t, _ in ROWS if kk == k])
        assert np.allclose(got[k][:2], np.quantile(x, [.05, .5])) and got[k][2] == len(x)


def test_strictly_prior_excludes_ties_and_future_rows_do_not_matter(spark):
    df = frame(spark).withColumn("id", F.monotonically_increasing_id())
    def ask(events):
        return {r.id: (r.n, r.n_w) for r in ordered.strictly_prior(df, events, ["k"], "t", {"n": F.lit(1)}, width=5, windows={"_w": 30}).collect()}
    base = ask(df)
    for r in df.collect():
        own = [t for k, t, _ in ROWS if k == r.k]
        assert base[r.id] == (sum(t < r.t for t in own), sum(r.t - 30 <= t < r.t for t in own))
    later = spark.createDataFrame([("hot", 10_000, 1)] * 50, "k string, t long, v long")
    assert ask(df.select("k", "t", "v").unionByName(later)) == base


def test_reviews_superseded_and_conflicting(spark):
    reviews = [(f"o{RNG.randint(0, 12)}", RNG.randint(0, 2), RNG.randint(1, 5), RNG.randint(0, 30)) for _ in range(150)]
    reviews = [(o, int(o[1:]) % 3, s, t) for o, _, s, t in reviews]
    queries = [(f"q{i}", s, t) for i, (s, t) in enumerate((s, t) for s in range(3) for t in range(0, 33, 3))]
    got = history.seller_prior_reviews(spark.createDataFrame(queries, "order_id string, seller_id long, as_of_s long"),
                                       spark.createDataFrame(reviews, "order_id string, seller_id long, score long, answered_s long")).collect()
    for r in got:
        clean = bad = total = 0
        for order in {o for o, s, _, _ in reviews if s == r.seller_id}:
            seen = [(t, sc) for o, _, sc, t in reviews if o == order and t < r.as_of_s]
            if seen:
                last = {sc for t, sc in seen if t == max(seen)[0]}
                clean, bad, total = clean + (len(last) == 1), bad + (len(last) > 1), total + (sum(last) if len(last) == 1 else 0)
        assert (r.reviewed, r.ambiguous, r.score_sum) == (clean, bad, total)


def test_roc_auc_counts_ties_half(spark):
    pts = [(RNG.random() < .4, RNG.randint(0, 15)) for _ in range(200)]
    df = spark.createDataFrame(pts, "y boolean, s long")
    pos, neg = [s for y, s in pts if y], [s for y, s in pts if not y]
    want = sum((a > b) + .5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(evaluation.roc_auc(df, [], F.col("y"), "s", width=4).first().roc_auc - want) < 1e-12


def test_tail_score_boundaries(spark):
    cases = [(95, 0.0, "none"), (96, 20.0, "low"), (98, 60.0, "medium"), (99, 80.0, "medium"), (100, 100.0, "high")]
    df = spark.createDataFrame([(c, 1000, 100, 5000) for c, _, _ in cases], "c long, d long, n long, total long")
    score, severity = peers.tail_score(F.col("d"), F.col("c"), F.col("n"), F.col("total"))
    assert [(r.c, r.s, r.v) for r in df.select("c", score.alias("s"), severity.alias("v")).orderBy("c").collect()] == cases


def test_pareto_two_metrics_equals_brute_force(spark):
    pts = list({(i, RNG.randint(0, 20), RNG.randint(0, 20)) for i in range(80)})
    df = spark.createDataFrame(pts, "id long, x long, y long")
    got = {r.id for r in evaluation.pareto_frontier(df, "id", ["x", "y"], width=3).collect()}
    assert got == {i for i, x, y in pts if not any(a >= x and b >= y and (a > x or b > y) for _, a, b in pts)}


def test_unknown_group_keeps_its_quantiles(spark):
    df = spark.createDataFrame([(None, 1), (None, 3), ("a", 5)], "k string, duration_s long")
    got = {r.k: (r.rows, r.median_days) for r in process.duration_summary(df, ["k"], "duration_s", scale=1.0, width=2).collect()}
    assert got == {None: (2, 2.0), "a": (1, 5.0)}


def test_quantiles_sort_only_the_chunks_they_read(spark):
    """With weights as with single rows; chunks without a wanted position are left out before they are sorted."""
    df = spark.createDataFrame([(k, t, 1 + v % 3) for k, t, v in ROWS], "k string, t long, n long")
    whole = ordered.ranks(df, ["k"], "t", weight=F.col("n"), width=10)
    middle = ordered.ranks(df, ["k"], "t", weight=F.col("n"), width=10,
                           wanted=lambda c: (c["n"][0] * 2 <= c["n"][2]) & (c["n"][2] < c["n"][1] * 2))
    assert {tuple(r) for r in middle.collect()} < {tuple(r) for r in whole.collect()}
    assert 5 * middle.count() < whole.count()
    got = {r.k: (r.a, r.b, r.c) for r in ordered.quantiles(df, ["k"], "t", {"a": 0.0, "b": .5, "c": .975}, width=10, weight=F.col("n")).collect()}
    for k in {r[0] for r in ROWS}:
        x = np.repeat([t for kk, t, _ in ROWS if kk == k], [1 + v % 3 for kk, _, v in ROWS if kk == k])
        assert np.allclose(got[k], np.quantile(x, [0, .5, .975]))


def test_history_reads_its_events_once_for_all_windows(spark):
    """One pass for the running sums and one for the rows they are joined to, whatever the number of windows."""
    read = spark.sparkContext.accumulator(0)

    def seen(t):
        read.add(1)
        return t

    df = frame(spark).withColumn("id", F.monotonically_increasing_id()).withColumn("t", F.udf(seen, "long").asNondeterministic()("t"))
    got = ordered.strictly_prior(df, df, ["k"], "t", {"n": F.lit(1), "s": F.col("v")}, {"last": F.col("t")}, width=5, windows={"_a": 30, "_b": 7}).collect()
    assert read.value <= 2 * len(ROWS)
    for r in got:
        own = [(t, v) for k, t, v in ROWS if k == r.k and t < r.t]
        assert (r.n, r.s, r.last) == (len(own), sum(v for _, v in own), max((t for t, _ in own), default=None))
        for suffix, length in (("a", 30), ("b", 7)):
            inside = [v for t, v in own if t >= r.t - length]
            assert (r[f"n_{suffix}"], r[f"s_{suffix}"]) == (len(inside), sum(inside))
