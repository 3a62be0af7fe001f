"""Frontiers of three and four metrics, and isolation trees, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordertide.operators import detectors, evaluation


@pytest.mark.parametrize("kind", ["spread", "ties", "anticorrelated"])
def test_skyline_equals_all_pairs(spark, kind):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 5 if kind == "ties" else 1000, size=(400, 3))
    if kind == "anticorrelated":
        x[:, 2] = 2000 - x[:, 0] - x[:, 1]
    df = spark.createDataFrame([(k, *map(int, v)) for k, v in enumerate(x)], "id int, a long, b long, c long").repartition(16)
    got = {r["id"] for r in evaluation.pareto_frontier(df, "id", ["a", "b", "c"]).collect()}
    want = {i for i in range(len(x)) if not ((x >= x[i]).all(axis=1) & (x > x[i]).any(axis=1)).any()}
    assert got == want
    plan = evaluation.pareto_frontier(df, "id", ["a", "b", "c"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_skyline_leaves_unknown_metrics_out(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, None), (2, 1.0, 1.0, 1.0), (3, 1.0, 1.0, 1.0)], "id int, a double, b double, c double")
    assert {r["id"] for r in evaluation.pareto_frontier(df, "id", ["a", "b", "c"]).collect()} == {2, 3}
    assert evaluation.pareto_frontier(df.limit(0), "id", ["a", "b", "c"]).count() == 0


def test_every_fit_row_can_be_drawn(spark):
    """Draws cover the whole set in equal stretches, without replacement."""
    df = spark.range(5000).selectExpr("id * 7 AS order_id", "CAST(id AS DOUBLE) AS a", "'fit' AS role")
    nodes = detectors.isolation_forest_fit(df, ["a"], trees=200, samples=16).toPandas()
    root = nodes[nodes.node == 0]
    assert len(root) == 200 and root.split.max() > 4000 and root.split.min() < 1000
    scores = {r.order_id: r.score for r in detectors.isolation_forest_score(df.withColumn("a", F.col("a") * 3), ["a"], spark.createDataFrame(nodes), 200, 16).collect()}
    assert scores[4999 * 7] > scores[800 * 7]
    leaves = nodes[nodes.feature < 0]
    assert (leaves.groupby("tree").size() <= 16).all()
    with pytest.raises(ValueError):
        detectors.isolation_forest_score(df, ["a"], spark.createDataFrame(nodes), 2, 16)


def test_scores_equal_walking_the_trees(spark):
    rng = np.random.default_rng(8)
    rows = [(k, *map(float, v), "fit" if k < 80 else "new") for k, v in enumerate(rng.normal(size=(120, 2)))]
    df = spark.createDataFrame(rows, "order_id long, a double, b double, role string")
    nodes = detectors.isolation_forest_fit(df.where("role = 'fit'"), ["a", "b"], trees=30, samples=32)
    table = {(r["tree"], r["node"]): r for r in nodes.collect()}
    got = {r["order_id"]: r["score"] for r in detectors.isolation_forest_score(df, ["a", "b"], nodes, 30, 32).collect()}
    for k, a, b, _ in rows:
        total = 0.0
        for tree in range(30):
            at = table[tree, 0]
            while at["feature"] >= 0:
                at = table[tree, at["left"] if (a, b)[at["feature"]] <= at["split"] else at["right"]]
            total += at["depth"]
        c = 2 * (np.log(31) + np.euler_gamma) - 2 * 31 / 32
        assert got[k] == pytest.approx(2 ** (-total / 30 / c), rel=1e-9)


def test_leaves_of_uneven_depth_give_their_own_depth(spark):
    """Rows walk equal numbers of steps: a leaf near the root hands its depth down to both sides."""
    nodes = spark.createDataFrame([(0, 0, 1, 2, 0, 5.0, 0.0), (0, 1, -1, -1, -1, 0.0, 1.25), (0, 2, 5, 6, 1, 2.0, 0.0), (0, 5, -1, -1, -1, 0.0, 2.0),
                                   (0, 6, 13, 14, 0, 9.0, 0.0), (0, 13, -1, -1, -1, 0.0, 3.5), (0, 14, -1, -1, -1, 0.0, 3.0)], detectors.NODE)
    rows = spark.createDataFrame([(1, "r", 5.0, 9.0), (2, "r", 6.0, 2.0), (3, "r", 9.0, 3.0), (4, "r", 9.5, 3.0)], "order_id long, role string, x double, y double")
    norm = float(detectors._average_path(8))
    got = {r.order_id: r.score for r in detectors.isolation_forest_score(rows, ["x", "y"], nodes, trees=1, samples=8).collect()}
    assert got == {i: 2.0 ** (-d / norm) for i, d in [(1, 1.25), (2, 2.0), (3, 3.5), (4, 3.0)]}
