"""Nearest neighbours and local outlier factors against brute force, with copies, far points and several levels of boxes."""

import numpy as np
import pyarrow as pa
import pytest

from ordertide.operators import neighbours


def brute_factors(fit, new, k):
    """Plain local outlier factors in novelty use; copies are points of their own."""
    def near(x, leave=None):
        d = np.sqrt(((fit - x) ** 2).sum(axis=1))
        if leave is not None:
            d[leave] = np.inf
        order = np.argsort(d, kind="stable")[:k]
        return order, d[order]

    found = [near(x, i) for i, x in enumerate(fit)]
    reach = np.array([d[-1] for _, d in found])
    density = np.array([1 / (np.maximum(d, reach[o]).mean() + 1e-10) for o, d in found])
    out = []
    for x in new:
        o, d = near(x)
        out.append(density[o].mean() * (np.maximum(d, reach[o]).mean() + 1e-10))
    return np.array(out)


def frames(spark, fit, new, names):
    schema = "order_id long, " + ", ".join(f"{n} double" for n in names)
    rows = lambda x, start: [(start + i, *map(float, v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows(fit, 0), schema).repartition(4), spark.createDataFrame(rows(new, 10_000), schema).repartition(3)


@pytest.mark.parametrize("block, fan", [(512, 32), (8, 2)])
def test_factors_equal_brute_force(spark, monkeypatch, block, fan):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "FAN", fan)
    monkeypatch.setattr(neighbours, "QUERIES", 50)
    rng = np.random.default_rng(0)
    fit = np.concatenate([rng.normal(size=(300, 3)), rng.normal(size=(80, 3)) * 0.01 + 5, np.repeat(rng.normal(size=(4, 3)), 3, axis=0), [[40.0, 0, 0]]])
    new = np.concatenate([rng.normal(size=(60, 3)) * 2, fit[:20], fit[-8:], [[100.0, 100, 100], [5, 5, 5]], np.repeat([[0.1, 0.2, 0.3]], 70, axis=0)])
    a, b = frames(spark, fit, new, ["u", "v", "w"])
    got = {(r["order_id"], r["neighbours"]): r["score"] for r in neighbours.local_outlier_factors(a, b, ["u", "v", "w"], [5, 20]).collect()}
    assert len(got) == 2 * len(new)
    for k in (5, 20):
        np.testing.assert_allclose([got[10_000 + i, k] for i in range(len(new))], brute_factors(fit, new, k), rtol=1e-9)


def test_a_third_of_the_fit_rows_are_one_point(spark):
    rng = np.random.default_rng(1)
    fit = np.concatenate([rng.normal(size=(120, 2)), np.zeros((60, 2))])
    new = np.concatenate([rng.normal(size=(10, 2)), [[0.0, 0.0], [1e-3, 0.0]]])
    a, b = frames(spark, fit, new, ["u", "v"])
    got = {r["order_id"]: r["score"] for r in neighbours.local_outlier_factors(a, b, ["u", "v"], [20]).collect()}
    np.testing.assert_allclose([got[10_000 + i] for i in range(len(new))], brute_factors(fit, new, 20), rtol=1e-6)


def test_neighbours_and_missing_cases(spark):
    rng = np.random.default_rng(2)
    fit, new = rng.normal(size=(90, 2)), rng.normal(size=(30, 2))
    a, b = frames(spark, fit, new, ["u", "v"])
    index = neighbours.Index(a.selectExpr("order_id AS point", "u", "v", "1L AS copies"), ["u", "v"])
    got = {}
    for r in neighbours.nearest(b.withColumnRenamed("order_id", "query"), index, 7).collect():
        got.setdefault(r["query"], []).append((r["distance"], r["point"]))
    for i, x in enumerate(new):
        d = np.sqrt(((fit - x) ** 2).sum(axis=1))
        assert [p for _, p in sorted(got[10_000 + i])] == np.argsort(d)[:7].tolist()
    few = neighbours.local_outlier_factors(a.limit(5), b, ["u", "v"], [5])
    assert few.count() == 0  # no fit row has five others
    empty = neighbours.local_outlier_factors(a.limit(0), b, ["u", "v"], [5])
    assert empty.count() == 0
    gap = b.selectExpr("order_id", "u", "IF(order_id = 10000, NULL, v) AS v")
    assert neighbours.local_outlier_factors(a, gap, ["u", "v"], [5]).count() == 29


def test_search_keeps_no_row_per_query_and_block(spark, monkeypatch):
    """What the search writes on its way grows with runs of queries, not with queries times blocks; ties go by the smallest id."""
    written = {}

    def count(df, name):
        out = materialize(df, name)
        written[name] = out.count()
        return out

    materialize = neighbours.materialize
    monkeypatch.setattr(neighbours, "materialize", count)
    side = np.arange(14.0)
    grid = np.stack(np.meshgrid(side, side, side), axis=-1).reshape(-1, 3)  # equal distances everywhere
    a, _ = frames(spark, grid, grid[:1], ["u", "v", "w"])
    index = neighbours.Index(a.selectExpr("order_id AS point", "u", "v", "w", "1 + order_id % 3 AS copies"), ["u", "v", "w"])
    got = {}
    for r in neighbours.nearest(a.withColumnRenamed("order_id", "query"), index, 9).collect():
        got.setdefault(r["query"], []).append((r["before"], r["point"], r["copies"]))
    assert max(written[n] for n in written if n not in ("blocks", "boxes")) < len(grid)
    for i in range(0, len(grid), 97):
        d = ((grid - grid[i]) ** 2).sum(axis=1)
        want, before = [], 0
        for p in np.lexsort((np.arange(len(grid)), d)):
            if before >= 9:
                break
            want.append((before, int(p), 1 + int(p) % 3))
            before += 1 + int(p) % 3
        assert sorted(got[i]) == want


def test_factors_write_no_row_per_neighbour(spark, monkeypatch):
    """What is known of a point travels with its block: no table has more rows than there are fit rows."""
    written = {}

    def count(df, name):
        out = materialize(df, name)
        written[name] = out.count()
        return out

    materialize = neighbours.materialize
    monkeypatch.setattr(neighbours, "materialize", count)
    rng = np.random.default_rng(3)
    fit, new = rng.normal(size=(400, 3)), rng.normal(size=(150, 3))
    a, b = frames(spark, fit, new, ["u", "v", "w"])
    got = {r["order_id"]: r["score"] for r in neighbours.local_outlier_factors(a, b, ["u", "v", "w"], [20]).collect()}
    assert max(written.values()) <= len(fit)
    np.testing.assert_allclose([got[10_000 + i] for i in range(len(new))], brute_factors(fit, new, 20), rtol=1e-9)


def test_a_tile_with_more_blocks_than_are_held(monkeypatch):
    """Points that no query holds any more are left between the parts of a tile; the values of the others stay with them."""
    monkeypatch.setattr(neighbours, "HELD", 2)
    rng = np.random.default_rng(4)
    fit, new = rng.normal(size=(90, 2)), rng.normal(size=(12, 2))
    pack = lambda run, block, ids, x: {"tile": 1, "run": run, "block": block, "points": ids.tobytes(), "copies": np.ones_like(ids).tobytes(),
                                       "x": x.T.copy().tobytes(), "known": (ids * 10.0).tobytes()}
    rows = [pack(k, False, np.arange(6) + 1000 + 6 * k, new[6 * k:6 * k + 6]) for k in range(2)]
    rows += [pack(k, True, np.arange(10 * k, 10 * k + 10), fit[10 * k:10 * k + 10]) for k in range(9)]
    (tile, runs), = neighbours._searched(4, 2, 1, iter([pa.RecordBatch.from_pylist(rows)]))
    assert len(tile.ids) < len(fit)
    for run, own in zip(runs, (new[:6], new[6:]), strict=True):
        want = np.argsort(((own[:, None] - fit) ** 2).sum(axis=2), axis=1)[:, :4]
        np.testing.assert_array_equal(tile.ids[run.slot], want)
        np.testing.assert_array_equal(tile.values[0, run.slot], want * 10.0)
