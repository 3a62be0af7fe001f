"""Lattice hashing of vectors: brute force, chunks of large cells, and the cases of its docstring."""

import numpy as np
import pytest

from ordertide.llm import lattice

SCHEMA = "vec_id long, embedding array<double>, label int, key string, size int"


def brute(rows, cosine=0.93):
    def usable(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def linked(x, y):
        if not (usable(x[1], x[2]) and usable(y[1], y[2])) or x[2] != y[2] or len(x[1]) != len(y[1]):
            return False
        a, b = (np.array(v, float) / np.abs(v).max() for v in (x[1], y[1]))
        return a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= cosine

    near = [[j for j in range(len(rows)) if j != i and linked(rows[i], rows[j])] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        reach, todo = {i}, [i]
        while todo:
            todo = [j for k in todo for j in near[k] if j not in reach and not reach.add(j)]
        least = min((rows[j][0] for j in reach if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), least, rows[i][0] == least))
    return sorted(out, key=str)


def result(spark, rows, **more):
    got = lattice.near_vectors(spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA), **more)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def clusters(seed, groups, spread, dims=64):
    rng = np.random.default_rng(seed)
    rows = []
    for size in groups:
        centre = rng.normal(size=dims)
        for _ in range(size):
            rows.append((len(rows), [float(x) for x in centre + rng.normal(size=dims) * spread], int(rng.integers(2))))
    return rows


def test_nearest_points_of_e8():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * 3
    points = lattice.nearest_e8(x) / 2
    assert len({tuple(p) for p in points[0]}) == 4
    for p in points.reshape(-1, 8):  # all integers or all halves, with an even sum
        assert len({v % 1 for v in p}) == 1 and p.sum() % 2 == 0
    steps = [s for s in np.array(np.meshgrid(*[[-1, 0, 1]] * 8)).reshape(8, -1).T if s.sum() % 2 == 0]
    halves = [s for s in np.array(np.meshgrid(*[[-0.5, 0.5]] * 8)).reshape(8, -1).T if s.sum() % 2 == 0]
    for p, at in zip(points[:, 0], x, strict=True):
        own = ((p - at) ** 2).sum()
        assert all(((p + s - at) ** 2).sum() >= own - 1e-9 for s in [*steps, *halves])


def test_a_pair_at_the_threshold_shares_a_cell():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 64))
    z = rng.normal(size=x.shape)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    salt = np.zeros(len(x), np.uint64)
    a, b = lattice.cells(x, salt), lattice.cells(0.93 * x + np.sqrt(1 - 0.93**2) * z, salt)
    met = np.array([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b, strict=True)])
    assert met.mean() >= 0.99
    assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, np.roll(b, 1, axis=0), strict=True)]) < 0.01


@pytest.mark.parametrize("chunk", [1024, 3])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(lattice, "CHUNK", chunk)
    rows = clusters(2, [40, 7, 3, 1, 1, 12, 2], 0.15) + [(i + 100, v, label) for i, v, label in clusters(3, [5, 5], 0.02, dims=3)]
    assert result(spark, rows) == brute(rows)


def test_a_chain_of_links_is_one_component(spark):
    rows = [(9 - k, [float(np.cos(0.3 * k)), float(np.sin(0.3 * k))], 1) for k in range(10)]
    got = result(spark, rows)
    assert got == brute(rows)
    assert {r[2] for r in got} == {0} and max(r[1] for r in got) == 2


def test_defined_cases(spark):
    v = [0.3, -0.2, 0.5, 0.1]
    rows = [(1, v, 1), (1, v, 1), (None, v, 1), (2, v, None), (3, None, 1), (4, [], 1), (5, [0.0] * 4, 1), (6, [None, 1.0, 0.0, 0.0], 1),
            (7, [float("nan"), 1.0, 0.0, 0.0], 1), (8, [float("inf"), 1.0, 0.0, 0.0], 1), (9, v, 2), (10, v[:3], 1), (11, [x * 1e200 for x in v], 1),
            (12, [-x for x in v], 1), (None, [1.0, 0.0, 0.0, 0.0], 3), (13, [-0.0, 0.0, 0.0, 0.0], 1)]
    got = result(spark, rows)
    want = [(i, n, c, i == c) for i, n, c, _ in brute(rows)]
    assert got == sorted(want, key=str)
    assert (1, 3, 1, True) in got and (None, 3, 1, False) in got and (None, 0, None, True) in got
    assert result(spark, []) == []
