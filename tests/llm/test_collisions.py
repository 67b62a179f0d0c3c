"""Near-duplicate vectors against all pairs."""

import math

import numpy as np
import pytest

from basketry.functions.workspace import Workspace
from basketry.llm import collisions

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, threshold=0.98):
    n = len(rows)
    vectors = [None if v is None or None in v else np.array(v, np.float64) for _, v, _ in rows]
    usable = [v is not None and len(v) > 0 and np.isfinite(v).all() and v.any() and rows[i][2] is not None for i, v in enumerate(vectors)]
    links, parent = [0] * n, list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(vectors[i]) == len(vectors[j]):
                x, y = vectors[i], vectors[j]
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    least = {}
    for i in range(n):
        key = rows[i][0]
        held = least.get(root(i))
        least[root(i)] = key if held is None else held if key is None else min(held, key)
    out = [(rows[i][0], links[i], least[root(i)], rows[i][0] == least[root(i)]) for i in range(n)]
    return sorted(out, key=str)


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    with Workspace(spark) as work:
        return sorted((tuple(r) for r in collisions.near_vectors(df, work, **kw).collect()), key=str)


def vectors(seed, n=500, length=32, labels=3, families=20, hot=0):
    r = np.random.default_rng(seed)
    bases = r.standard_normal((families, length))
    rows = []
    for i in range(n):
        if i < hot:
            v = bases[0] + r.standard_normal(length) * 0.05
        elif r.random() < 0.5:
            v = bases[r.integers(families)] + r.standard_normal(length) * r.choice([0.0, 0.02, 0.1, 0.18, 0.25])
        else:
            v = r.standard_normal(length)
        rows.append((i, [float(np.float32(x)) for x in v * r.choice([1.0, 3.0])], int(r.integers(labels)) if i >= hot else 0))
    return rows


@pytest.mark.parametrize("seed,kw", [(1, {}), (2, {"block": 40}), (3, {"block": 16, "spill": 4.5})])
def test_equal_to_all_pairs(spark, seed, kw):
    rows = vectors(seed)
    assert found(spark, rows, **kw) == plain(rows)


def test_one_large_group_of_versions(spark):
    rows = vectors(4, n=420, hot=200)
    assert found(spark, rows, block=50) == plain(rows)


def test_windows_keep_what_the_calibration_says():
    r = np.random.default_rng(5)
    least = collisions.calibrate(24, 2.0, 0.99999)
    x = collisions.unit(r.standard_normal((4000, 64)))
    side = r.standard_normal((4000, 64))
    side = collisions.unit(side - (side * x).sum(1, keepdims=True) * x)
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * side
    width = 2.0 * collisions.distance(0.98)
    kept = 0
    for seed in range(20):
        d = collisions.directions(64, 24, seed)
        kept += ((np.abs(x @ d - y @ d) <= width).sum(1) >= least).sum()
    assert kept >= 0.9999 * 20 * 4000
    d = collisions.directions(64, 24, 1)
    pairs = collisions.passing(x[:300] @ d, np.concatenate([y[:300], x[300:900]]) @ d, width, least)
    met = {(i, j) for i, j in pairs.T.tolist()}
    assert sum((i, i) in met for i in range(300)) >= 299
    assert len(met) < 300 + 0.001 * 300 * 900
    counted = (np.abs((x[:300] @ d)[:, None, :] - (np.concatenate([y[:300], x[300:900]]) @ d)[None]) <= width).sum(2) >= least
    assert met == set(zip(*(a.tolist() for a in np.nonzero(counted)), strict=True))


def test_a_pair_belongs_to_one_leaf():
    r = np.random.default_rng(6)
    p = r.standard_normal((3000, 8))
    tree = collisions.Tree(p, 100, 0.2)
    owners, together = {}, 0
    for leaf, rows, lower in tree.route(p[:200]):
        for i, a in enumerate(rows):
            for j in range(i):
                if lower[i] & lower[j] == 0:
                    owners.setdefault((rows[j], a), []).append(leaf)
        together += len(rows)
    assert len(tree.axis) > 10 and together > 200
    assert all(len(v) == 1 for v in owners.values())
    close = {(i, j) for j in range(200) for i in range(j) if np.abs(p[i] - p[j]).max() <= 0.4}
    assert close <= {(min(k), max(k)) for k in owners}


def test_odd_rows(spark):
    unit = [1.0, 0.0, 0.0]
    rows = [(1, unit, 1), (1, unit, 1), (None, unit, 1), (2, [2.0, 0.0, 0.0], 1), (3, unit, None), (4, None, 1), (5, [], 1), (6, [0.0] * 3, 1)]
    rows += [(7, [1.0, None, 0.0], 1), (8, [float("nan"), 1.0, 0.0], 1), (9, [float("inf"), 1.0, 0.0], 1), (10, unit, 2), (11, [1.0, 0.0], 1)]
    rows += [(12, [1.0, 0.01, -0.0], 1), (13, [3e38, 0.0, 0.0], 2), (14, [1e-40, 0.0, 0.0], 2)]
    got = found(spark, rows)
    expected = plain([(k, v and [None if x is None else x for x in v], y) for k, v, y in rows])
    assert got == [(k, n, c, k == c) for k, n, c, _ in expected]
    empty = spark.createDataFrame([], SCHEMA + ", node binary, cell int, id int, vector int")
    with Workspace(spark) as work:
        assert collisions.near_vectors(empty, work).count() == 0
    clash = spark.createDataFrame([(*r, b"x", 1, 2, 3) for r in rows], empty.schema)
    with Workspace(spark) as work:
        assert sorted((tuple(r) for r in collisions.near_vectors(clash, work).collect()), key=str) == got
