"""Groups by distance and nearest sources against brute force, on crowded points, with the rows that their steps make."""

from __future__ import annotations

import numpy as np
import pytest

from skyloom.operators import quadtree, sampling
from skyloom.operators.joins import nearest_grid


def groups(points, within):
    parent = list(range(len(points)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(points)):
        d = (points[: i, 0] - points[i, 0]) ** 2 + (points[: i, 1] - points[i, 1]) ** 2
        for j in np.flatnonzero(d <= within * within):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(points))]


def clouds(kind, n, seed=3):
    r = np.random.default_rng(seed)
    if kind == "spread":
        return r.random((n, 2)) * 3000 - 1500
    if kind == "two cells, apart":  # every two points of the two clouds are a little farther than the distance
        left, right = r.random((n // 2, 2)) * [60, 60], r.random((n // 2, 2)) * [60, 60]
        return np.concatenate([left - [60, 0], right + [100.5, 0]])
    if kind == "two cells, one near pair":
        points = clouds("two cells, apart", n, seed)
        points[0], points[-1] = (0, 30), (100, 30)
        return points
    if kind == "copies":
        return np.repeat(r.random((5, 2)) * 300, n // 5, axis=0)
    return np.stack([np.arange(n) * 100.0, np.zeros(n)], axis=1)  # a chain at just the distance


KINDS = ["spread", "two cells, apart", "two cells, one near pair", "copies", "chain"]


@pytest.fixture
def made(monkeypatch):
    """Numbers of rows of the tables that the quadtree writes."""
    rows, real = [], quadtree.stage

    def count(df, name):
        out = real(df, name)
        rows.append((name, out.count()))
        return out

    monkeypatch.setattr(quadtree, "stage", count)
    return rows


@pytest.mark.parametrize("kind", KINDS)
def test_distance_groups(spark, kind):
    points = clouds(kind, 300)
    frame = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)] + [(300, None, 1.0)], "id long, px double, cx double")
    got = {r.id: r.group for r in sampling.distance_groups(frame, "id", "px", "cx", 100.0).collect()}
    assert got == dict(enumerate([*groups(points, 100.0), 300]))


def test_crowded_cells_give_few_pairs(spark, made):
    n = 20_000
    for kind in KINDS[1:3]:
        made.clear()
        points = clouds(kind, n)
        frame = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id long, x double, y double")
        found = {r.group for r in sampling.distance_groups(frame, "id", "x", "y", 100.0).collect()}
        assert len(found) == (1 if "near" in kind else 2)
        assert sum(rows for name, rows in made if name in ("pairs", "open", "near_points")) < n


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nearest_sources(spark, made, seed):
    r = np.random.default_rng(seed)
    dense = r.normal(size=(1500, 2)) * 0.01 + [5, 5]
    there = np.concatenate([dense, dense[:50], np.repeat([[2.0, 2.0]], 40, axis=0), r.random((40, 2)) * 1000, r.integers(0, 9, (60, 2))])
    here = np.concatenate([r.random((100, 2)) * 1000 - 200, r.normal(size=(300, 2)) * 0.02 + [5, 5], r.integers(0, 9, (40, 2)) + 0.5])
    targets = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(here)] + [(-1, None, 1.0)], "id long, x double, y double")
    sources = spark.createDataFrame([(float(a), float(b), j) for j, (a, b) in enumerate(there)] + [(None, 1.0, 9)], "sx double, sy double, best long")
    got = {q.id: q.best for q in nearest_grid(targets, sources, "x", "y", "best", ["id"]).collect()}
    want = {i: min(((a - x) * (a - x) + (b - y) * (b - y), a, b, j) for j, (a, b) in enumerate(there.tolist()))[3] for i, (x, y) in enumerate(here.tolist())}
    assert got == want
    assert sum(rows for name, rows in made if name == "met") < 60 * len(here)
    assert {q.best for q in nearest_grid(targets, sources.limit(0), "x", "y", "best", ["id"]).collect()} == {None}
    assert nearest_grid(targets.limit(0), sources, "x", "y", "best", ["id"]).collect() == []
