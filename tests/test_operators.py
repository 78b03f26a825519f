"""Operators on small literal inputs with known results, and NumPy against Spark."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyloom.functions import algebra as A
from skyloom.operators import aggregates as G
from skyloom.operators import graph, models, sampling, sketches, spatial
from skyloom.operators import timeseries as T

DAY0 = dt.datetime(2018, 3, 1)


def series(spark, values, valid=None):
    rows = [(1, 0, 0, DAY0 + dt.timedelta(days=i), v, True if valid is None else i not in valid) for i, v in enumerate(values)]
    return T.frame_numbers(spark.createDataFrame(rows, "tile_id long, y long, x long, ts timestamp_ntz, v double, ok boolean"))


def test_extremes_and_slopes_of_a_wave(spark):
    wave = [2.0, 5.0, 4.0, -1.0, 0.0, 7.0, 6.5, 6.0]
    plain, masked = series(spark, wave), series(spark, wave, {3, 5})
    first = lambda df: df.select("argmax", "argmin").first()
    assert tuple(first(T.extreme_times(plain, "v", "ok"))) == (5, 3) and tuple(first(T.extreme_times(masked, "v", "ok"))) == (6, 4)
    # central differences by hand: 1, -3, -2, 4, 3.25, -0.5 at 1 to 6; without 3 and 5: 1, -5/3, 2.5/4, 3 at 1, 2, 4, 6
    assert tuple(first(T.slope_times(plain, "v", "ok"))) == (4, 2) and tuple(first(T.slope_times(masked, "v", "ok"))) == (6, 2)


def test_nothing_valid_has_index_zero(spark):
    assert tuple(T.extreme_times(series(spark, [1.0, 2.0], {0, 1}), "v", "ok").select("argmax", "argmin").first()) == (0, 0)


@pytest.mark.parametrize("ops,want", [("f", [None, 1, 1, 2]), ("b", [1, 1, 2, 2]), ("fb", [1, 1, 1, 2]), ("bf", [1, 1, 2, 2])])
def test_fill_orders(spark, ops, want):
    got = T.fill(series(spark, [None, 1.0, None, 2.0]), "v", ops).orderBy("ts").collect()
    assert [r.v for r in got] == want
    sentinel = T.fill(series(spark, [-9.0, 1.0, -9.0, 2.0]), "v", ops, sentinel=-9.0).orderBy("ts").collect()
    assert [r.v for r in sentinel] == want
    with pytest.raises(ValueError):
        T.fill(series(spark, [1.0]), "v", "fx")


def test_class_frequency(spark):
    df = spark.createDataFrame([(1, c) for c in (0, 0)] + [(2, c) for c in (2, 2, 0)], "p int, c int")
    got = {r.p: r for r in df.groupBy("p").agg(*G.class_frequency("c", [1, 2])).collect()}
    assert got[1].freq_2 is None and got[2].freq_2 == 1 and got[2].freq_1 == 0


def test_norm_and_linear_map(spark):
    df = spark.createDataFrame([([1.0, 1.0, 1.0, 0.0, 1.0, 0.0, 1.0],)], "b array<double>")
    row = df.select(A.array_norm("b", [0, 1, 2, 4, 6]).alias("n"), A.linear(F.lit(4), 2, -5).alias("l"), A.linear(F.lit(1), 2, -5).alias("m"), A.linear(F.lit(300), 1, 0, "tinyint").alias("o")).first()
    assert row.n == pytest.approx(5**0.5) and row.l == 3 and row.m == -3 and row.o is None


def test_folds_are_alike_across_tiles_and_bins_are_checked(spark):
    df = spark.range(4000).selectExpr("id", "id % 7 AS cls", "id % 40 AS tile_id")
    folds = sampling.split_folds(df, [0.2, 0.6], ["cls"]).groupBy("cls").agg(F.count_distinct("fold").alias("n"))
    assert folds.where("n > 1").count() == 0
    share = sampling.split_folds(df, [0.2, 0.6], ["id"]).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] / 4000 for r in share] == pytest.approx([0.2, 0.4, 0.4], abs=0.05)
    for bins in ([1.5], [0.6, 0.2], [0.0]):
        with pytest.raises(ValueError):
            sampling.check_bins(bins)


def test_context_window_stays_inside_and_holds_its_middle(spark):
    for n in (1, 4, 9, 20):
        for size in (1, 3, 6, 15):
            lo, past = T.context_bounds(F.col("id"), F.lit(n), size)
            for r in spark.range(n).select("id", lo.alias("lo"), past.alias("past")).collect():
                assert r.past - r.lo == min(n, size) and 0 <= r.lo <= r.id < r.past <= n
                assert n < size or r.lo == max(0, min(r.id - size // 2, n - size))


def test_sketch_modes(spark):
    df = spark.range(2000).selectExpr("id % 4 AS tile_id", "id % 5 AS y", "0 AS x", "timestamp_ntz'2020-01-01' AS ts", "cast(id as double) AS a", "CASE WHEN id % 2 = 0 THEN double('NaN') ELSE id END AS b")
    got = {r.band: r for r in sketches.sketch(df, ["a", "b"]).select("band", "n", sketches.quantile("sketch", 0.5).alias("m")).collect()}
    assert got["a"].n == 2000 and got["b"].n == 1000 and got["a"].m == pytest.approx(1000, abs=40)
    with pytest.raises(ValueError):
        sketches.sketch(df, ["a"], "total", pixelwise=True)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=25))
def test_components_against_union_find(spark, edges):
    parent = list(range(26))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {n: root(n) for e in edges for n in e}


def test_components_of_a_long_path(spark):
    path = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    got = graph.connected_components(path, "a", "b")
    assert got.where("component <> 0").count() == 0 and got.count() == 301


def tiles(spark, *images):
    return spark.createDataFrame([(k, y, x, float(v)) for k, im in enumerate(images) for y, row in enumerate(im) for x, v in enumerate(row)], "tile_id long, y long, x long, v double")


def test_large_components_of_two_tiles(spark):
    image = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 1], [1, 0, 0, 0]])
    rows = tiles(spark, image, np.ones((4, 4))).withColumn("m", F.col("v") > 0)
    for more_than, want in ((2, 3), (1, 5), (0, 6)):
        got = spatial.large_components(rows, "m", more_than, 4, 4).groupBy("tile_id").agg(F.count_if("large").alias("n")).collect()
        assert {r.tile_id: r.n for r in got} == {0: want, 1: 16}


def test_binary_pattern_and_texture_of_simple_images(spark):
    spot = np.zeros((5, 5))
    spot[2, 2] = 1
    got = {(r.tile_id, r.y, r.x): r.lbp for r in spatial.local_binary_pattern(tiles(spark, np.ones((5, 5)), spot), "v", 5, 5).collect()}
    # no point round the spot reaches it; beside it one does, which for a flat centre are all
    assert got[0, 2, 2] == got[1, 0, 0] == 8 and got[1, 2, 2] == 0 and got[1, 2, 1] == 8
    stripes = np.array([[0, 1, 0, 1]] * 4)
    cells = spatial.cooccurrence(spatial.grey_levels(tiles(spark, np.ones((4, 4)), stripes), "v", 4), "level", 4, 4)
    flat, striped = (spatial.texture_measures(cells).where(f"tile_id = {k} AND y = 1 AND x = 1").first() for k in (0, 1))
    assert flat.contrast == flat.entropy == 0 and flat.asm == flat.correlation == 1 and flat.sum_average == 2
    # levels 1 and 3 alternate: each pair is (1, 3) or (3, 1)
    assert striped.contrast == 4 and striped.asm == 0.5 and striped.correlation == -1 and striped.sum_average == 4 and striped.difference_variance == 0
    assert striped.entropy == pytest.approx(math.log(2)) and striped.homogeneity == pytest.approx(0.2)


def test_similarity_of_frames_to_their_target(spark):
    r = np.random.default_rng(3)
    image, other = r.random((8, 8)), r.random((8, 8))
    rows = tiles(spark, image, image, other).withColumn("p", F.lit(1))
    got = spatial.structural_similarity(rows.where("tile_id > 0"), rows.where("tile_id = 0"), "v", 8, 8, ["p"], "tile_id").collect()
    w = np.array(spatial.gaussian(1.5))

    def mean(im):
        for axis in (0, 1):
            padded = np.pad(im, [(6, 6) if k == axis else (0, 0) for k in (0, 1)], mode="symmetric")
            im = sum(c * np.take(padded, range(i, i + 8), axis=axis) for i, c in enumerate(w))
        return im

    a, b = mean(image), mean(other)
    like = (2 * a * b + 1e-6) * (2 * (mean(image * other) - a * b) + 1e-5) / ((a * a + b * b + 1e-6) * (mean(image**2) - a * a + mean(other**2) - b * b + 1e-5))
    assert len(got) == 64
    for q in got:
        assert q.ssim_max == pytest.approx(1) and q.ssim_mean == pytest.approx((1 + like[q.y, q.x]) / 2) and q.ssim_std == pytest.approx((1 - like[q.y, q.x]) / 2)


def test_disk_dilation_against_numpy(spark):
    r = np.random.default_rng(1)
    mask = r.random((9, 9)) < 0.15
    rows = spark.createDataFrame([(1, y, x, bool(mask[y, x])) for y in range(9) for x in range(9)], "tile_id long, y long, x long, m boolean")
    got = np.zeros((9, 9), bool)
    for q in spatial.dilate(rows, "m", 3).collect():
        got[q.y, q.x] = q.dilated
    want = np.array([[any(mask[y + dy, x + dx] for dy, dx in spatial.disk(3) if 0 <= y + dy < 9 and 0 <= x + dx < 9) for x in range(9)] for y in range(9)])
    assert (got == want).all()


def spline_by_solving(t, v, at):
    """The natural cubic spline, from its system of equations."""
    n, h = len(t), np.diff(t)
    second = np.zeros(n)
    if n > 2:
        system = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
        second[1:-1] = np.linalg.solve(system, 6 * np.diff(np.diff(v) / h))
    i = np.clip(np.searchsorted(t, at, side="right") - 1, 0, n - 2)
    left, right = (t[i + 1] - at) / h[i], (at - t[i]) / h[i]
    return left * v[i] + right * v[i + 1] + ((left**3 - left) * second[i] + (right**3 - right) * second[i + 1]) * h[i] ** 2 / 6


def test_spline_against_a_solver(spark):
    r = np.random.default_rng(8)
    rows, want = [], {}
    for k, n in enumerate((1, 2, 3, 9, 25)):
        t = np.sort(r.choice(60, n, replace=False)).astype(float)
        v = r.normal(size=n)
        rows += [(k, DAY0 + dt.timedelta(days=int(a)), float(b) + d) for a, b in zip(t, v) for d in (-1.0, 1.0)] + [(k, DAY0, None)]
        at = np.arange(t[0], t[-1] + 1, 3)
        want |= {(k, int(a - t[0])): b for a, b in zip(at, spline_by_solving(t, v, at) if n > 1 else [None])}
    got = models.spline_resample(spark.createDataFrame(rows, "k long, ts timestamp_ntz, v double"), "k", "ts", "v", 3).collect()
    first = {k: min(q.day for q in got if q.k == k) for k in range(5)}
    assert len(got) == len(want)
    for q in got:
        w = want[q.k, q.day - first[q.k]]
        assert q.v is None if w is None else q.v == pytest.approx(w)


def test_logistic_fit_finds_the_curve(spark):
    at = [i / 59 for i in range(60)]
    truth = (0.2, 0.6, 0.45, 0.25, 4.0, 0.2, 5.0)
    curve = models.doubly_logistic_column(F.col("x"), [F.lit(c) for c in truth])
    points = spark.createDataFrame([(7, DAY0 + dt.timedelta(hours=i), x) for i, x in enumerate(at)], "k long, ts timestamp_ntz, x double").withColumn("v", curve)
    few = points.limit(5).withColumn("k", F.lit(8).cast("long"))
    got = {r.k: r for r in models.doubly_logistic_fit(points.unionByName(few), "k", "ts", "v").collect()}
    assert got[8].c1 is None
    fit = points.withColumn("f", models.doubly_logistic_column(F.col("x"), [F.lit(got[7][c]) for c in models.PARAMETERS]))
    assert fit.agg(F.max(F.abs(F.col("f") - F.col("v")))).first()[0] < 0.02


def test_ranks_and_quantiles_over_slices(spark):
    r = np.random.default_rng(4)
    values = r.normal(size=1500).tolist()
    df = spark.createDataFrame([(i, "a" if i % 3 else None, v) for i, v in enumerate(values)], "id long, c string, v double")
    got = sampling.ranked(df, ["c"], ["v", "id"], "place", 7).collect()
    for c in ("a", None):
        own = sorted((q for q in got if q.c == c), key=lambda q: q.v)
        assert [q.place for q in own] == list(range(len(own))) and {q.place_of for q in own} == {len(own)}
    assert sampling.exact_quantiles(df, "v", [0, 0.37, 0.5, 1]).first().q == pytest.approx(np.quantile(values, [0, 0.37, 0.5, 1]).tolist())


def test_groups_of_points_against_union_find(spark):
    from skyloom.plans.q_joins import points
    from skyloom.plans.queries import QUERIES

    rows = points(spark, "/root/testdata/sf0.001").collect()
    parent = {q.id: q.id for q in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in rows:
        for b in rows:
            if a.id < b.id and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 300 * 300:
                p, q = root(a.id), root(b.id)
                parent[max(p, q)] = min(p, q)
    got = QUERIES["g16_leak_free_groups"](spark, "/root/testdata/sf0.001").collect()
    assert {q.id: q.grp for q in got} == {q.id: root(q.id) for q in rows}


def test_asof_and_nearest_look_far(spark):
    from skyloom.operators import joins

    left = spark.createDataFrame([(1, 1, DAY0 + dt.timedelta(days=d)) for d in (-5, 0, 40, 400)] + [(2, 2, DAY0)], "id long, k long, ts timestamp_ntz")
    right = spark.createDataFrame([(1, DAY0, 10), (1, DAY0, 11), (1, DAY0 + dt.timedelta(days=39), 12)], "k long, at timestamp_ntz, v long")
    got = sorted((q.id, q.ts, q.v) for q in joins.asof_join(left, right, ["k"], "ts", "at", ["v"], "v").collect())
    assert [q[2] for q in got] == [None, 11, 12, 12, None]
    r = np.random.default_rng(5)
    here, there = r.random((80, 2)) * 9000, np.concatenate([r.random((6, 2)) * 300, [[8900.0, 20.0]]])
    targets = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(here)], "id long, x double, y double")
    sources = spark.createDataFrame([(float(a), float(b), j) for j, (a, b) in enumerate(there)], "sx double, sy double, near long")
    found = {q.id: q.near for q in joins.nearest_grid(targets, sources, "x", "y", "near", ["id"]).collect()}
    assert found == {i: int(np.argmin(((there - p) ** 2).sum(axis=1))) for i, p in enumerate(here)}


def test_staged_tables_are_dropped(spark):
    from skyloom.plans import staging

    staging.drop_staged(spark)
    kept = staging.stage(spark.range(5), "five")
    assert kept.count() == 5 and staging.drop_staged(spark) == 1 and staging.drop_staged(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(*kept.inputFiles()).count()


def test_tree_and_labels(spark):
    node = {"split_feature": 0, "decision_type": "<=", "threshold": 1.0, "left_child": {"leaf_value": 2}, "right_child": {"leaf_value": -2}}
    row = spark.range(1).select(A.tree_ensemble([node, node], [F.lit(0.5)]).alias("p"), A.map_labels(F.lit(3), {1: 5, 3: 7}).alias("m"), A.ndi(F.lit(1.0), F.lit(-1.0)).alias("z")).first()
    assert row.p == pytest.approx(1 / (1 + math.exp(-4))) and row.m == 7 and row.z is None


def test_entry_imports_without_the_corpus_package(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.reload(importlib.import_module("__spark_entry__"))
    assert entry.llm is None and "pipeline" not in entry.queries() and entry.queries()
    monkeypatch.undo()
    importlib.reload(entry)
