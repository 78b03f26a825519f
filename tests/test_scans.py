"""Two-level scans, thinning and ordered reductions against plain Python, with one key of most rows cut to many slices."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from skyloom.operators import scans
from skyloom.operators.timeseries import thin


def series(seed, n=400):
    """One key with most rows, one null key, times with ties broken by ``i``."""
    r = random.Random(seed)
    return [(r.choice([1, 1, 1, 1, 2, None]), r.randint(0, 150), i, r.choice([None, None, float(r.randint(0, 9))])) for i in range(n)]


def by_key(rows):
    out = {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(k, []).append((t, i, v))
    return out


@pytest.mark.parametrize("seed,slices", [(1, 1), (2, 12)])
def test_known_and_rolling(spark, seed, slices):
    rows = series(seed)
    frame = spark.createDataFrame(rows, "k long, t long, i long, v double")
    cut = scans.sliced(frame, ["k"], ["t", "i"], slices)
    assert cut.where("k = 1").select("__slice").distinct().count() > slices // 3
    got = scans.known(scans.known(cut, "v", ["k"], ["t", "i"], "f"), "v", ["k"], ["t", "i"], "b", backward=True)
    got = {r.i: (r.f, r.b) for r in got.collect()}
    rolled = {r.i: r.s for r in scans.rolling(frame, ["k"], ["t", "i"], 3, "s", F.sum("v"), F.count("v"), chunk=5, slices=slices).collect()}
    assert len(got) == len(rolled) == len(rows)
    for own in by_key(rows).values():
        for at, (_, i, _) in enumerate(own):
            f = next((v for _, _, v in reversed(own[: at + 1]) if v is not None), None)
            b = next((v for _, _, v in own[at:] if v is not None), None)
            assert got[i] == (f, b)
            last = [v for _, _, v in own[max(0, at - 2) : at + 1]]
            want = None if len(last) < 3 else (sum(v for v in last if v is not None) if any(v is not None for v in last) else None, sum(v is not None for v in last))
            assert (None if rolled[i] is None else tuple(rolled[i])) == want


@pytest.mark.parametrize("slices", [1, 9])
def test_runs(spark, slices):
    r = random.Random(4)
    days = sorted({(r.choice([1, 1, 2, None]), r.randint(0, 90)) for _ in range(150)}, key=repr)
    got = {(x.k, x["first"], x.n) for x in scans.runs(spark.createDataFrame(days, "k long, d long"), ["k"], "d", slices).collect()}
    want = set()
    for k in {k for k, _ in days}:
        own = sorted(d for q, d in days if q == k)
        for _, g in itertools.groupby(enumerate(own), lambda p: p[1] - p[0]):
            g = [d for _, d in g]
            want.add((k, g[0], len(g)))
    assert got == want


@pytest.mark.parametrize("reverse,most", [(False, None), (True, 4)])
def test_thinning(spark, reverse, most):
    rows = [(k, t) for k, t, _, _ in series(5, 600) if k is not None]
    frame = spark.createDataFrame(rows, "k long, t long").select("k", F.timestamp_seconds("t").alias("ts"))
    got = thin(frame, ["k"], "ts", 3, reverse, most).select("k", F.unix_timestamp("ts").alias("t"), *(["enough"] if most else [])).collect()
    want = set()
    for k in {k for k, _ in rows}:
        kept = []
        for t in sorted({t for q, t in rows if q == k}, reverse=reverse):
            if not kept or abs(t - kept[-1]) > 3:
                kept.append(t)
        want |= {(k, t, len(kept) >= most) if most else (k, t) for t in kept[:most]}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_thinning_of_one_long_key(spark):
    n = 20_000
    frame = spark.range(n).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 2).alias("ts"))
    got = thin(frame, ["k"], "ts", 5).agg(F.count("*"), F.min("ts"), F.max(F.unix_timestamp("ts"))).first()
    assert got[0] == -(-n // 3) and got[2] == (n - 1) // 3 * 3 * 2


@pytest.mark.parametrize("chunk,slices", [(7, 12), (4096, 1)])
def test_reducer_that_does_not_commute(spark, chunk, slices):
    rows = series(6, 150)
    frame = spark.createDataFrame(rows, "k long, t long, i long, v double").select("k", "t", "i", F.col("i").cast("string").alias("text"), F.lit(1).cast("long").alias("n"))
    got = scans.reduce_ordered(frame, ["k"], ["t", "i"], ["text", "n"], lambda a, b: (a[0] + "," + b[0], a[1] + b[1]), chunk, slices)
    want = {(k, ",".join(str(i) for _, i, _ in own), len(own)) for k, own in by_key(rows).items()}
    assert {(None if r.k is None or r.k != r.k else int(r.k), r.text, r.n) for r in got.collect()} == want
    assert scans.reduce_ordered(frame.limit(0), ["k"], ["t", "i"], ["text", "n"], lambda a, b: a).collect() == []
