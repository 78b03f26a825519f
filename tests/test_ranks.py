"""Ranks and quantiles of columns where one value holds half of the rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import sampling

N = 8000


def hot(spark):
    return spark.range(N).select("id", F.when(F.col("id") % 2 == 0, 7.0).otherwise((F.col("id") % 50).cast("double")).alias("v"), F.lit(1).alias("k"))


@pytest.mark.parametrize("qs", [[0.0, 0.01, 0.5, 0.99, 1.0], [0.123, 0.7777]])
def test_quantiles_of_weighted_values(spark, qs):
    values = np.where(np.arange(N) % 2 == 0, 7.0, np.arange(N) % 50)
    frame = hot(spark).unionByName(spark.createDataFrame([(-1, None, 1)], "id long, v double, k int"))
    (got,) = sampling.exact_quantiles(frame, "v", qs).collect()
    assert got.q == pytest.approx(np.quantile(values, qs).tolist())
    assert sampling.exact_quantiles(frame.limit(0), "v", qs).first().q == [None] * len(qs)
    places = sampling.value_places(frame, "v", 7).collect()
    assert len(places) == 25 + (7.0 not in range(1, 50, 2)) and sum(r.n for r in places) == N
    order = np.sort(values)
    assert all(order[r.start] == order[r.start + r.n - 1] == r.value and r.total == N for r in places)


def test_rows_of_one_value_are_spread(spark, monkeypatch):
    held, real = [], sampling.stage

    def keep(df, name):
        out = real(df, name)
        held.append((name, out))
        return out

    monkeypatch.setattr(sampling, "stage", keep)
    got = sampling.ranked(hot(spark), ["k"], ["v"], "p", 8)
    rows = got.select("v", "p", "p_of").collect()
    assert sorted(r.p for r in rows) == list(range(N)) and {r.p_of for r in rows} == {N}
    ordered = [r.v for r in sorted(rows, key=lambda r: r.p)]
    assert ordered == sorted(ordered)
    sizes = sorted(r["count"] for r in held[0][1].groupBy("__slice").count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
