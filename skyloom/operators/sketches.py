"""Mergeable quantile sketches (KLL) by band, time or month, and scaling by their quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels of detail: larger is more exact.
K = 400


def long_bands(obs: DataFrame, bands: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row for each band and value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("v")) for b in bands]))
    return obs.select(*keys, pairs.alias("p")).select(*keys, "p.*")


def sketch(obs: DataFrame, bands: Sequence[str], mode: str = "standard", pixelwise: bool = False, keys: Sequence[str] = ("tile_id", "y", "x"), k: int = K) -> DataFrame:
    """``(…keys, n, sketch)`` of band values; null and NaN are left out.

    Modes: ``standard`` by band; ``timewise`` by band and time; ``monthly`` by band and month
    of the year; ``total`` over everything. ``pixelwise`` adds the pixel; total has no such form.
    """
    by = {"standard": ["band"], "timewise": ["band", "ts"], "monthly": ["band", "month"], "total": []}[mode]
    if pixelwise and mode == "total":
        raise ValueError("the total mode pools all pixels and has no pixelwise form")
    cols = ["ts", F.month("ts").alias("month"), *(keys if pixelwise else [])]
    rows = long_bands(obs.withColumn("month", F.month("ts")), bands, ["ts", "month", *(keys if pixelwise else [])]) if cols else obs
    group = [*(keys if pixelwise else []), *by]
    return rows.where("NOT isnan(v)").groupBy(*group).agg(F.count("v").alias("n"), F.kll_sketch_agg_double("v", k).alias("sketch"))


def merge(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of many tiles as one for each key."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantile(sketch_col: str, q: float):
    return F.kll_sketch_get_quantile_double(F.col(sketch_col), F.lit(float(q)))


def rank(sketch_col: str, value):
    return F.kll_sketch_get_rank_double(F.col(sketch_col), value)
