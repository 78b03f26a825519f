"""Joins of observations with dimensions, intervals, events and points.

A range condition always comes with an equi key, a bucket of time or space, so that no join
plans as a nested loop: a row is copied to each bucket that its own range touches, and the
exact condition follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.operators.quadtree import nearest_sources


def _seconds(c) -> Column:
    """Seconds since 1970 of a timestamp with or without zone."""
    return F.unix_timestamp(F.col(c).cast("timestamp"))


def interval_join(points: DataFrame, ranges: DataFrame, time: str, start: str, end: str, keys: list[str] = (), bucket_s: int = 86400) -> DataFrame:
    """Rows of ``points`` with each row of ``ranges`` whose closed interval holds their time.

    ``keys`` are further columns that must be equal. Choose ``bucket_s`` near the usual
    length of an interval: an interval is copied once for each bucket it touches.
    """
    left = points.withColumn("__b", F.floor(_seconds(time) / bucket_s))
    buckets = F.sequence(F.floor(_seconds(start) / bucket_s), F.floor(_seconds(end) / bucket_s))
    right = ranges.where(F.col(start) <= F.col(end)).withColumn("__b", F.explode(buckets))
    joined = left.join(right, [*keys, "__b"]).where((F.col(time) >= F.col(start)) & (F.col(time) <= F.col(end)))
    return joined.drop("__b")


def around_events(points: DataFrame, events: DataFrame, time: str, start: str, end: str, near_days: int = 2, far_days: int = 16, keys: list[str] = ()) -> DataFrame:
    """Points in [start - far, start - near] as phase ``before`` or in [end + near, end + far] as ``after``."""
    day = lambda c, n: F.col(c) + F.expr(f"INTERVAL {n} DAYS")
    spans = F.array(
        F.struct(F.lit("before").alias("phase"), day(start, -far_days).alias("lo"), day(start, -near_days).alias("hi")),
        F.struct(F.lit("after").alias("phase"), day(end, near_days).alias("lo"), day(end, far_days).alias("hi")),
    )
    tagged = events.withColumn("__s", F.explode(spans)).select("*", "__s.*").drop("__s")
    return interval_join(points, tagged, time, "lo", "hi", keys, far_days * 86400).drop("lo", "hi")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], tie: str, bucket_s: int = 7 * 86400) -> DataFrame:
    """Each left row with the values of the latest right row of its keys at or before its time, else null.

    One union and a running window in each bucket of time, so that no pair is ever formed and a
    key with very many rows is spread. What a bucket's first rows look back to, the latest right row
    of the buckets before, comes from a table of one row for each key and bucket. ``tie`` orders
    right rows of one time; the last counts.
    """
    bucket = F.floor(_seconds("__t") / bucket_s).alias("__b")
    a = left.withColumn("__t", F.col(left_time)).withColumn("__side", F.lit(1)).withColumn("__row", F.struct(*left.columns))
    b = right.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.struct(tie, *[v for v in values if v != tie]).alias("__v"))
    both = a.select(*keys, "__t", "__side", "__row").unionByName(b, allowMissingColumns=True).withColumn("__b", bucket)
    order = Window.partitionBy(*keys, "__b").orderBy("__t", "__side", F.col(f"__v.{tie}")).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("__got", F.last("__v", ignorenulls=True).over(order)).where("__side = 1")
    # the latest right row of each bucket, or null, and of all buckets before
    last = both.groupBy(*keys, "__b").agg(F.max(F.when(F.col("__side") == 0, F.struct("__t", F.col(f"__v.{tie}").alias("tie"), "__v"))).alias("__l"))
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = last.select(*keys, "__b", F.last("__l", ignorenulls=True).over(earlier)["__v"].alias("__old"))
    out = inside.join(before, [*keys, "__b"], "left")
    return out.select("__row.*", *[F.coalesce(F.col("__got"), F.col("__old"))[v].alias(v) for v in values])


def observation_interval(observations: DataFrame, dates: DataFrame, key: str, time: str, date: str, n: int, check_days: int = 21, include_borders: bool = True) -> DataFrame:
    """The interval that the n observations before (n < 0) or after (n > 0) each date span.

    Only observations within ``check_days`` count. With borders the date itself is one end;
    without, observations at the date don't count. If there are fewer than n, the whole
    interval that was checked is returned, and ``enough`` is false.
    """
    far = F.expr(f"INTERVAL {check_days} DAYS")
    checked = dates.withColumn("lo", F.col(date) - far if n < 0 else F.col(date)).withColumn("hi", F.col(date) if n < 0 else F.col(date) + far)
    times = observations.select(key, F.col(time).alias("__time")).distinct()
    near = interval_join(times, checked, "__time", "lo", "hi", [key], check_days * 86400)
    if not include_borders:
        near = near.where(F.col("__time") != F.col(date))
    rank = F.row_number().over(Window.partitionBy(key, date).orderBy(F.desc("__time") if n < 0 else F.asc("__time")))
    ends = near.withColumn("__n", rank).where(F.col("__n") <= abs(n)).groupBy(key, date).agg(F.count("*").alias("__found"), F.min("__time").alias("__first"), F.max("__time").alias("__last"))
    out = checked.join(ends, [key, date], "left").withColumn("enough", F.coalesce(F.col("__found"), F.lit(0)) == abs(n))
    inner = (F.col("__first"), F.col("__last"))
    begin = F.col("lo") if n > 0 and include_borders else inner[0]
    finish = F.col("hi") if n < 0 and include_borders else inner[1]
    return out.select(key, date, F.when(F.col("enough"), begin).otherwise(F.col("lo")).alias("start"), F.when(F.col("enough"), finish).otherwise(F.col("hi")).alias("end"), "enough")


def bbox_join(points: DataFrame, boxes: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    """Points with every box ``(min_x, min_y, max_x, max_y)`` that holds them, edges included.

    A box is copied to each grid cell that it touches; choose ``cell`` near its usual size.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    left = points.withColumn("__cx", at(x)).withColumn("__cy", at(y))
    right = boxes.withColumn("__cx", F.explode(F.sequence(at("min_x"), at("max_x")))).withColumn("__cy", F.explode(F.sequence(at("min_y"), at("max_y"))))
    inside = F.col(x).between(F.col("min_x"), F.col("max_x")) & F.col(y).between(F.col("min_y"), F.col("max_y"))
    return left.join(right, ["__cx", "__cy"]).where(inside).drop("__cx", "__cy")


def clip_boxes(boxes: DataFrame, extent: tuple[float, float, float, float]) -> DataFrame:
    """The part of each box ``(min_x, min_y, max_x, max_y)`` that lies in the extent, given likewise; boxes without an inner part in it go."""
    low = {c: F.greatest(F.col(c), F.lit(v)) for c, v in zip(("min_x", "min_y"), extent[:2])}
    high = {c: F.least(F.col(c), F.lit(v)) for c, v in zip(("max_x", "max_y"), extent[2:])}
    return boxes.withColumns(low | high).where((F.col("min_x") < F.col("max_x")) & (F.col("min_y") < F.col("max_y")))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether the point lies in the polygon ``array<struct<x, y>>``, by counting the edges that a ray to the right crosses."""
    edges = F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    crossed = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.when(e["b"]["y"] != e["a"]["y"], e["b"]["y"] - e["a"]["y"]).otherwise(1) + e["a"]["x"])
    return F.aggregate(edges, F.lit(False), lambda odd, e: odd != crossed(e))


def rasterize(points: DataFrame, zones: DataFrame, x: str, y: str, cell: float, keys: list[str], order: str = "zone_id") -> DataFrame:
    """Each point in some polygon with the zone of greatest ``order`` that holds it: the last drawn wins."""
    hits = bbox_join(points, zones, x, y, cell).where(in_ring(F.col(x), F.col(y), F.col("ring")))
    return hits.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("__order"), "zone_id")).alias("__z")).select(*keys, F.col("__z.zone_id").alias("zone_id"))


def ring_area(ring: Column) -> Column:
    """The area of a simple polygon by the shoelace formula."""
    turns = F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(turns, F.lit(0.0), lambda s, t: s + t)) / 2


def nearest_grid(targets: DataFrame, sources: DataFrame, x: str, y: str, value: str, keys: list[str]) -> DataFrame:
    """The value of the nearest source ``(sx, sy, value)`` of each target, by a quadtree of the sources; ties go to the smaller ``(sx, sy)``."""
    return nearest_sources(targets, sources, keys, x, y, value)
