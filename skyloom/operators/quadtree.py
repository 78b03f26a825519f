"""Exact distances between crowded point sets by boxes that are split until their bounds settle the question.

A box is known by its number of points, the least box round them and one point of it. Such boxes are tables of one
row each, so a step is an equi join of boxes, and points are only joined where few are left. Nested
boxes halve their sides: dividing by a power of two is exact, so a child's number divided by two is its parent's.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.plans.staging import is_empty, stage

#: Two boxes are compared point by point if they have so few pairs.
PAIRS = 16
#: Boxes of so few sources are looked into point by point.
FEW = 4
#: Halvings after which points are as near as numbers can tell.
DEEPEST = 44


def boxes_of(points: DataFrame, keys: Sequence[str], x: str, y: str, first: Column) -> DataFrame:
    """``(…keys, box)``: number, bounds and least point of each group."""
    box = [F.count("*").alias("n"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.min(first).alias("p")]
    found = points.groupBy(*keys).agg(*box)
    return found.select(*keys, F.struct("n", "x0", "x1", "y0", "y1", "p").alias("box"))


def _square(c: Column) -> Column:
    return c * c


def gap2(a: Column, b: Column) -> Column:
    """No points of two boxes are nearer; squared, and rounded as the distance of two points is."""
    apart = lambda lo, hi: F.greatest(F.lit(0.0), b[lo] - a[hi], a[lo] - b[hi])
    return _square(apart("x0", "x1")) + _square(apart("y0", "y1"))


def span2(a: Column, b: Column) -> Column:
    """No points of two boxes are farther; squared."""
    across = lambda lo, hi: F.greatest(b[hi] - a[lo], a[hi] - b[lo])
    return _square(across("x0", "x1")) + _square(across("y0", "y1"))


def near_cells(points: DataFrame, pairs: DataFrame, x: str, y: str, side: float, within: float, limit: int = PAIRS) -> DataFrame:
    """``(cx, cy, ox, oy)``: the pairs of cells that hold two points, one in each, at most ``within`` apart.

    ``points`` has its cell in ``cx, cy``, squares of that side; ``pairs`` names a cell and where the other one lies from it. Pairs of boxes
    are linked if their chosen points or all their points are near, and let go if all are
    farther. What neither settles is split, and a pair of cells is done with its first near points, so
    only boxes about the distance apart go on.
    """
    pair, two = ["cx", "cy", "ox", "oy"], within * within
    at = lambda c, level: F.floor(F.col(c) / side * float(1 << level)).cast("long")
    held = stage(points.select("cx", "cy", F.col(x).alias("px"), F.col(y).alias("py")), "points")
    box = stage(boxes_of(held, ["cx", "cy"], "px", "py", F.struct("px", "py")), "boxes")
    one, other = box.select(F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("box").alias("a")), box.select(F.col("cx").alias("bx"), F.col("cy").alias("by"), F.col("box").alias("b"))
    named = pairs.select(*pair, F.col("cx").alias("ax"), F.col("cy").alias("ay"), (F.col("cx") + F.col("ox")).alias("bx"), (F.col("cy") + F.col("oy")).alias("by"))
    met = named.join(one, ["ax", "ay"]).join(other, ["bx", "by"])
    links, active = [], held
    for level in range(DEEPEST + 1):
        a, b = F.col("a"), F.col("b")
        chosen = _square(a["p"]["px"] - b["p"]["px"]) + _square(a["p"]["py"] - b["p"]["py"])
        judged = stage(met.where(gap2(a, b) <= two).withColumn("near", (chosen <= two) | (span2(a, b) <= two)), "pairs")
        links.append(judged.where("near").select(*pair).distinct())
        left = judged.where("NOT near").join(links[-1], pair, "left_anti")
        left = stage(left.select(*pair, "ax", "ay", "bx", "by", (a["n"] * b["n"]).alias("size")), "open")
        few = left if level == DEEPEST else left.where(F.col("size") <= limit)
        side_of = lambda n, names: active.select(*[at(c, level).alias(k) for c, k in zip(("px", "py"), names)], F.col("px").alias(f"{n}x"), F.col("py").alias(f"{n}y"))  # noqa: B023, E731
        seen = few.join(side_of("p", ("ax", "ay")), ["ax", "ay"]).join(side_of("q", ("bx", "by")), ["bx", "by"])
        seen = seen.where(_square(F.col("px") - F.col("qx")) + _square(F.col("py") - F.col("qy")) <= two)
        links.append(stage(seen.select(*pair).distinct(), "near_points"))
        left = left.where(F.col("size") > limit)
        if level == DEEPEST or is_empty(left):
            break
        # the points of boxes that are still open, in boxes of half the side
        wanted = left.select(F.col("ax").alias("ux"), F.col("ay").alias("uy")).unionAll(left.select("bx", "by")).distinct()
        placed = active.withColumn("ux", at("px", level)).withColumn("uy", at("py", level))
        active = stage(placed.join(wanted, ["ux", "uy"], "left_semi").select("px", "py", "ux", "uy"), "active")
        kids = stage(boxes_of(active.withColumn("kx", at("px", level + 1)).withColumn("ky", at("py", level + 1)), ["ux", "uy", "kx", "ky"], "px", "py", F.struct("px", "py")), "boxes")
        kid = lambda n: kids.select(F.col("ux").alias(f"{n}x"), F.col("uy").alias(f"{n}y"), F.col("kx").alias(f"{n}kx"), F.col("ky").alias(f"{n}ky"), F.col("box").alias(n))  # noqa: B023, E731
        met = left.join(kid("a"), ["ax", "ay"]).join(kid("b"), ["bx", "by"])
        met = met.select(*pair, F.col("akx").alias("ax"), F.col("aky").alias("ay"), F.col("bkx").alias("bx"), F.col("bky").alias("by"), "a", "b")
    return reduce(DataFrame.unionAll, links).distinct()


def nearest_sources(targets: DataFrame, sources: DataFrame, keys: Sequence[str], x: str, y: str, value: str, few: int = FEW) -> DataFrame:
    """``(…keys, value)`` of each target's nearest source ``(sx, sy, value)``; of equally near ones that of least sx, then sy, then value.

    A quadtree of the sources is descended level by level, two halvings at a time. A target keeps the boxes that may hold
    something as near as the farthest point of its best box, a few at any level whatever the sources' density; boxes of few sources
    become these. Targets without a place give no row; without sources the value is null.
    """
    extent = sources.agg(F.min("sx"), F.max("sx"), F.min("sy"), F.max("sy")).first()
    if extent[0] is None:
        return targets.select(*keys, F.lit(None).cast(sources.schema[value].dataType).alias(value))
    width = max(extent[1] - extent[0], extent[3] - extent[2]) or 1.0
    cell = lambda c, low, level: F.least(F.floor((F.col(c) - low) / width * float(1 << level)).cast("long"), F.lit((1 << level) - 1))
    active = stage(sources.select(F.col("sx").cast("double").alias("sx"), F.col("sy").cast("double").alias("sy"), F.col(value).alias("v")).dropna(subset=["sx", "sy"]), "sources")
    point = F.struct("sx", "sy", "v")
    far = F.lit(float("inf"))
    open_ = targets.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna(subset=["x", "y"])
    open_ = open_.select(*keys, "x", "y", F.lit(0).cast("long").alias("ux"), F.lit(0).cast("long").alias("uy"), far.alias("best"))
    found = []
    for level in range(0, DEEPEST + 1, 2):
        placed = active.withColumn("ux", cell("sx", extent[0], level)).withColumn("uy", cell("sy", extent[2], level))
        placed = placed.withColumn("kx", cell("sx", extent[0], level + 2)).withColumn("ky", cell("sy", extent[2], level + 2))
        kids = boxes_of(placed, ["ux", "uy", "kx", "ky"], "sx", "sy", point)
        single = (F.col("box.x0") == F.col("box.x1")) & (F.col("box.y0") == F.col("box.y1"))
        split = F.lit(level + 2 < DEEPEST) & (F.col("box.n") > few) & ~single
        kids = stage(kids.withColumn("split", split).withColumn("single", single), "boxes")
        # boxes of few sources are looked into at once: each source is a box of its own
        small = placed.join(kids.where("NOT split AND NOT single").select("kx", "ky"), ["kx", "ky"], "left_semi")
        alone = small.select("ux", "uy", "kx", "ky", F.struct(F.lit(1).cast("long").alias("n"), F.col("sx").alias("x0"), F.col("sx").alias("x1"), F.col("sy").alias("y0"), F.col("sy").alias("y1"), point.alias("p")).alias("box"), F.lit(True).alias("last"))
        looked = stage(kids.where("split OR single").select("ux", "uy", "kx", "ky", "box", (~F.col("split")).alias("last")).unionAll(alone), "looked_into")
        here = F.struct(F.col("x").alias("x0"), F.col("x").alias("x1"), F.col("y").alias("y0"), F.col("y").alias("y1"))
        met = open_.join(looked, ["ux", "uy"]).withColumn("low", gap2(here, F.col("box")))
        rep = _square(F.col("x") - F.col("box.p.sx")) + _square(F.col("y") - F.col("box.p.sy"))
        # what an earlier bound rules out, and a box's sides, need not go to the window
        met = met.where("low <= best").select(*keys, "x", "y", "kx", "ky", "last", "low", "best", rep.alias("rep"), F.least(rep, span2(here, F.col("box"))).alias("reach"), F.col("box.p").alias("p"))
        bound = F.min("reach").over(Window.partitionBy(*keys))
        met = stage(met.withColumn("best", F.least("best", bound)).where("low <= best").drop("reach", "low"), "met")
        found.append(met.where("last").select(*keys, F.struct(F.col("rep").alias("d"), "p").alias("m")))
        open_ = met.where("NOT last").select(*keys, "x", "y", F.col("kx").alias("ux"), F.col("ky").alias("uy"), "best")
        if is_empty(open_):
            break
        active = stage(placed.join(kids.where("split").select("kx", "ky"), ["kx", "ky"], "left_semi").select("sx", "sy", "v"), "sources")
    nearest = reduce(DataFrame.unionAll, found).groupBy(*keys).agg(F.min("m").alias("m"))
    return nearest.select(*keys, F.col("m.p.v").alias(value))
