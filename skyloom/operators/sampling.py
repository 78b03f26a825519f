"""Tiling, seeded sampling and leak-free splits.

All randomness is a hash of a seed and a row's own keys, so a result doesn't depend on
partitioning and repeats after a lost task. The default hash is a multiplicative one that SQL
engines can repeat.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.operators.graph import connected_components
from skyloom.operators.quadtree import near_cells
from skyloom.plans.staging import stage

MODULUS = 1000003


def draw(seed: int, *keys) -> Column:
    """A number in [0, 1) from a seed and integer keys."""
    h = F.lit(seed).cast("long")
    for k in keys:
        c = F.col(k) if isinstance(k, str) else k
        h = F.pmod(h * 31 + F.pmod(c.cast("long"), F.lit(MODULUS)) * 7919 + 104729, F.lit(MODULUS)) * 1009 % MODULUS
    return h / float(MODULUS)


def check_bins(bins: Sequence[float]) -> None:
    if not all(0 < b < 1 for b in bins) or any(a >= b for a, b in zip(bins, bins[1:])):
        raise ValueError("bins must ascend inside (0, 1)")


def fold(bins: Sequence[float], r: Column) -> Column:
    """1 plus how many bins the number reaches."""
    check_bins(bins)
    return reduce(lambda a, b: a + b, [F.when(r >= b, 1).otherwise(0) for b in bins]) + 1


def split_folds(df: DataFrame, bins: Sequence[float], keys: Sequence[str], seed: int = 7, ignore: Column | None = None) -> DataFrame:
    """Add ``fold``. Keys of a pixel give folds by pixel; tile and class, by class in a tile; class alone, alike across tiles. Ignored rows get 0."""
    f = fold(bins, draw(seed, *keys))
    return df.withColumn("fold", f if ignore is None else F.when(ignore, 0).otherwise(f))


#: Steps of the draw by which a class's rows are counted before any is ordered.
STEPS = 4096


def sample_per_class(df: DataFrame, by: Sequence[str], n: int, keys: Sequence[str], seed: int = 7) -> DataFrame:
    """Exactly n rows of each class, or all if it has fewer, those of least draw.

    Rows are counted by class and step of the draw first. Only those up to the step that completes the n are ordered, so
    that no task gets a whole class; classes of a null draw come as one step.
    """
    drawn = df.withColumn("__r", draw(seed, *keys)).withColumn("__step", F.coalesce(F.floor(F.col("__r") * STEPS), F.lit(-1).cast("long")))
    counts = drawn.groupBy(*by, "__step").agg(F.count("*").alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(Window.partitionBy(*by).orderBy("__step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = counts.withColumn("__before", before).where(F.col("__before") < n)
    # staged, so that its size is known: a few steps of a few classes are broadcast, more join by class and step
    wanted = stage(wanted.select(*[F.col(c).alias(f"__of_{c}") for c in by], F.col("__step").alias("__of")), "steps")
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"__of_{c}")), by, F.col("__step") == F.col("__of"))
    w = Window.partitionBy(*by).orderBy("__r", *keys)
    few = drawn.join(wanted, same, "left_semi")
    return few.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__r", "__n", "__step")


def sample_even(df: DataFrame, tile: str, label: str, more_than: int, n: int, keys: Sequence[str], seed: int = 7) -> DataFrame:
    """n rows for each tile and class, of classes with more than so many rows in the tile."""
    large = df.groupBy(tile, label).count().where(F.col("count") > more_than).select(tile, label)
    return sample_per_class(df.join(large, [tile, label], "left_semi"), [tile, label], n, keys, seed)


def sample_pixels(obs: DataFrame, n: int, seed: int = 7, tile: str = "tile_id") -> DataFrame:
    """All rows of n pixels of each tile: the same pixels for every time and feature."""
    pixels = obs.select(tile, "y", "x").distinct()
    chosen = sample_per_class(pixels, [tile], n, [tile, "y", "x"], seed)
    return obs.join(chosen, [tile, "y", "x"], "left_semi")


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str, slices: int = 0) -> DataFrame:
    """Add ``name``, each row's place from 0 among the rows of its class, and ``name``_of, their number.

    Rows are dealt to slices by ranges of class, order and a number of their own, so a class of any size is spread over
    tasks, and so are the rows of one place in the order; which of these comes first is left open. The slices' counts, one row for each class in each,
    tell where a slice begins.
    """
    wanted = [slices] if slices else []
    own = df.withColumn("__own", F.monotonically_increasing_id())
    cut = stage(own.repartitionByRange(*wanted, *by, *order, "__own").withColumn("__slice", F.spark_partition_id()), "slices")
    counts = cut.groupBy(*by, "__slice").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__n").over(w.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__slice").alias("__of"), before.alias("__before"), F.sum("__n").over(w).alias(f"{name}_of"))
    place = F.row_number().over(Window.partitionBy(*by, "__slice").orderBy(*order, "__own")) - 1
    same = F.col("__slice") == F.col("__of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    joined = cut.withColumn("__place", place).join(starts, same)
    return joined.withColumn(name, F.col("__place") + F.col("__before")).drop("__slice", "__own", "__of", "__place", "__before", *[f"__by_{c}" for c in by])


def value_places(df: DataFrame, value: str, slices: int = 0) -> DataFrame:
    """``(value, n, start, total)``: of each distinct value that isn't null its rows, and the place from 0 of the first of them in order.

    Rows are counted by value before anything is ordered, so a value on very many rows is one row here; values are then summed up in slices.
    """
    wanted = [slices] if slices else []
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    cut = stage(counts.repartitionByRange(*wanted, "value").withColumn("__slice", F.spark_partition_id()), "values")
    sums = cut.groupBy("__slice").agg(F.sum("n").alias("held"))
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("held").over(everything.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col("__slice").alias("__of"), before.alias("__before"), F.sum("held").over(everything).alias("total"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("__slice").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = cut.withColumn("__inside", inside).join(starts, F.col("__slice") == F.col("__of"))
    return joined.select("value", "n", (F.col("__before") + F.col("__inside")).alias("start"), "total")


def exact_quantiles(df: DataFrame, value: str, quantiles: Sequence[float]) -> DataFrame:
    """One row with an array ``q`` of interpolated quantiles of the whole column, from its distinct values and their counts."""
    return quantiles_of(value_places(df.select(value), value), quantiles)


def quantiles_of(placed: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """The same of a column's ``value_places``."""
    rank = lambda q: (F.col("total") - 1) * F.lit(float(q))
    holds = lambda at: ((at >= F.col("start")) & (at < F.col("start") + F.col("n"))).cast("double")

    def weight(q):
        low, rest = F.floor(rank(q)), rank(q) - F.floor(rank(q))
        return holds(low) * (1 - rest) + holds(low + 1) * rest

    return placed.agg(F.array(*[F.sum(weight(q) * F.col("value")) for q in quantiles]).alias("q"))


def every_kth(df: DataFrame, k: int, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Add ``test``: true for the first of every k rows in order."""
    return ranked(df, by, order, "__p").withColumn("test", F.col("__p") % k == 0).drop("__p", "__p_of")


def split_by_share(df: DataFrame, by: Sequence[str], shares: Sequence[tuple[str, float]], keys: Sequence[str], seed: int = 7) -> DataFrame:
    """Add ``part``: within each class, rows in the order of their draw are cut at the cumulated shares."""
    placed = ranked(df.withColumn("__r", draw(seed, *keys)), by, ["__r", *keys], "__p")
    place = F.col("__p") / F.col("__p_of")
    ends, at = [], 0.0
    for name, share in shares:
        at += share
        ends.append((name, at))
    part = reduce(lambda acc, e: acc.when(place < e[1] - 1e-9, e[0]), ends[1:-1], F.when(place < ends[0][1] - 1e-9, ends[0][0])).otherwise(ends[-1][0])
    return placed.withColumn("part", part).drop("__r", "__p", "__p_of")


def split_columns(tiles: DataFrame, index: str, shares: Sequence[tuple[str, float]], descending: bool = False) -> DataFrame:
    """Add ``part`` by whole columns (or rows) of tiles: columns in order until a part has its share of all tiles."""
    counts = tiles.groupBy(index).agg(F.count("*").alias("__n"))
    order = F.desc(index) if descending else F.asc(index)
    before = F.coalesce(F.sum("__n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = before / F.sum("__n").over(Window.partitionBy())
    ends, at = [], 0.0
    for name, s in shares:
        at += s
        ends.append((name, at))
    part = reduce(lambda acc, e: acc.when(F.col("__s") < e[1] - 1e-9, e[0]), ends[1:-1], F.when(F.col("__s") < ends[0][1] - 1e-9, ends[0][0])).otherwise(ends[-1][0])
    return tiles.join(counts.withColumn("__s", share).select(index, part.alias("part")), index)


def grid_tiles(area: DataFrame, size: float) -> DataFrame:
    """Square tiles of a metric grid that meet each area ``(min_x, min_y, max_x, max_y)``: index and box."""
    at = lambda c: F.floor(F.col(c) / size)
    cells = area.withColumn("index_x", F.explode(F.sequence(at("min_x"), at("max_x")))).withColumn("index_y", F.explode(F.sequence(at("min_y"), at("max_y"))))
    box = [(F.col(f"index_{c}") + k).cast("double") * size for k in (0, 1) for c in ("x", "y")]
    return cells.select("index_x", "index_y", box[0].alias("min_x"), box[1].alias("min_y"), box[2].alias("max_x"), box[3].alias("max_y")).distinct()


def split_box(area: DataFrame, nx: int, ny: int) -> DataFrame:
    """nx times ny equal tiles of each area."""
    steps = area.withColumn("index_x", F.explode(F.sequence(F.lit(0), F.lit(nx - 1)))).withColumn("index_y", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
    w, h = (F.col("max_x") - F.col("min_x")) / nx, (F.col("max_y") - F.col("min_y")) / ny
    x, y = F.col("min_x") + F.col("index_x") * w, F.col("min_y") + F.col("index_y") * h
    return steps.select(*[c for c in area.columns if c not in ("min_x", "min_y", "max_x", "max_y")], "index_x", "index_y", x.alias("min_x"), y.alias("min_y"), (x + w).alias("max_x"), (y + h).alias("max_y"))


def utm_zone(lon: Column) -> Column:
    return F.floor((lon + 180) / 6).cast("int") + 1


def distance_groups(points: DataFrame, key: str, x: str, y: str, within: float) -> DataFrame:
    """``(key, group)``: points chained by steps of at most ``within`` are one group, named by its least key.

    Cells are so small that all points of one are within the distance, so that they are linked
    through the cell's least key and a dense cell gives no pairs. Neighbouring cells are
    linked once if some pair of theirs is near enough, which their boxes tell (``quadtree``).
    """
    side = within / math.sqrt(2) * (1 - 1e-12)
    at = lambda c: F.floor(F.col(c) / side)
    cells = stage(points.select(F.col(key).alias("k"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")).withColumn("cx", at("px")).withColumn("cy", at("py")), "cells")
    heads = stage(cells.dropna(subset=["cx", "cy"]).groupBy("cx", "cy").agg(F.min("k").alias("head")), "heads")
    # of the cells that a step can reach, those after this one in order
    ahead = [(i, j) for i in range(0, 3) for j in range(-2, 3) if (i, j) > (0, 0)]
    o = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i, j in ahead])).alias("o")
    pairs = heads.select("cx", "cy", o).select("cx", "cy", F.col("o.i").alias("ox"), F.col("o.j").alias("oy"))
    near = near_cells(cells.dropna(subset=["cx", "cy"]), pairs, "px", "py", side, within)
    other = heads.select(F.col("cx").alias("qx"), F.col("cy").alias("qy"), F.col("head").alias("head2"))
    links = near.join(heads, ["cx", "cy"]).withColumn("qx", F.col("cx") + F.col("ox")).withColumn("qy", F.col("cy") + F.col("oy")).join(other, ["qx", "qy"]).select("head", "head2")
    # the second key, which follows from the first, gives the join a shuffle of its own, whose hot cells can be split
    half = F.pmod("cx", F.lit(2)).alias("half")
    inside = cells.select("k", "cx", "cy", half).join(heads.select("cx", "cy", "head", half), ["cx", "cy", "half"]).select("head", F.col("k").alias("head2"))
    found = connected_components(links.unionAll(inside), "head", "head2").withColumnRenamed("node", key)
    return points.select(key).join(found, key, "left").select(key, F.coalesce("component", F.col(key)).alias("group"))
