"""Neighbourhoods of pixels in a tile.

All are joins and aggregates of shifted pixels, so a tile may be spread over many tasks.
Nothing crosses from one tile to the next.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators.graph import connected_components

PIXEL = ["tile_id", "y", "x"]


def disk(radius: int) -> list[tuple[int, int]]:
    """Offsets (dy, dx) within the radius."""
    r = range(-radius, radius + 1)
    return [(dy, dx) for dy in r for dx in r if dy * dy + dx * dx <= radius * radius]


def _shifted(rows: DataFrame, offsets: Sequence[tuple[int, int]], value: Sequence[str] = ()) -> DataFrame:
    """A copy of each row at each offset from its pixel, with ``dy`` and ``dx``."""
    o = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets]))
    return rows.select("tile_id", "y", "x", *value, o.alias("o")).select("tile_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "o.dy", "o.dx", *value)


def _beside(pixels: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """Pixels with what was found for them. Both sides have a row for each pixel, which a planner takes for no more than the arrays they come from, so neither is broadcast."""
    return pixels.join(found.hint("merge"), PIXEL, how)


def _reached(pixels: DataFrame, value: str, offsets: Sequence[tuple[int, int]], back: Callable[[Column, int], Column], height: int, width: int) -> DataFrame:
    """``(tile_id, y, x, __i, __v)``: each pixel's value at every pixel that looks at it by the i-th offset.

    ``back`` takes an index beyond the edge into the tile; a pixel counts for all that reach it or one of its images beyond the edge. What a pixel
    sees is then one aggregate without a join, most of which is done before the shuffle.
    """
    r = max(max(abs(dy), abs(dx)) for dy, dx in offsets)

    def images(axis, n):
        beyond = [*range(-r, 0), *range(n, n + r)]
        return F.explode(F.array_compact(F.array(F.col(axis).cast("long"), *[F.when(back(F.lit(i), n) == F.col(axis), F.lit(i).cast("long")) for i in beyond])))

    o = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for i, (dy, dx) in enumerate(offsets)]))
    spread = pixels.select("tile_id", "x", F.col(value).alias("__v"), images("y", height).alias("__y")).select("tile_id", "__v", "__y", images("x", width).alias("__x"))
    spread = spread.select("tile_id", "__v", "__y", "__x", o.alias("o")).select("tile_id", (F.col("__y") - F.col("o.dy")).alias("y"), (F.col("__x") - F.col("o.dx")).alias("x"), F.col("o.i").alias("__i"), "__v")
    return spread.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))


def dilate(pixels: DataFrame, mask: str, radius: int, out: str = "dilated") -> DataFrame:
    """Whether any true pixel lies within the radius."""
    reached = _shifted(pixels.where(F.col(mask)), disk(radius)).select(*PIXEL).distinct().withColumn("__hit", F.lit(True))
    return _beside(pixels, reached, "left").withColumn(out, F.coalesce("__hit", F.lit(False))).drop("__hit")


def erode(pixels: DataFrame, mask: str, radius: int, out: str = "eroded") -> DataFrame:
    """Whether all pixels within the radius are true; what lies outside the tile counts as true."""
    grown = dilate(pixels.withColumn("__not", ~F.coalesce(F.col(mask), F.lit(False))), "__not", radius, "__grown")
    return grown.withColumn(out, ~F.col("__grown")).drop("__not", "__grown")


def erode_classes(pixels: DataFrame, label: str, radius: int, out: str = "eroded") -> DataFrame:
    """The label where no other label lies within the radius, else 0."""
    near = _shifted(pixels, disk(radius), [label]).withColumnRenamed(label, "__n").groupBy(*PIXEL).agg(F.min("__n").alias("__lo"), F.max("__n").alias("__hi"))
    return _beside(pixels, near).withColumn(out, F.when(F.col("__lo") == F.col("__hi"), F.col(label)).otherwise(0)).drop("__lo", "__hi")


def disk_mean(pixels: DataFrame, value: str, radius: int, height: int, width: int, out: str = "smooth") -> DataFrame:
    """Mean over a disk; indices beyond the edge are reflected (d c b a | a b c d | d c b a)."""
    def back(c, n):
        return F.when(c < 0, -1 - c).when(c >= n, 2 * n - 1 - c).otherwise(c)

    mean = _reached(pixels, value, disk(radius), back, height, width).groupBy(*PIXEL).agg(F.avg("__v").alias(out))
    return _beside(pixels, mean)


def block(pixels: DataFrame, factor: int, **aggregates: Column) -> DataFrame:
    """Aggregates of factor x factor blocks."""
    return pixels.groupBy("tile_id", F.floor(F.col("y") / factor).alias("by"), F.floor(F.col("x") / factor).alias("bx")).agg(*[c.alias(n) for n, c in aggregates.items()])


def from_blocks(pixels: DataFrame, blocks: DataFrame, factor: int) -> DataFrame:
    """Each pixel with its block's values: nearest up-sampling."""
    return pixels.withColumn("by", F.floor(F.col("y") / factor)).withColumn("bx", F.floor(F.col("x") / factor)).join(blocks, ["tile_id", "by", "bx"]).drop("by", "bx")


def boundaries(pixels: DataFrame, segment: str, out: str = "boundary") -> DataFrame:
    """Whether any of the four neighbours within the tile has another segment."""
    near = _shifted(pixels, [(0, 1), (1, 0), (0, -1), (-1, 0)], [segment]).withColumnRenamed(segment, "__n")
    differs = _beside(pixels, near).groupBy(*PIXEL).agg(F.bool_or(F.col("__n") != F.col(segment)).alias(out))
    return _beside(pixels, differs, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def gradients(pixels: DataFrame, value: str, height: int, width: int) -> DataFrame:
    """Sobel gradients ``gx, gy`` (3 x 3, sum of weights 8) with the edge reflected about the outer pixel."""
    weights = {(dy, dx): (dx * (2 - abs(dy)), dy * (2 - abs(dx))) for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
    used = {d: w for d, w in weights.items() if w != (0, 0)}
    mirror = lambda c, n: F.when(c < 0, -c).when(c >= n, 2 * n - 2 - c).otherwise(c)
    at = lambda i: F.element_at(F.array(*[F.lit(float(w[i])) for w in used.values()]), F.col("__i") + 1)
    seen = _reached(pixels, value, list(used), mirror, height, width)
    found = seen.groupBy(*PIXEL).agg(F.sum(at(0) * F.col("__v")).alias("gx"), F.sum(at(1) * F.col("__v")).alias("gy"))
    return found.join(pixels.select(*PIXEL).hint("merge"), PIXEL, "left_semi")


def central_gradients(pixels: DataFrame, value: str, height: int, width: int) -> DataFrame:
    """Differences ``gr, gc`` of the neighbours below and above, right and left; 0 on the outer rows and columns."""
    ways = {(-1, 0): ("gr", 1.0), (1, 0): ("gr", -1.0), (0, -1): ("gc", 1.0), (0, 1): ("gc", -1.0)}
    near = _shifted(pixels, list(ways), [value])
    part = lambda name: F.sum(reduce(lambda a, w: a.when((F.col("dy") == w[0][0]) & (F.col("dx") == w[0][1]), w[1][1] * F.col("__n")), [w for w in ways.items() if w[1][0] == name], F.when(F.lit(False), 0.0)))
    sums = near.withColumnRenamed(value, "__n").groupBy(*PIXEL).agg(part("gr").alias("gr"), part("gc").alias("gc"))
    inner = lambda c, at, n: F.when((F.col(at) > 0) & (F.col(at) < n - 1), F.col(c)).otherwise(0.0).alias(c)
    return _beside(pixels, sums, "left").select(*pixels.columns, inner("gr", "y", height), inner("gc", "x", width))


def oriented_gradients(pixels: DataFrame, value: str, height: int, width: int, orientations: int = 9, cell: int = 8, block: int = 3) -> DataFrame:
    """``(tile_id, row, col, angle, value)``: histograms of gradient directions of cells, normalised in overlapping blocks.

    A cell's histogram is the mean magnitude of its pixels by direction modulo 180 degrees. Blocks of ``block`` x ``block`` cells begin at every cell from which
    they fit; each is divided by its length, cut at 0.2 and divided again. A cell stands once for each block that holds it: at row
    ``block`` times the block's row plus its own row in it, and so for columns.
    """
    g = central_gradients(pixels, value, height, width)
    degrees = F.pmod(F.round(F.degrees(F.atan2("gr", "gc")), 9), F.lit(180.0))
    angle = F.floor(degrees * orientations / 180).cast("int")
    size = F.sqrt(F.col("gr") * F.col("gr") + F.col("gc") * F.col("gc"))
    rows, cols = height // cell, width // cell
    inside = g.where((F.col("y") < rows * cell) & (F.col("x") < cols * cell)).select("tile_id", F.floor(F.col("y") / cell).cast("int").alias("cy"), F.floor(F.col("x") / cell).cast("int").alias("cx"), angle.alias("angle"), size.alias("size"))
    sums = [(F.sum(F.when(F.col("angle") == k, F.col("size")).otherwise(0.0)) / (cell * cell)).alias(f"h{k}") for k in range(orientations)]
    cells = inside.groupBy("tile_id", "cy", "cx").agg(*sums).select("tile_id", "cy", "cx", F.array(*[f"h{k}" for k in range(orientations)]).alias("h"))
    within = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(block) for j in range(block)])).alias("o")
    held = cells.select("tile_id", "h", "cy", "cx", within).select("tile_id", "h", "o.i", "o.j", (F.col("cy") - F.col("o.i")).alias("by"), (F.col("cx") - F.col("o.j")).alias("bx"))
    held = held.where((F.col("by") >= 0) & (F.col("by") <= rows - block) & (F.col("bx") >= 0) & (F.col("bx") <= cols - block))
    # a block's window holds block x block rows
    whole = _whole(["tile_id", "by", "bx"])
    length = lambda c: F.sqrt(F.sum(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)).over(whole) + 1e-10)
    held = held.withColumn("n", length("h")).withColumn("h", F.transform("h", lambda v: F.least(v / F.col("n"), F.lit(0.2))))
    held = held.withColumn("n", length("h")).withColumn("h", F.transform("h", lambda v: v / F.col("n")))
    return held.select("tile_id", (F.col("by") * block + F.col("i")).alias("row"), (F.col("bx") * block + F.col("j")).alias("col"), F.posexplode("h").alias("angle", "value"))


def hillshade(gx: Column, gy: Column, res_x: float, res_y: float, zenith: Column, azimuth: Column) -> Column:
    """Illumination of a slope from Sobel sums and sun angles in degrees; at most 0 is shade."""
    dx, dy = gx / (8 * res_x), gy / (8 * res_y)
    slope = F.atan(F.sqrt(dx * dx + dy * dy))
    raw = F.atan2(dy, -dx)
    aspect = F.when(dx != 0, F.when(raw < 0, raw + 2 * math.pi).otherwise(raw)).when(dy > 0, F.lit(math.pi / 2)).when(dy < 0, F.lit(1.5 * math.pi)).otherwise(F.lit(0.0))
    z, a = F.radians(zenith), F.radians(360 - azimuth + 90)
    return F.cos(z) * F.cos(slope) + F.sin(z) * F.sin(slope) * F.cos(a - aspect)


def project(pixels: DataFrame, mask: str, elevation: Column, dx: Column, dy: Column, height: int, width: int, keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Distinct pixels on which masked pixels fall when moved by elevation times (dx, dy); outside the tile is dropped."""
    moved = pixels.where(F.col(mask)).select(*keys, F.round(F.col("y") + elevation * dy).cast("long").alias("y"), F.round(F.col("x") + elevation * dx).cast("long").alias("x"))
    return moved.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width)).distinct()


def edge_mask(y: Column, x: Column, rows_off: int, cols_off: int, height: int, width: int) -> Column:
    """Pixels that a projection by (rows_off, cols_off) leaves without a source."""
    across = x < cols_off if cols_off > 0 else x >= width + cols_off if cols_off < 0 else F.lit(True)
    down = y >= height - rows_off if rows_off > 0 else y < -rows_off if rows_off < 0 else F.lit(True)
    return across | down


def snow_first_pass(ndsi: Column, red: Column, cloud: Column, ndsi_min: float = 0.4, red_min: float = 0.2) -> Column:
    return ~cloud & (ndsi > ndsi_min) & (red > red_min)


def snow_line(pixels: DataFrame, snow: str, clear: str, dem: str, bin_size: float, frac_min: float, total_min: float, frame: Sequence[str] = ("tile_id", "ts")) -> DataFrame:
    """``(…frame, line)``: the lower edge, two bins under the first elevation bin whose snow share of clear pixels exceeds the limit.

    Frames whose snow share of all pixels doesn't exceed ``total_min``, and those without such a
    bin, have no line. The lowest bin bounds it from below.
    """
    low = F.floor(F.min(dem).over(_whole(frame)) / bin_size)
    binned = pixels.withColumn("__bin", F.floor(F.col(dem) / bin_size)).withColumn("__low", low)
    share = F.try_divide(F.count_if(F.col(snow) & F.col(clear)), F.count_if(F.col(clear)))
    bins = binned.groupBy(*frame, "__bin").agg(share.alias("__f"), F.count_if(snow).alias("__s"), F.count("*").alias("__n"), F.min("__low").alias("__low"))
    frames = bins.groupBy(*frame).agg(F.min(F.when(F.col("__f") > frac_min, F.col("__bin"))).alias("__first"), (F.sum("__s") / F.sum("__n")).alias("__total"), F.min("__low").alias("__low"))
    return frames.where((F.col("__total") > total_min) & F.col("__first").isNotNull()).select(*frame, (F.greatest(F.col("__first") - 2, F.col("__low")) * bin_size).alias("line"))


def _whole(keys):
    from pyspark.sql.window import Window

    return Window.partitionBy(*keys)


def snow_second_pass(pixels: DataFrame, lines: DataFrame, dem: str, ndsi: Column, red: Column, cloud: Column, ndsi_min: float = 0.15, red_min: float = 0.04, frame: Sequence[str] = ("tile_id", "ts"), out: str = "snow2") -> DataFrame:
    """Snow above the frame's snow line by looser limits; none where the frame has no line."""
    found = ~cloud & (F.col(dem) > F.col("line")) & (ndsi > ndsi_min) & (red > red_min)
    return pixels.join(lines, list(frame), "left").withColumn(out, F.coalesce(found, F.lit(False))).drop("line")


def refined_cloud(cloud: Column, coarse_red: Column, dem: Column, cirrus: Column | None = None, red_min: float = 0.3, cirrus_min: float = 0.015, per_metre: float = 5e-6) -> Column:
    """Cloud where the down-sampled red is bright, and what a cirrus band adds; without that band nothing is added."""
    high = F.lit(False) if cirrus is None else cirrus > cirrus_min + per_metre * dem
    return (cloud & (coarse_red > red_min)) | high


def large_components(pixels: DataFrame, mask: str, min_size: int, height: int, width: int, out: str = "large") -> DataFrame:
    """Whether the 8-connected component of true pixels that a pixel belongs to is larger than ``min_size``."""
    number = F.col("tile_id").cast("long") * (height * width) + F.col("y") * width + F.col("x")
    rows = pixels.withColumn("__node", number)
    on = rows.where(F.col(mask)).select(*PIXEL, "__node")
    near = _shifted(on, [(0, 1), (1, -1), (1, 0), (1, 1)], ["__node"]).withColumnRenamed("__node", "__other")
    found = connected_components(on.join(near, PIXEL).select("__node", "__other"), "__node", "__other")
    sizes = found.groupBy("component").agg(F.count("*").alias("__size"))
    sized = found.join(sizes, "component").select(F.col("node").alias("__node"), "__size")
    large = F.coalesce(F.col(mask), F.lit(False)) & (F.coalesce("__size", F.lit(1)) > min_size)
    return rows.join(sized, "__node", "left").withColumn(out, large).drop("__node", "__size")


def _inside(c: Column, n: int) -> Column:
    """The nearest index in [0, n)."""
    return F.greatest(F.lit(0), F.least(c, F.lit(n - 1)))


def local_binary_pattern(pixels: DataFrame, value: str, height: int, width: int, points: int = 8, radius: float = 1, out: str = "lbp") -> DataFrame:
    """Rotation-invariant uniform pattern: which of the points on a circle are at least the centre.

    A point between pixels is interpolated from the four round it, the edge repeated. Up to two
    changes round the circle give the number of such points, more give ``points + 1``.
    """
    around = circle(points, radius)
    offsets = sorted({(dy, dx) for _, dy, dx, _ in around})
    seen = _reached(pixels, value, offsets, _inside, height, width)
    near = seen.groupBy(*PIXEL).agg(*[F.sum(F.when(F.col("__i") == i, F.col("__v"))).alias(f"__n{i}") for i in range(len(offsets))])

    def bit(k):
        parts = [w * F.col(f"__n{offsets.index((dy, dx))}") for p, dy, dx, w in around if p == k]
        total = F.when(F.coalesce(*parts).isNotNull(), reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in parts]))
        return (total >= F.col(value) - 1e-9).cast("long")

    bits = [bit(k) for k in range(points)]
    packed = F.when(F.coalesce(*bits).isNotNull(), reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) * (1 << k) for k, c in enumerate(bits)]))
    told = _beside(pixels, near).withColumn("__bits", packed).drop(*[f"__n{i}" for i in range(len(offsets))])
    turned = F.shiftleft(F.col("__bits"), 1).bitwiseAND((1 << points) - 1).bitwiseOR(F.shiftright(F.col("__bits"), points - 1))
    changes = F.bit_count(F.col("__bits").bitwiseXOR(turned))
    return told.withColumn(out, F.when(changes <= 2, F.bit_count("__bits")).otherwise(points + 1)).drop("__bits")


def circle(points: int, radius: float) -> list[tuple[int, int, int, float]]:
    """``(point, dy, dx, weight)`` of the pixels from which each point of a circle is interpolated."""
    out = []
    for k in range(points):
        dy, dx = round(-radius * math.sin(2 * math.pi * k / points), 8), round(radius * math.cos(2 * math.pi * k / points), 8)
        y, x = math.floor(dy), math.floor(dx)
        corners = [(y + i, x + j, (dy - y if i else 1 - dy + y) * (dx - x if j else 1 - dx + x)) for i in (0, 1) for j in (0, 1)]
        out += [(k, i, j, w) for i, j, w in corners if w > 0]
    return out


def grey_levels(pixels: DataFrame, value: str, levels: int, out: str = "level") -> DataFrame:
    """Levels 1 to levels - 1 by equal steps of a levels-th of the tile's range; the top one is twice as wide. A flat tile has level 1."""
    limits = pixels.groupBy("tile_id").agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    step = F.floor(F.try_divide(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo")) * levels)
    return pixels.join(limits, "tile_id").withColumn(out, (F.least(F.coalesce(step, F.lit(0)), F.lit(levels - 2)) + 1).cast("int")).drop("__lo", "__hi")


def cooccurrence(pixels: DataFrame, level: str, height: int, width: int, distance: int = 1, angle: float = 0, window: int = 3) -> DataFrame:
    """``(tile_id, y, x, i, j, p)``: the symmetric co-occurrence of levels in the window round each pixel, the edge repeated."""
    dy, dx, r = round(math.sin(angle) * distance), round(math.cos(angle) * distance), window // 2
    pairs = [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if abs(a + dy) <= r and abs(b + dx) <= r]
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs]))
    at = lambda i, j, n: [_inside(F.col("y") + F.col("o.a") + i, height).alias(f"y{n}"), _inside(F.col("x") + F.col("o.b") + j, width).alias(f"x{n}")]
    looks = pixels.select(*PIXEL, o.alias("o")).select(*PIXEL, *at(0, 0, 1), *at(dy, dx, 2))
    there = lambda n, name: pixels.select("tile_id", F.col("y").alias(f"y{n}"), F.col("x").alias(f"x{n}"), F.col(level).alias(name))
    both = looks.join(there(1, "i"), ["tile_id", "y1", "x1"]).join(there(2, "j"), ["tile_id", "y2", "x2"])
    # each pair counts in either order
    seen = both.select(*PIXEL, F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("c"))
    return seen.groupBy(*PIXEL, F.col("c.i").alias("i"), F.col("c.j").alias("j")).agg((F.count("*") / (2.0 * len(pairs))).alias("p"))


def texture_measures(cells: DataFrame) -> DataFrame:
    """Measures of each pixel's co-occurrence, by their published definitions: moments of the levels, of their sums and of their differences."""
    p, i, j = F.col("p"), F.col("i"), F.col("j")
    entropy = lambda c: -F.sum(c * F.ln(c))
    own = cells.groupBy(*PIXEL).agg(
        F.sum(p * (i - j) ** 2).alias("contrast"), F.sum(p * F.abs(i - j)).alias("dissimilarity"), F.sum(p / (1 + (i - j) ** 2)).alias("homogeneity"),
        F.sum(p * p).alias("asm"), entropy(p).alias("entropy"), F.sum(p * i).alias("__m"), F.sum(p * i * i).alias("__ii"), F.sum(p * i * j).alias("__ij"),
    )
    variance = F.col("__ii") - F.col("__m") ** 2
    own = own.select(
        *PIXEL, "contrast", "dissimilarity", "homogeneity", "asm", F.sqrt("asm").alias("energy"), "entropy", variance.alias("variance"),
        F.when(variance < 1e-12, 1.0).otherwise((F.col("__ij") - F.col("__m") ** 2) / variance).alias("correlation"),
    )

    def of(name: str, k: Column) -> DataFrame:
        q = cells.groupBy(*PIXEL, k.alias("k")).agg(F.sum("p").alias("q"))
        told = q.groupBy(*PIXEL).agg(F.sum(F.col("q") * F.col("k")).alias(f"{name}_average"), F.sum(F.col("q") * F.col("k") ** 2).alias("__kk"), entropy(F.col("q")).alias(f"{name}_entropy"))
        return told.withColumn(f"{name}_variance", F.col("__kk") - F.col(f"{name}_average") ** 2).drop("__kk")

    return own.join(of("sum", i + j), PIXEL).join(of("difference", F.abs(i - j)), PIXEL)


def gaussian(sigma: float) -> list[float]:
    """Weights of a Gaussian window from -4 sigma to 4 sigma, of sum 1."""
    r = int(4 * sigma)
    raw = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    return [w / math.fsum(raw) for w in raw]


def blur(pixels: DataFrame, keys: Sequence[str], values: Sequence[str], height: int, width: int, sigma: float = 1.5) -> DataFrame:
    """Each value's Gaussian mean, the edge reflected (d c b a | a b c d | d c b a); no join, one aggregate for each axis."""
    weights = gaussian(sigma)
    r = len(weights) // 2
    o = F.array(*[F.struct(F.lit(k - r).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(weights)])
    for axis, other, n in (("y", "x", height), ("x", "y", width)):
        # a pixel counts for all that reach it or one of its two mirror images
        images = F.explode(F.array(F.col(axis), -1 - F.col(axis), 2 * n - 1 - F.col(axis)).cast("array<long>"))
        spread = pixels.select(*keys, other, *values, images.alias("at")).select(*keys, other, *values, "at", F.explode(o).alias("o"))
        spread = spread.withColumn(axis, F.col("at") - F.col("o.k")).where((F.col(axis) >= 0) & (F.col(axis) < n))
        pixels = spread.groupBy(*keys, "y", "x").agg(*[F.sum(F.col("o.w") * F.col(v)).alias(v) for v in values])
    return pixels


def structural_similarity(frames: DataFrame, target: DataFrame, value: str, height: int, width: int, keys: Sequence[str] = ("tile_id",), frame: str = "ts", sigma: float = 1.5, c1: float = 1e-6, c2: float = 1e-5) -> DataFrame:
    """``(…keys, y, x, ssim_max, ssim_mean, ssim_std)``: how like the other frames of a tile are to its target frame.

    ``target`` has the target's pixels, with the value alone; pixels without a value in either frame don't count.
    """
    at = [*keys, "y", "x"]
    a, b = F.col("a"), F.col("b")
    pairs = frames.select(*at, frame, F.col(value).alias("a")).join(target.select(*at, F.col(value).alias("b")), at).where(a.isNotNull() & b.isNotNull())
    means = blur(pairs.select(*at, frame, a, b, (a * a).alias("aa"), (b * b).alias("bb"), (a * b).alias("ab")), [*keys, frame], ["a", "b", "aa", "bb", "ab"], height, width, sigma)
    va, vb, vab = F.col("aa") - a * a, F.col("bb") - b * b, F.col("ab") - a * b
    ssim = (2 * a * b + c1) * (2 * vab + c2) / ((a * a + b * b + c1) * (va + vb + c2))
    return means.withColumn("s", ssim).groupBy(*at).agg(F.max("s").alias("ssim_max"), F.avg("s").alias("ssim_mean"), F.stddev_pop("s").alias("ssim_std"))
