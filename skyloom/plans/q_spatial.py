"""Queries of neighbourhood operators on 8 x 8 tiles."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from skyloom.functions.algebra import ndi
from skyloom.operators import aggregates as G
from skyloom.operators import shadows as H
from skyloom.operators import spatial as N
from skyloom.plans.catalog import query
from skyloom.plans.standins import OBS, PIX, R6, obs, pix, r6

ON = "v > 0.1::DOUBLE"


def masked(spark, sf_dir):
    return pix(spark, sf_dir).withColumn("m", F.col("v") > 0.1)


_NEAR = "a.tile_id = b.tile_id AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= {}"


@query("n01_dilate", f"{PIX} SELECT a.tile_id, a.y, a.x, bool_or(b.v > 0.1::DOUBLE) AS dilated FROM pix a JOIN pix b ON {_NEAR.format(4)} GROUP BY ALL")
def _(spark, sf_dir):
    return N.dilate(masked(spark, sf_dir), "m", 2).select("tile_id", "y", "x", "dilated")


@query("n01_erode", f"{PIX} SELECT a.tile_id, a.y, a.x, bool_and(b.v > 0.1::DOUBLE) AS eroded FROM pix a JOIN pix b ON {_NEAR.format(1)} GROUP BY ALL")
def _(spark, sf_dir):
    return N.erode(masked(spark, sf_dir), "m", 1).select("tile_id", "y", "x", "eroded")


_REFLECT = "CASE WHEN {0} < 0 THEN -1 - {0} WHEN {0} > 7 THEN 15 - {0} ELSE {0} END"


@query("n02_disk_mean", f"{PIX}, o AS (SELECT dy, dx FROM range(-2, 3) r(dy), range(-2, 3) s(dx) WHERE dy * dy + dx * dx <= 4), l AS (SELECT tile_id, y, x, {_REFLECT.format('(y + dy)')} AS ny, {_REFLECT.format('(x + dx)')} AS nx FROM pix, o) SELECT l.tile_id, l.y, l.x, {R6('avg(b.v)')} AS smooth FROM l JOIN pix b ON l.tile_id = b.tile_id AND ny = b.y AND nx = b.x GROUP BY ALL")
def _(spark, sf_dir):
    return N.disk_mean(pix(spark, sf_dir), "v", 2, 8, 8).select("tile_id", "y", "x", r6("smooth").alias("smooth"))


@query("n03_block_resample", f"{PIX} SELECT tile_id, y, x, {R6('avg(v) OVER (PARTITION BY tile_id, y // 4, x // 4)')} AS coarse FROM pix")
def _(spark, sf_dir):
    rows = pix(spark, sf_dir)
    return N.from_blocks(rows, N.block(rows, 4, coarse=F.avg("v")), 4).select("tile_id", "y", "x", r6("coarse").alias("coarse"))


@query("n04_block_classifier", f"{PIX} SELECT tile_id, y, x, {R6('max(v) OVER w')} AS hi, {R6('min(v) OVER w')} AS lo FROM pix WINDOW w AS (PARTITION BY tile_id, y // 2, x // 2)")
def _(spark, sf_dir):
    rows = pix(spark, sf_dir)
    return N.from_blocks(rows, N.block(rows, 2, hi=F.max("v"), lo=F.min("v")), 2).select("tile_id", "y", "x", r6("hi").alias("hi"), r6("lo").alias("lo"))


@query("n05_large_components", f"{PIX.replace('WITH', 'WITH RECURSIVE', 1)}, o AS (SELECT tile_id, y, x FROM pix WHERE {ON}), r AS (SELECT tile_id, y, x, y AS y2, x AS x2 FROM o UNION SELECT r.tile_id, r.y, r.x, o.y, o.x FROM r JOIN o ON o.tile_id = r.tile_id AND abs(o.y - r.y2) <= 1 AND abs(o.x - r.x2) <= 1), s AS (SELECT tile_id, y, x, count(*) AS n FROM r GROUP BY ALL) SELECT pix.tile_id, pix.y, pix.x, coalesce(n, 0) > 5 AS large FROM pix LEFT JOIN s USING (tile_id, y, x)")
def _(spark, sf_dir):
    return N.large_components(masked(spark, sf_dir), "m", 5, 8, 8).select("tile_id", "y", "x", "large")


def _sobel_sql() -> str:
    mirror = "CASE WHEN {0} < 0 THEN -{0} WHEN {0} > 7 THEN 14 - {0} ELSE {0} END"
    return f"{PIX}, o AS (SELECT dy, dx, dx * (2 - abs(dy)) AS wx, dy * (2 - abs(dx)) AS wy FROM range(-1, 2) r(dy), range(-1, 2) s(dx)), l AS (SELECT tile_id, y, x, {mirror.format('(y + dy)')} AS ny, {mirror.format('(x + dx)')} AS nx, wx, wy FROM pix, o), g AS (SELECT l.tile_id, l.y, l.x, sum(wx * b.v) / 8 AS gx, sum(wy * b.v) / 8 AS gy FROM l JOIN pix b ON l.tile_id = b.tile_id AND ny = b.y AND nx = b.x GROUP BY ALL), a AS (SELECT *, atan(sqrt(gx * gx + gy * gy)) AS slope, CASE WHEN gx <> 0 THEN CASE WHEN atan2(gy, -gx) < 0 THEN atan2(gy, -gx) + 2 * pi() ELSE atan2(gy, -gx) END WHEN gy > 0 THEN pi() / 2 WHEN gy < 0 THEN 1.5 * pi() ELSE 0 END AS aspect FROM g)"


@query("n06_hillshade", f"{_sobel_sql()} SELECT tile_id, y, x, round(cos(radians(40)) * cos(slope) + sin(radians(40)) * sin(slope) * cos(radians(360 - 150 + 90) - aspect), 5) + 0.0::DOUBLE AS shade FROM a")
def _(spark, sf_dir):
    g = N.gradients(pix(spark, sf_dir), "v", 8, 8)
    shade = N.hillshade(F.col("gx"), F.col("gy"), 1.0, 1.0, F.lit(40.0), F.lit(150.0))
    return g.select("tile_id", "y", "x", (F.round(shade, 5) + F.lit(0.0)).alias("shade"))


@query("n07_water_mask", f"{PIX}, w AS (SELECT tile_id, y, x, coalesce((v - 0.05::DOUBLE) / nullif(v + 0.05::DOUBLE, 0) > 0.4::DOUBLE, false) AS w FROM pix) SELECT a.tile_id, a.y, a.x, bool_or(b.w) AS water FROM w a JOIN w b ON {_NEAR.format(4)} GROUP BY ALL")
def _(spark, sf_dir):
    rows = pix(spark, sf_dir).withColumn("w", F.coalesce(ndi(F.col("v"), F.lit(0.05)) > 0.4, F.lit(False)))
    return N.dilate(rows, "w", 2, "water").select("tile_id", "y", "x", "water")


@query("n08_shadow_candidates", f"{PIX}, t AS (SELECT tile_id, quantile_cont(v * v, 0.01) AS lo, quantile_cont(v * v, 0.99) AS hi FROM pix GROUP BY tile_id) SELECT tile_id, y, x, v * v < lo + (hi - lo) * 0.3::DOUBLE AND v < 0.1::DOUBLE AS candidate FROM pix JOIN t USING (tile_id)")
def _(spark, sf_dir):
    rows = pix(spark, sf_dir).withColumn("lum", F.col("v") * F.col("v"))
    q = rows.groupBy("tile_id").agg(F.percentile("lum", F.array(F.lit(0.01), F.lit(0.99))).alias("q"))
    point = F.col("q")[0] + (F.col("q")[1] - F.col("q")[0]) * 0.3
    return rows.join(q, "tile_id").select("tile_id", "y", "x", ((F.col("lum") < point) & (F.col("v") < 0.1)).alias("candidate"))


@query("n09_project_clouds", f"{PIX} SELECT DISTINCT tile_id, y - 1 AS y, x + 2 AS x FROM pix WHERE {ON} AND y >= 1 AND x <= 5")
def _(spark, sf_dir):
    return N.project(masked(spark, sf_dir), "m", F.lit(2.0), F.lit(1.0), F.lit(-0.5), 8, 8)


@query("n10_best_elevation", f"{PIX}, e AS (SELECT i AS e FROM range(0, 4) r(i)), m AS (SELECT DISTINCT tile_id, e, y, x + e AS x FROM pix, e WHERE {ON} AND x + e < 8), c AS (SELECT tile_id, y, x FROM pix WHERE v < -0.1::DOUBLE), n AS (SELECT tile_id, e, count(*) AS n, count(c.y) AS hit FROM m LEFT JOIN c USING (tile_id, y, x) GROUP BY ALL), k AS (SELECT tile_id, count(*) AS k FROM c GROUP BY tile_id) SELECT tile_id, arg_max(e, (round(hit / (n + coalesce(k, 0) - hit), 9), -e)) AS elevation FROM n LEFT JOIN k USING (tile_id) GROUP BY tile_id")
def _(spark, sf_dir):
    rows = masked(spark, sf_dir)
    tried = rows.withColumn("e", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    moved = N.project(tried, "m", F.col("e"), F.lit(1.0), F.lit(0.0), 8, 8, ["tile_id", "e"])
    dark = rows.where("v < -0.1D").select("tile_id", "y", "x", F.lit(1).alias("hit"))
    n = moved.join(dark, ["tile_id", "y", "x"], "left").groupBy("tile_id", "e").agg(F.count("*").alias("n"), F.count("hit").alias("hit"))
    k = dark.groupBy("tile_id").agg(F.count("*").alias("k"))
    score = F.round(F.col("hit") / (F.col("n") + F.coalesce("k", F.lit(0)) - F.col("hit")), 9)
    return n.join(k, "tile_id", "left").groupBy("tile_id").agg(F.max_by("e", F.struct(score, -F.col("e"))).alias("elevation"))


_SNOW = f"{OBS}, s AS (SELECT *, NOT (clp > 0.6::DOUBLE) AS clear, (NOT (clp > 0.6::DOUBLE)) AND (nir - swir) / nullif(nir + swir, 0) > 0.0 AND red > 0.02::DOUBLE AS snow, y * 100.0::DOUBLE + x AS dem FROM obs)"


def snowy(spark, sf_dir):
    rows = obs(spark, sf_dir).withColumn("clear", ~(F.col("clp") > 0.6)).withColumn("dem", F.col("y") * 100.0 + F.col("x"))
    return rows.withColumn("snow", F.coalesce(N.snow_first_pass(ndi("nir", "swir"), F.col("red"), ~F.col("clear"), 0.0, 0.02), F.lit(False)))


@query("n11_snow_first_pass", f"{_SNOW} SELECT oid, coalesce(snow, false) AS snow FROM s")
def _(spark, sf_dir):
    return snowy(spark, sf_dir).select("oid", "snow")


@query("n12_snow_by_elevation", f"{_SNOW} SELECT tile_id, scl, floor(dem / 200)::BIGINT AS bin, {R6('count(*) FILTER (snow AND clear) / nullif(count(*) FILTER (clear), 0)')} AS frac FROM s GROUP BY ALL")
def _(spark, sf_dir):
    share = F.try_divide(F.count_if(F.col("snow") & F.col("clear")), F.count_if("clear"))
    return snowy(spark, sf_dir).groupBy("tile_id", "scl", F.floor(F.col("dem") / 200).alias("bin")).agg(r6(share).alias("frac"))


@query("n13_snow_line", f"{_SNOW}, b AS (SELECT tile_id, scl, floor(dem / 200) AS bin, count(*) FILTER (snow AND clear) / nullif(count(*) FILTER (clear), 0) AS f, count(*) FILTER (snow) AS s, count(*) AS n FROM s GROUP BY ALL), l AS (SELECT tile_id, scl, min(bin) FILTER (f > 0.4::DOUBLE) AS first, sum(s) / sum(n) AS total, min(bin) AS low FROM b GROUP BY ALL) SELECT tile_id, scl, greatest(first - 2, low) * 200.0::DOUBLE AS line FROM l WHERE total > 0.05::DOUBLE AND first IS NOT NULL")
def _(spark, sf_dir):
    return N.snow_line(snowy(spark, sf_dir), "snow", "clear", "dem", 200.0, 0.4, 0.05, ["tile_id", "scl"])


@query("n13_snow_second_pass", f"{_SNOW}, b AS (SELECT tile_id, scl, floor(dem / 200) AS bin, count(*) FILTER (snow AND clear) / nullif(count(*) FILTER (clear), 0) AS f, count(*) FILTER (snow) AS s, count(*) AS n FROM s GROUP BY ALL), l AS (SELECT tile_id, scl, min(bin) FILTER (f > 0.4::DOUBLE) AS first, sum(s) / sum(n) AS total, min(bin) AS low FROM b GROUP BY ALL), z AS (SELECT tile_id, scl, greatest(first - 2, low) * 200.0::DOUBLE AS line FROM l WHERE total > 0.05::DOUBLE AND first IS NOT NULL) SELECT oid, coalesce(clear AND dem > line AND (nir - swir) / nullif(nir + swir, 0) > -0.2::DOUBLE AND red > 0.01::DOUBLE, false) AS snow2 FROM s LEFT JOIN z USING (tile_id, scl)")
def _(spark, sf_dir):
    rows, frame = snowy(spark, sf_dir), ["tile_id", "scl"]
    lines = N.snow_line(rows, "snow", "clear", "dem", 200.0, 0.4, 0.05, frame)
    return N.snow_second_pass(rows, lines, "dem", ndi("nir", "swir"), F.col("red"), ~F.col("clear"), -0.2, 0.01, frame).select("oid", "snow2")


@query("n13_refined_cloud", f"{_SNOW} SELECT oid, (NOT clear AND round(avg(red) OVER (PARTITION BY tile_id, scl, y // 4, x // 4), 9) > 0.04::DOUBLE) OR blue > 0.09::DOUBLE + 5e-6::DOUBLE * dem AS cloud FROM s")
def _(spark, sf_dir):
    rows = snowy(spark, sf_dir).withColumn("by", F.expr("y div 4")).withColumn("bx", F.expr("x div 4"))
    coarse = rows.groupBy("tile_id", "scl", "by", "bx").agg(F.round(F.avg("red"), 9).alias("coarse"))
    cloud = N.refined_cloud(~F.col("clear"), F.col("coarse"), F.col("dem"), F.col("blue"), 0.04, 0.09)
    return rows.join(coarse, ["tile_id", "scl", "by", "bx"]).select("oid", cloud.alias("cloud"))


_IN8 = "greatest(0, least(7, {}))"
_TEXTURE = f"""{PIX}, m AS (SELECT tile_id, min(v) AS lo, max(v) AS hi FROM pix GROUP BY tile_id),
g AS (SELECT tile_id, y, x, least(coalesce(floor((v - lo) / nullif(hi - lo, 0) * 4), 0), 2)::INT + 1 AS g FROM pix JOIN m USING (tile_id)),
c AS (SELECT g.tile_id, g.y, g.x, {_IN8.format('g.y + a')} AS y1, {_IN8.format('g.x + b')} AS x1, {_IN8.format('g.x + b + 1')} AS x2 FROM g, range(-1, 2) r(a), range(-1, 1) s(b)),
q AS (SELECT c.tile_id, c.y, c.x, k.g AS i, l.g AS j FROM c JOIN g k ON k.tile_id = c.tile_id AND k.y = y1 AND k.x = x1 JOIN g l ON l.tile_id = c.tile_id AND l.y = y1 AND l.x = x2),
p AS (SELECT tile_id, y, x, i, j, count(*) / 12.0::DOUBLE AS p FROM (SELECT tile_id, y, x, i, j FROM q UNION ALL SELECT tile_id, y, x, j, i FROM q) GROUP BY ALL),
d AS (SELECT tile_id, y, x, abs(i - j) AS k, sum(p) AS q FROM p GROUP BY ALL), e AS (SELECT tile_id, y, x, sum(q * k * k) - sum(q * k) ** 2 AS dv FROM d GROUP BY ALL)"""
_MEASURES = {"contrast": "sum(p * (i - j) * (i - j))", "homogeneity": "sum(p / (1 + (i - j) * (i - j)))", "asm": "sum(p * p)", "entropy": "-sum(p * ln(p))", "variance": "sum(p * i * i) - sum(p * i) ** 2", "sum_average": "sum(p * (i + j))"}


@query("n14_texture", f"{_TEXTURE} SELECT tile_id, y, x, {', '.join(f'{R6(e)} AS {n}' for n, e in _MEASURES.items())}, {R6('any_value(dv)')} AS difference_variance FROM p JOIN e USING (tile_id, y, x) GROUP BY ALL")
def _(spark, sf_dir):
    cells = N.cooccurrence(N.grey_levels(pix(spark, sf_dir), "v", 4), "level", 8, 8)
    return N.texture_measures(cells).select("tile_id", "y", "x", *[r6(c).alias(c) for c in (*_MEASURES, "difference_variance")])


_CIRCLE = ", ".join(f"({k}, {dy}, {dx}, {w!r}::DOUBLE)" for k, dy, dx, w in N.circle(8, 1))


@query("n15_local_binary_pattern", f"""{PIX}, o AS (SELECT * FROM (VALUES {_CIRCLE}) t(k, dy, dx, w)),
l AS (SELECT tile_id, y, x, v AS c, k, w, {_IN8.format('y + dy')} AS ny, {_IN8.format('x + dx')} AS nx FROM pix, o),
b AS (SELECT l.tile_id, l.y, l.x, l.k, (sum(w * pix.v) >= any_value(c) - 1e-9)::INT AS bit FROM l JOIN pix ON pix.tile_id = l.tile_id AND pix.y = ny AND pix.x = nx GROUP BY ALL),
s AS (SELECT tile_id, y, x, list(bit ORDER BY k) AS s FROM b GROUP BY ALL)
SELECT tile_id, y, x, (CASE WHEN list_sum(list_transform(range(8), lambda i: abs(s[i + 1] - s[(i + 7) % 8 + 1]))) <= 2 THEN list_sum(s) ELSE 9 END)::INT AS lbp FROM s""")
def _(spark, sf_dir):
    return N.local_binary_pattern(pix(spark, sf_dir), "v", 8, 8).select("tile_id", "y", "x", F.col("lbp").cast("int").alias("lbp"))


@query("n16_oriented_gradients", f"{_sobel_sql()}, h AS (SELECT tile_id, y // 4 AS cy, x // 4 AS cx, (floor(round(degrees(atan2(gy, gx)) + 360, 6) / 20)::BIGINT % 9) AS bin, sqrt(gx * gx + gy * gy) AS mag FROM g) SELECT tile_id, cy, cx, bin, round(sum(mag), 5) + 0.0::DOUBLE AS magnitude FROM h GROUP BY ALL")
def _(spark, sf_dir):
    g = N.gradients(pix(spark, sf_dir), "v", 8, 8).withColumn("gx", F.col("gx") / 8).withColumn("gy", F.col("gy") / 8)
    bins = F.floor(F.round(F.degrees(F.atan2("gy", "gx")) + 360, 6) / 20) % 9
    cells = g.groupBy("tile_id", F.expr("y div 4").alias("cy"), F.expr("x div 4").alias("cx"), bins.alias("bin")).agg(F.sum(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))).alias("m"))
    return cells.select("tile_id", "cy", "cx", "bin", (F.round("m", 5) + F.lit(0.0)).alias("magnitude"))


@query("n17_segment_boundaries", f"{PIX} SELECT a.tile_id, a.y, a.x, bool_or((a.v > 0.1::DOUBLE) <> (b.v > 0.1::DOUBLE)) AS boundary FROM pix a JOIN pix b ON a.tile_id = b.tile_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY ALL")
def _(spark, sf_dir):
    return N.boundaries(masked(spark, sf_dir).withColumn("m", F.col("m").cast("int")), "m").select("tile_id", "y", "x", "boundary")


_MEAN = ", ".join(f"sum(w * {c}) AS {c}" for c in ("a", "b", "aa", "bb", "ab"))
_KERNEL = ", ".join(f"({k - 6}, {w!r}::DOUBLE)" for k, w in enumerate(N.gaussian(1.5)))
_SSIM = f"""{PIX}, f AS (SELECT label, min(tile_id) AS target FROM pix GROUP BY label), o AS (SELECT * FROM (VALUES {_KERNEL}) t(k, w)),
q AS (SELECT p.label, p.tile_id AS frame, p.y, p.x, p.v AS a, t.v AS b, p.v * p.v AS aa, t.v * t.v AS bb, p.v * t.v AS ab FROM pix p JOIN f ON f.label = p.label AND p.tile_id <> f.target JOIN pix t ON t.tile_id = f.target AND t.y = p.y AND t.x = p.x),
ly AS (SELECT label, frame, y, x, w, {_REFLECT.format('(y + k)')} AS n FROM q, o), ry AS (SELECT l.label, l.frame, l.y, l.x, {_MEAN} FROM ly l JOIN q ON q.frame = l.frame AND q.y = n AND q.x = l.x GROUP BY ALL),
lx AS (SELECT label, frame, y, x, w, {_REFLECT.format('(x + k)')} AS n FROM ry, o), rx AS (SELECT l.label, l.frame, l.y, l.x, {_MEAN} FROM lx l JOIN ry q ON q.frame = l.frame AND q.x = n AND q.y = l.y GROUP BY ALL),
s AS (SELECT label, y, x, (2 * a * b + 1e-6) * (2 * (ab - a * b) + 1e-5) / ((a * a + b * b + 1e-6) * (aa - a * a + bb - b * b + 1e-5)) AS s FROM rx)
SELECT label, y, x, round(max(s), 5) + 0.0 AS ssim_max, round(avg(s), 5) + 0.0 AS ssim_mean, round(stddev_pop(s), 5) + 0.0 AS ssim_std FROM s GROUP BY ALL"""


@query("n18_structural_similarity", _SSIM)
def _(spark, sf_dir):
    rows = pix(spark, sf_dir)
    first = rows.groupBy("label").agg(F.min("tile_id").alias("target"))
    marked = rows.join(first, "label")
    found = N.structural_similarity(marked.where("tile_id <> target"), marked.where("tile_id = target"), "v", 8, 8, ["label"], "tile_id")
    return found.select("label", "y", "x", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("ssim_max", "ssim_mean", "ssim_std")])


@query("n19_class_erosion", f"{PIX}, c AS (SELECT tile_id, y, x, (CASE WHEN v > 0.1::DOUBLE THEN 2 ELSE 1 END) AS cls FROM pix) SELECT a.tile_id, a.y, a.x, (CASE WHEN min(b.cls) = max(b.cls) THEN any_value(a.cls) ELSE 0 END)::INT AS eroded FROM c a JOIN c b ON {_NEAR.format(1)} GROUP BY ALL")
def _(spark, sf_dir):
    rows = pix(spark, sf_dir).withColumn("cls", F.when(F.col("v") > 0.1, 2).otherwise(1))
    return N.erode_classes(rows, "cls", 1).select("tile_id", "y", "x", "eroded")


@query("n20_edge_mask", f"{PIX} SELECT tile_id, y, x, (x < 2 OR y >= 5) AS edge FROM pix")
def _(spark, sf_dir):
    return pix(spark, sf_dir).select("tile_id", "y", "x", N.edge_mask(F.col("y"), F.col("x"), 3, 2, 8, 8).alias("edge"))


# ---- clouds and their shadows: the vectors as frames of 10 m pixels, with masks and angles of each pixel

_SCENE = {
    "b2": "v * 0.5 + 0.1", "b3": "v * v",
    "valid": "(tile_id + y * 8 + x) % 11 <> 0", "cloud": "v > 0.12", "shade": "(tile_id + 2 * y + x) % 13 = 0", "water": "abs(v) < 0.02",
    "sun_zenith": "30.0 + tile_id % 20 + x * 0.1", "sun_azimuth": "140.0 + tile_id % 40 + y * 0.2", "view_zenith": "5.0 + tile_id % 6", "view_azimuth": "100.0 + tile_id % 90 + x * 0.3",
}


def scene(spark, sf_dir):
    return pix(spark, sf_dir).selectExpr("*", *[re.sub(r"([0-9]+[.][0-9]+)", r"\1D", e) + f" AS {n}" for n, e in _SCENE.items()])


_SCENE_SQL = PIX.replace("WITH", "WITH RECURSIVE", 1) + ", sc AS (SELECT *, " + ", ".join(re.sub(r"([0-9]+[.][0-9]+)", r"\1::DOUBLE", e) + f" AS {n}" for n, e in _SCENE.items()) + " FROM pix)"
_CANDIDATE_SQL = f"""{_SCENE_SQL}, lum AS (SELECT *, sqrt((v * v + b2 * b2 + b3 * b3) / 3) AS lum FROM sc),
q AS (SELECT tile_id, quantile_cont(lum, 0.01) FILTER (valid AND NOT cloud) AS lo, quantile_cont(lum, 0.99) FILTER (valid AND NOT cloud) AS hi FROM lum GROUP BY tile_id),
o AS (SELECT tile_id, y, x FROM lum JOIN q USING (tile_id) WHERE lum < lo + (hi - lo) * 0.4::DOUBLE AND valid AND NOT cloud AND NOT water AND NOT shade),
r AS (SELECT tile_id, y, x, y AS y2, x AS x2 FROM o UNION SELECT r.tile_id, r.y, r.x, o.y, o.x FROM r JOIN o ON o.tile_id = r.tile_id AND abs(o.y - r.y2) <= 1 AND abs(o.x - r.x2) <= 1),
c AS (SELECT tile_id, y, x FROM r GROUP BY ALL HAVING count(*) > 3)"""


def candidates(spark, sf_dir):
    return H.shadow_candidates(scene(spark, sf_dir), ["v", "b2", "b3"], 0.4, 3, 8, 8)


@query("n08_masked_shadow_candidates", f"{_CANDIDATE_SQL} SELECT sc.tile_id, sc.y, sc.x, c.tile_id IS NOT NULL AS candidate FROM sc LEFT JOIN c USING (tile_id, y, x)")
def _(spark, sf_dir):
    return candidates(spark, sf_dir).select("tile_id", "y", "x", "candidate")


_SHIFT_SQL = """a AS (SELECT tile_id, avg(radians(sun_zenith)) AS sz, avg(radians(sun_azimuth)) AS sa, avg(radians(view_zenith)) AS vz, avg(radians(view_azimuth)) AS va FROM sc WHERE cloud AND valid AND NOT shade GROUP BY tile_id),
sh AS (SELECT tile_id, tan(sz) * sin(sa) - tan(vz) * sin(va) AS east, tan(vz) * cos(va) + tan(sz) * cos(sa) AS north FROM a)"""
_PROJECT_SQL = f"""{_SHIFT_SQL}, m AS (SELECT DISTINCT tile_id, elevation, trunc(round_even((y * 10.0::DOUBLE + elevation * north) / 10, 0) * 10 / 10.0::DOUBLE)::BIGINT AS y, trunc(round_even((x * 10.0::DOUBLE - elevation * east) / 10, 0) * 10 / 10.0::DOUBLE)::BIGINT AS x
FROM (SELECT tile_id, y, x FROM sc WHERE cloud AND valid AND NOT shade) JOIN sh USING (tile_id), (SELECT unnest([0, 15, 30, 45, 60, 75]) AS elevation)),
p AS (SELECT m.* FROM m JOIN sc USING (tile_id, y, x) WHERE sc.valid AND NOT sc.cloud)"""
_HEIGHTS = "array(0, 15, 30, 45, 60, 75)"


@query("n09_clouds_by_angles", f"{_SCENE_SQL}, {_PROJECT_SQL} SELECT tile_id, elevation, y, x FROM p")
def _(spark, sf_dir):
    return H.project_clouds(scene(spark, sf_dir), F.expr(_HEIGHTS), 10.0, 10.0, 8, 8)


@query("n09_projection_offsets", f"{_SCENE_SQL}, {_SHIFT_SQL} SELECT tile_id, trunc(round_even(-45 * north / 10, 0) * 10 / 10.0::DOUBLE)::BIGINT AS rows_off, trunc(round_even(-45 * east / 10, 0) * 10 / 10.0::DOUBLE)::BIGINT AS cols_off FROM sh")
def _(spark, sf_dir):
    rows, cols = H.shift_in_pixels(F.lit(45), 10.0, 10.0)
    return H.frame_shift(scene(spark, sf_dir)).select("tile_id", rows.alias("rows_off"), cols.alias("cols_off"))


@query("n10_shadow_height", f"""{_CANDIDATE_SQL}, {_PROJECT_SQL}, n AS (SELECT p.tile_id, elevation, count(*) AS n, count(c.tile_id) AS hit FROM p LEFT JOIN c USING (tile_id, y, x) GROUP BY ALL), k AS (SELECT tile_id, count(*) AS k FROM c GROUP BY tile_id),
w AS (SELECT tile_id, elevation, round(hit / (n + coalesce(k, 0) - hit), 9) AS agreement FROM n LEFT JOIN k USING (tile_id))
SELECT tile_id, elevation, {R6('agreement')} AS agreement FROM w QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY agreement DESC, elevation) = 1""")
def _(spark, sf_dir):
    """The height in metres whose projected clouds fit the dark pixels best, frame by frame."""
    dark = candidates(spark, sf_dir)
    shadows = H.project_clouds(scene(spark, sf_dir), F.expr(_HEIGHTS), 10.0, 10.0, 8, 8)
    return H.best_elevation(dark, shadows).select("tile_id", "elevation", r6("agreement").alias("agreement"))


_ALL_DIRECTIONS = ", ".join(f"sum(CASE WHEN angle = {k} THEN size ELSE 0 END) / 4" for k in range(9))
_ORIENTED = f"""{PIX}, g AS (SELECT a.tile_id, a.y, a.x, CASE WHEN a.y > 0 AND a.y < 7 THEN sum(b.v * (b.y - a.y)) ELSE 0 END AS gr, CASE WHEN a.x > 0 AND a.x < 7 THEN sum(b.v * (b.x - a.x)) ELSE 0 END AS gc FROM pix a JOIN pix b ON a.tile_id = b.tile_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY a.tile_id, a.y, a.x),
d AS (SELECT *, round(degrees(atan2(gr, gc)), 9) AS deg, sqrt(gr * gr + gc * gc) AS size FROM g),
h AS (SELECT tile_id, y // 2 AS cy, x // 2 AS cx, size, floor((CASE WHEN deg < 0 THEN deg + 180 WHEN deg >= 180 THEN deg - 180 ELSE deg END) * 9 / 180)::INT AS angle FROM d),
c AS (SELECT tile_id, cy, cx, [{_ALL_DIRECTIONS}] AS h FROM h GROUP BY ALL),
k AS (SELECT tile_id, p, q, cy - p AS i, cx - q AS j, unnest(h) AS v, generate_subscripts(h, 1) - 1 AS angle FROM c, range(0, 2) r(p), range(0, 2) s(q) WHERE cy BETWEEN p AND p + 2 AND cx BETWEEN q AND q + 2),
u AS (SELECT *, least(v / sqrt(sum(v * v) OVER (PARTITION BY tile_id, p, q) + 1e-10::DOUBLE), 0.2::DOUBLE) AS w FROM k)
SELECT tile_id, (p * 3 + i)::INT AS row, (q * 3 + j)::INT AS col, angle::INT AS angle, round(w / sqrt(sum(w * w) OVER (PARTITION BY tile_id, p, q) + 1e-10::DOUBLE), 5) + 0.0::DOUBLE AS value FROM u"""


@query("n16_normalised_gradients", _ORIENTED)
def _(spark, sf_dir):
    found = N.oriented_gradients(pix(spark, sf_dir), "v", 8, 8, cell=2)
    return found.select("tile_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "angle", (F.round("value", 5) + F.lit(0.0)).alias("value"))


_SMOOTH = "{0} AS (SELECT l.tile_id, l.y, l.x, round(avg(b.{1}), 9) >= {2}::DOUBLE AS over FROM l JOIN w b ON l.tile_id = b.tile_id AND ny = b.y AND nx = b.x GROUP BY ALL), {0}d AS (SELECT a.tile_id, a.y, a.x, bool_or(b.over) AS m FROM {0} a JOIN {0} b ON " + _NEAR.format(1) + " GROUP BY ALL)"


@query("w32_smoothed_dilated_verdict", f"""{PIX}, w AS (SELECT tile_id, y, x, v + 0.5::DOUBLE AS mono, abs(v) * 2 AS multi, (tile_id + x) % 7 <> 0 AS has_data FROM pix),
l AS (SELECT tile_id, y, x, {_REFLECT.format('(y + dy)')} AS ny, {_REFLECT.format('(x + dx)')} AS nx FROM w, (SELECT dy, dx FROM range(-1, 2) r(dy), range(-1, 2) s(dx) WHERE abs(dy) + abs(dx) <= 1)),
{_SMOOTH.format('mo', 'mono', 0.56)}, {_SMOOTH.format('mu', 'multi', 0.22)}, i AS (SELECT mod.tile_id, mod.y, mod.x, mod.m AND mud.m AS m FROM mod JOIN mud USING (tile_id, y, x)),
g AS (SELECT a.tile_id, a.y, a.x, bool_or(b.m) AS m FROM i a JOIN i b ON {_NEAR.format(1)} GROUP BY ALL)
SELECT w.tile_id, w.y, w.x, mod.m AND has_data AS mono_cloud, mud.m AND has_data AS multi_cloud, g.m AND has_data AS cloud FROM w JOIN mod USING (tile_id, y, x) JOIN mud USING (tile_id, y, x) JOIN g USING (tile_id, y, x)""")
def _(spark, sf_dir):
    rows = pix(spark, sf_dir).select("tile_id", "y", "x", (F.col("v") + 0.5).alias("mono"), (F.abs("v") * 2).alias("multi"), ((F.col("tile_id") + F.col("x")) % 7 != 0).alias("has_data"))
    return H.combined_verdict(rows, "mono", "multi", "has_data", (0.56, 0.22), 1, 1, 8, 8).select("tile_id", "y", "x", "mono_cloud", "multi_cloud", "cloud")
