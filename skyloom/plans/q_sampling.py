"""Queries of set operations, tiling, sampling, splits and models."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.operators import sampling as A
from skyloom.plans.catalog import load, query
from skyloom.plans.q_joins import _POINTS, points
from skyloom.plans.standins import OBS, PIX, R6, SER, obs, pix, r6, ser

M = A.MODULUS


def _draw_sql(seed: int, *keys: str) -> str:
    h = f"{seed}::BIGINT"
    for k in keys:
        h = f"((({h} * 31 + ({k}) % {M} * 7919 + 104729) % {M}) * 1009 % {M})"
    return f"({h} / {M}::DOUBLE)"


def _fold_sql(bins, r: str) -> str:
    return "(" + " + ".join(f"({r} >= {b}::DOUBLE)::INT" for b in bins) + " + 1)::INT"


# ---- set operations


@query("t01_union_of_samples", "SELECT event_id FROM events WHERE event_type = 'view' AND value > 100 UNION ALL SELECT event_id FROM events WHERE event_type = 'purchase'")
def _(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.where("event_type = 'view' AND value > 100").select("event_id").unionByName(e.where("event_type = 'purchase'").select("event_id"))


@query("t02_temporal_concatenation", f"{OBS} SELECT tile_id, ts, count(*) AS n, count(*) FILTER (part = 'late') AS late FROM (SELECT tile_id, ts, NULL AS part FROM obs WHERE year(ts) < 1998 UNION ALL SELECT tile_id, ts, 'late' FROM obs WHERE year(ts) >= 1998) GROUP BY ALL")
def _(spark, sf_dir):
    rows = obs(spark, sf_dir).select("tile_id", "ts")
    both = rows.where(F.year("ts") < 1998).unionByName(rows.where(F.year("ts") >= 1998).withColumn("part", F.lit("late")), allowMissingColumns=True)
    return both.groupBy("tile_id", "ts").agg(F.count("*").alias("n"), F.count("part").alias("late"))


@query("t03_common_dates", "SELECT strftime(d, '%Y-%m-%d') AS day FROM (SELECT DISTINCT ts::DATE AS d FROM events WHERE user_id % 2 = 0 AND event_type = 'purchase' INTERSECT SELECT DISTINCT ts::DATE FROM events WHERE user_id % 2 = 1 AND event_type = 'error')")
def _(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    days = lambda where: e.where(where).select(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return days("user_id % 2 = 0 AND event_type = 'purchase'").intersect(days("user_id % 2 = 1 AND event_type = 'error'"))


@query("t04_classes_in_both_parts", "WITH s AS (SELECT p_partkey, p_size AS label, p_partkey % 3 = 0 AS test FROM part WHERE p_retailprice IS NOT NULL) SELECT p_partkey, test FROM s WHERE label IN (SELECT label FROM s WHERE test) AND label IN (SELECT label FROM s WHERE NOT test)")
def _(spark, sf_dir):
    rows = load(spark, sf_dir, "part").dropna(subset=["p_retailprice"]).select("p_partkey", F.col("p_size").alias("label"), (F.col("p_partkey") % 3 == 0).alias("test"))
    both = rows.groupBy("label").agg(F.bool_or("test").alias("a"), F.bool_or(~F.col("test")).alias("b")).where("a AND b").select("label")
    return rows.join(both, "label", "left_semi").select("p_partkey", "test")


@query("t05_drop_repeated_attributes", "SELECT min(o_orderkey) AS o_orderkey, o_custkey, o_orderstatus FROM orders WHERE year(o_orderdate) = 1997 GROUP BY o_custkey, o_orderstatus")
def _(spark, sf_dir):
    return load(spark, sf_dir, "orders").where(F.year("o_orderdate") == 1997).groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderkey").alias("o_orderkey"))


@query("t06_priority_mosaic", f"{OBS} SELECT tile_id, y, x, {R6('arg_max(nir, (scl, ts, oid)) FILTER (valid)')} AS nir FROM obs GROUP BY ALL HAVING bool_or(valid)")
def _(spark, sf_dir):
    return obs(spark, sf_dir).where("valid").groupBy("tile_id", "y", "x").agg(r6(F.max_by("nir", F.struct("scl", "ts", "oid"))).alias("nir"))


@query("t07_fill_in_merge", f"{PIX} SELECT a.tile_id, a.y, a.x, {R6('coalesce(CASE WHEN b.v > 0 THEN b.v END, a.v)')} AS v FROM pix a LEFT JOIN pix b ON b.tile_id = a.tile_id + 1 AND a.y = b.y AND a.x = b.x")
def _(spark, sf_dir):
    old = pix(spark, sf_dir)
    new = old.where("v > 0").select((F.col("tile_id") - 1).alias("tile_id"), "y", "x", F.col("v").alias("new"))
    return old.join(new, ["tile_id", "y", "x"], "left").select("tile_id", "y", "x", r6(F.coalesce("new", "v")).alias("v"))


@query("t08_without_ignored_classes", f"{SER} SELECT DISTINCT class FROM ser WHERE class NOT IN ('error', 'view')")
def _(spark, sf_dir):
    ignored = spark.createDataFrame([("error",), ("view",)], "class string")
    return ser(spark, sf_dir).select("class").distinct().join(F.broadcast(ignored), "class", "left_anti")


# ---- tiling and sampling


@query("g01_split_area", "SELECT n_nationkey, ix::INT AS index_x, iy::INT AS index_y, " + R6("n_nationkey * 100 + ix * 25") + " AS min_x, " + R6("iy * 20") + " AS min_y FROM nation, range(4) a(ix), range(3) b(iy)")
def _(spark, sf_dir):
    area = load(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 100.0).alias("min_x"), F.lit(0.0).alias("min_y"), (F.col("n_nationkey") * 100.0 + 100).alias("max_x"), F.lit(60.0).alias("max_y"))
    return A.split_box(area, 4, 3).select("n_nationkey", "index_x", "index_y", r6("min_x").alias("min_x"), r6("min_y").alias("min_y"))


@query("g02_metric_grid", "WITH b AS (SELECT s_suppkey, s_acctbal AS lo, s_acctbal + 700 AS hi FROM supplier) SELECT DISTINCT ix::BIGINT AS index_x, (s_suppkey % 5)::BIGINT AS index_y FROM b, generate_series(-10, 40) g(ix) WHERE ix BETWEEN floor(lo / 500) AND floor(hi / 500)")
def _(spark, sf_dir):
    area = load(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("min_x"), (F.col("s_suppkey") % 5 * 500.0 + 10).alias("min_y"), (F.col("s_acctbal") + 700).alias("max_x"), (F.col("s_suppkey") % 5 * 500.0 + 20).alias("max_y"))
    return A.grid_tiles(area, 500.0).select("index_x", "index_y")


@query("g02_utm_zone", "SELECT c_custkey, (floor(((c_custkey % 360 - 180) + 180) / 6) + 1)::INT AS zone FROM customer")
def _(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", A.utm_zone(F.col("c_custkey") % 360 - 180).alias("zone"))


@query("g03_grid_from_pixel_count", "SELECT n_nationkey, ceil((n_nationkey + 1) * 1000 / (256 * 10.0))::INT AS nx, ceil(5000 / (256 * 10.0))::INT AS ny FROM nation")
def _(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    return n.select("n_nationkey", F.ceil((F.col("n_nationkey") + 1) * 1000 / (256 * 10.0)).cast("int").alias("nx"), F.ceil(F.lit(5000) / (256 * 10.0)).cast("int").alias("ny"))


@query("g04_subgrid_per_pixel", "SELECT count(*) AS n, max(s_suppkey * 4 + i) AS last FROM supplier, range(4) r(i)")
def _(spark, sf_dir):
    area = load(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("min_x"), F.lit(0.0).alias("min_y"), (F.col("s_acctbal") + 46).alias("max_x"), F.lit(46.0).alias("max_y"))
    sub = A.split_box(area, 2, 2).withColumn("i", F.col("index_y") * 2 + F.col("index_x"))
    return sub.agg(F.count("*").alias("n"), F.max(F.col("s_suppkey") * 4 + F.col("i")).alias("last"))


@query("g05_split_by_columns", f"{OBS}, t AS (SELECT DISTINCT tile_id % 5 AS index_x, tile_id // 5 AS index_y FROM obs), c AS (SELECT index_x, count(*) AS n FROM t GROUP BY 1), s AS (SELECT index_x, coalesce(sum(n) OVER (ORDER BY index_x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER () AS s FROM c) SELECT index_x, index_y, CASE WHEN s < 0.6 - 1e-9 THEN 'train' WHEN s < 0.8 - 1e-9 THEN 'val' ELSE 'test' END AS part FROM t JOIN s USING (index_x)")
def _(spark, sf_dir):
    tiles = obs(spark, sf_dir).selectExpr("tile_id % 5 AS index_x", "tile_id div 5 AS index_y").distinct()
    return A.split_columns(tiles, "index_x", [("train", 0.6), ("val", 0.2), ("test", 0.2)])


BINS = [0.2, 0.5, 0.8]
for _name, _keys, _ignored in (("g06_fold_per_pixel", ["tile_id", "y", "x"], False), ("g07_fold_per_class", ["tile_id", "scl"], True), ("g08_fold_per_value", ["scl"], False)):
    _f = _fold_sql(BINS, _draw_sql(7, *_keys))

    @query(_name, f"{OBS} SELECT oid, {f'(CASE WHEN scl = 7 THEN 0 ELSE {_f} END)::INT' if _ignored else _f} AS fold FROM obs")
    def _(spark, sf_dir, keys=_keys, ignored=_ignored):
        return A.split_folds(obs(spark, sf_dir), BINS, keys, 7, F.col("scl") == 7 if ignored else None).select("oid", "fold")


@query("g10_balanced_sample", f"{OBS} SELECT scl, oid FROM obs QUALIFY row_number() OVER (PARTITION BY scl ORDER BY {_draw_sql(7, 'oid')}, oid) <= 40")
def _(spark, sf_dir):
    return A.sample_per_class(obs(spark, sf_dir), ["scl"], 40, ["oid"]).select("scl", "oid")


@query("g11_even_sample_of_large_classes", f"{OBS}, b AS (SELECT tile_id, scl FROM obs GROUP BY ALL HAVING count(*) > 300) SELECT tile_id, scl, oid FROM obs JOIN b USING (tile_id, scl) QUALIFY row_number() OVER (PARTITION BY tile_id, scl ORDER BY {_draw_sql(7, 'oid')}, oid) <= 10")
def _(spark, sf_dir):
    return A.sample_even(obs(spark, sf_dir), "tile_id", "scl", 300, 10, ["oid"]).select("tile_id", "scl", "oid")


@query("g12_same_pixels_for_all_features", f"{OBS}, p AS (SELECT * FROM (SELECT DISTINCT tile_id, y, x FROM obs) QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY {_draw_sql(7, 'tile_id', 'y', 'x')}, tile_id, y, x) <= 5) SELECT oid FROM obs JOIN p USING (tile_id, y, x)")
def _(spark, sf_dir):
    return A.sample_pixels(obs(spark, sf_dir), 5).select("oid")


@query("g13_every_kth_tile", "SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) % 4 = 1 AS test FROM embeddings")
def _(spark, sf_dir):
    return A.every_kth(load(spark, sf_dir, "embeddings").select("vec_id", "label"), 4, ["vec_id"], ["label"]).select("vec_id", "test")


@query("g14_random_split", f"SELECT event_id, {_draw_sql(11, 'event_id')} < 0.25 AS test FROM events")
def _(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", (A.draw(11, "event_id") < 0.25).alias("test"))


@query("g15_split_within_class", f"WITH d AS (SELECT vec_id, (row_number() OVER (PARTITION BY label ORDER BY {_draw_sql(7, 'vec_id')}, vec_id) - 1) / count(*) OVER (PARTITION BY label) AS p FROM embeddings) SELECT vec_id, CASE WHEN p < 0.7 - 1e-9 THEN 'train' WHEN p < 0.9 - 1e-9 THEN 'val' ELSE 'test' END AS part FROM d")
def _(spark, sf_dir):
    parts = [("train", 0.7), ("val", 0.2), ("test", 0.1)]
    return A.split_by_share(load(spark, sf_dir, "embeddings").select("vec_id", "label"), ["label"], parts, ["vec_id"]).select("vec_id", "part")


@query("g16_leak_free_groups", """WITH RECURSIVE p AS (SELECT c_custkey AS id, c_acctbal AS x, (c_custkey * 37 % 9000)::DOUBLE AS y FROM customer),
e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON abs(a.x - b.x) <= 300 AND abs(a.y - b.y) <= 300 WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 90000),
r AS (SELECT id, id AS other FROM p UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other) SELECT id, min(other) AS grp FROM r GROUP BY id""")
def _(spark, sf_dir):
    return A.distance_groups(points(spark, sf_dir), "id", "x", "y", 300.0).withColumnRenamed("group", "grp")


@query("g17_balanced_by_fraction", f"{PIX}, f AS (SELECT tile_id, avg((v > 0)::INT) AS frac FROM pix GROUP BY tile_id) SELECT tile_id, least(floor(frac * 5) + 1, 5)::BIGINT AS bin FROM f QUALIFY row_number() OVER (PARTITION BY bin ORDER BY {_draw_sql(7, 'tile_id')}, tile_id) <= 8")
def _(spark, sf_dir):
    frac = pix(spark, sf_dir).groupBy("tile_id").agg(F.avg((F.col("v") > 0).cast("int")).alias("frac"))
    binned = frac.withColumn("bin", F.least(F.width_bucket("frac", F.lit(0.0), F.lit(1.0), F.lit(5)), F.lit(5).cast("long")))
    return A.sample_per_class(binned, ["bin"], 8, ["tile_id"]).select("tile_id", "bin")


@query("g18_series_as_feature_row", f"{SER} SELECT px, len(s) AS n, {R6('s[1]')} AS first, {R6('s[len(s)]')} AS last FROM (SELECT px, list(v ORDER BY ts, oid) AS s FROM ser GROUP BY px)")
def _(spark, sf_dir):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ts", "oid", F.array("v").alias("f")))), lambda s: s["f"])
    wide = ser(spark, sf_dir).groupBy("px").agg(F.flatten(rows).alias("s"))
    return wide.select("px", F.size("s").cast("long").alias("n"), r6(F.element_at("s", 1)).alias("first"), r6(F.element_at("s", -1)).alias("last"))
