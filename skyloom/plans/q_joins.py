"""Queries of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.operators import joins as J
from skyloom.plans.catalog import load, query
from skyloom.plans.standins import OBS, PIX, R6, obs, pix, r6


@query("j01_parcel_to_group", "SELECT o_orderkey, coalesce(c_nationkey, 0)::INT AS group_1, coalesce(n_regionkey, 0)::INT AS group_1_id FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment <> 'BUILDING' LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(spark, sf_dir):
    groups = load(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    ids = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    joined = load(spark, sf_dir, "orders").join(groups, "o_custkey", "left").join(ids, "c_nationkey", "left").fillna(0, ["c_nationkey", "n_regionkey"])
    return joined.select("o_orderkey", F.col("c_nationkey").alias("group_1"), F.col("n_regionkey").alias("group_1_id"))


@query("j02_codes_under_two_roles", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, TRY_CAST(replace(p_brand, 'Brand#', '1') AS INT) AS brand_code, n.n_name AS supplier_nation, r.r_name AS supplier_region FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation n ON s_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey")
def _(spark, sf_dir):
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.replace("p_brand", F.lit("Brand#"), F.lit("1")).try_cast("int").alias("brand_code"))
    nations = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = load(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("supplier_nation"), F.col("r_name").alias("supplier_region"))
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return lines.join(parts, "l_partkey").join(suppliers, "l_suppkey")


@query("j02_nation_under_two_roles", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s.n_name AS supplier_nation, c.n_name AS customer_nation, s.n_regionkey = c.n_regionkey AS within_region FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation s ON s_nationkey = s.n_nationkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation c ON c_nationkey = c.n_nationkey")
def _(spark, sf_dir):
    """One dimension table joined twice, once for each code column; each role has names of its own."""
    nations = load(spark, sf_dir, "nation")

    def role(name: str, code: str):
        return nations.select(F.col("n_nationkey").alias(code), F.col("n_name").alias(f"{name}_nation"), F.col("n_regionkey").alias(f"{name}_region"))

    suppliers = load(spark, sf_dir, "supplier").join(role("supplier", "s_nationkey"), "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), "supplier_nation", "supplier_region")
    customers = load(spark, sf_dir, "customer").join(role("customer", "c_nationkey"), "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "customer_nation", "customer_region")
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(customers, "o_custkey")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(suppliers, "l_suppkey").join(orders, "l_orderkey")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "supplier_nation", "customer_nation", (F.col("supplier_region") == F.col("customer_region")).alias("within_region"))


@query("j03_survey_to_places", "SELECT c_custkey, n_name, round(c_acctbal, 2) AS wealth FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, sf_dir):
    return load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", F.round("c_acctbal", 2).alias("wealth"))


@query("j04_statistics_on_clear_dates", "SELECT event_id FROM events WHERE ts::DATE IN (SELECT ts::DATE FROM events GROUP BY 1 HAVING avg((event_type = 'error')::INT) < 0.2::DOUBLE)")
def _(spark, sf_dir):
    events = load(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    clear = events.groupBy("day").agg(F.avg((F.col("event_type") == "error").cast("int")).alias("cloud")).where("cloud < 0.2D").select("day")
    return events.join(clear, "day", "left_semi").select("event_id")


@query("j05_test_without_train", f"{OBS} SELECT oid FROM obs WHERE (oid // 100000) % 5 <> 0")
def _(spark, sf_dir):
    rows = obs(spark, sf_dir).select("oid")
    train = rows.where("(oid div 100000) % 5 = 0")
    return rows.join(train, "oid", "left_anti")


@query("j06_weather_near_acquisitions", "SELECT a.event_id AS acquisition, b.event_id AS weather FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 30 MINUTE AND a.ts + INTERVAL 30 MINUTE WHERE a.event_type = 'purchase' AND b.event_type <> 'purchase'")
def _(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    half = F.expr("INTERVAL 30 MINUTES")
    acquired = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("acquisition"), (F.col("ts") - half).alias("lo"), (F.col("ts") + half).alias("hi"))
    weather = events.where("event_type <> 'purchase'").select("user_id", F.col("event_id").alias("weather"), "ts")
    return J.interval_join(weather, acquired, "ts", "lo", "hi", ["user_id"], 3600).select("acquisition", "weather")


@query("j07_before_and_after_events", "SELECT o_orderkey, e.event_id, CASE WHEN e.ts < o_orderdate THEN 'before' ELSE 'after' END AS phase FROM (SELECT o_orderkey, o_custkey % 150 AS u, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (o_orderkey % 28) AS o_orderdate FROM orders) o JOIN events e ON e.user_id = u AND (e.ts BETWEEN o_orderdate - INTERVAL 16 DAY AND o_orderdate - INTERVAL 2 DAY OR e.ts BETWEEN o_orderdate + INTERVAL 3 DAY AND o_orderdate + INTERVAL 17 DAY)")
def _(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    fires = orders.selectExpr("o_orderkey", "o_custkey % 150 AS user_id", "timestamp_ntz'2024-01-01' + make_dt_interval(cast(o_orderkey % 28 AS int)) AS started").withColumn("ended", F.expr("started + INTERVAL 1 DAY"))
    return J.around_events(load(spark, sf_dir, "events").select("event_id", "user_id", "ts"), fires, "ts", "started", "ended", keys=["user_id"]).select("o_orderkey", "event_id", "phase")


_DATES = "d AS (SELECT DISTINCT user_id, ts::DATE::TIMESTAMP + INTERVAL 10 DAY AS ref FROM events)"


@query("j08_interval_of_observations", f"""WITH {_DATES}, n AS (SELECT d.user_id, d.ref, e.ts, row_number() OVER (PARTITION BY d.user_id, d.ref ORDER BY e.ts DESC) AS rn FROM d JOIN (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'purchase') e ON d.user_id = e.user_id AND e.ts BETWEEN d.ref - INTERVAL 21 DAY AND d.ref),
s AS (SELECT user_id, ref, count(*) AS k, min(ts) AS first FROM n WHERE rn <= 5 GROUP BY ALL)
SELECT d.user_id, strftime(d.ref, '%Y-%m-%d') AS day, strftime(CASE WHEN k = 5 THEN first ELSE d.ref - INTERVAL 21 DAY END, '%Y-%m-%d %H:%M:%S') AS start, coalesce(k, 0) = 5 AS enough FROM d LEFT JOIN s ON d.user_id = s.user_id AND d.ref = s.ref""")
def _(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    dates = events.select("user_id", (F.date_trunc("day", "ts").cast("timestamp_ntz") + F.expr("INTERVAL 10 DAYS")).alias("ref")).distinct()
    found = J.observation_interval(events.where("event_type = 'purchase'"), dates, "user_id", "ts", "ref", -5)
    return found.select("user_id", F.date_format("ref", "yyyy-MM-dd").alias("day"), F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "enough")


@query("j09_latest_clear_acquisition", "SELECT a.event_id, b.event_id AS latest, round(b.value, 2) AS value FROM events a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view' AND value < 200) b ON a.user_id = b.user_id AND a.ts >= b.ts WHERE a.event_type = 'purchase'")
def _(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'view' AND value < 200").select("user_id", "ts", F.col("event_id").alias("latest"), "value")
    return J.asof_join(left, right, ["user_id"], "ts", "ts", ["latest", "value"], "latest").select("event_id", "latest", F.round("value", 2).alias("value"))


def boxes(spark):
    """Forty overlapping boxes in the plane of account balances."""
    i = F.col("id").cast("double")
    return spark.range(40).select(F.col("id").alias("zone_id"), (i * 250 - 1000).alias("min_x"), ((i * 137) % 9000 - 1000).alias("min_y"), (i * 250 - 200).alias("max_x"), ((i * 137) % 9000 + 900).alias("max_y"))


_BOXES = "b AS (SELECT i AS zone_id, i * 250.0::DOUBLE - 1000 AS min_x, (i * 137) % 9000 - 1000.0::DOUBLE AS min_y, i * 250.0::DOUBLE - 200 AS max_x, (i * 137) % 9000 + 900.0::DOUBLE AS max_y FROM range(40) t(i))"
_POINTS = "p AS (SELECT c_custkey AS id, c_acctbal AS x, (c_custkey * 37 % 9000)::DOUBLE AS y FROM customer)"


def points(spark, sf_dir):
    return load(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_acctbal AS x", "cast(c_custkey * 37 % 9000 as double) AS y")


@query("j10_points_in_boxes", f"WITH {_BOXES}, {_POINTS} SELECT id, zone_id FROM p JOIN b ON x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y")
def _(spark, sf_dir):
    return J.bbox_join(points(spark, sf_dir), boxes(spark), "x", "y", 1000.0).select("id", "zone_id")


_DIAMONDS = f"{_BOXES}, z AS (SELECT *, (min_x + max_x) / 2 AS cx, (min_y + max_y) / 2 AS cy FROM b)"
#: A point is in a diamond if its distances from the centre, in units of the half axes, sum to less than one.
_IN = "abs(x - cx) / 400 + abs(y - cy) / 950 < 1"


def diamonds(spark):
    cx, cy = (F.col("min_x") + F.col("max_x")) / 2, (F.col("min_y") + F.col("max_y")) / 2
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return boxes(spark).withColumn("ring", F.array(corner(F.col("min_x"), cy), corner(cx, F.col("min_y")), corner(F.col("max_x"), cy), corner(cx, F.col("max_y"))))


@query("j11_pixels_in_polygons", f"WITH {_DIAMONDS}, {_POINTS} SELECT id, max(zone_id) AS zone_id FROM p JOIN z ON {_IN} GROUP BY id")
def _(spark, sf_dir):
    return J.rasterize(points(spark, sf_dir), diamonds(spark), "x", "y", 1000.0, ["id"])


@query("j12_clip_to_extent", f"WITH {_BOXES} SELECT zone_id, greatest(min_x, 0) AS min_x, greatest(min_y, 0) AS min_y, least(max_x, 5000) AS max_x, least(max_y, 5000) AS max_y, c AS points FROM b JOIN (SELECT (c_custkey % 40) AS k, count(*) AS c FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 GROUP BY 1) ON k = zone_id WHERE greatest(min_x, 0) < least(max_x, 5000) AND greatest(min_y, 0) < least(max_y, 5000)")
def _(spark, sf_dir):
    low, high = F.lit(0.0), F.lit(5000.0)
    clipped = boxes(spark).select("zone_id", F.greatest("min_x", low).alias("min_x"), F.greatest("min_y", low).alias("min_y"), F.least("max_x", high).alias("max_x"), F.least("max_y", high).alias("max_y"))
    inside = load(spark, sf_dir, "customer").where("c_acctbal BETWEEN 0 AND 5000").groupBy((F.col("c_custkey") % 40).alias("zone_id")).agg(F.count("*").alias("points"))
    return clipped.where("min_x < max_x AND min_y < max_y").join(inside, "zone_id")


@query("j12_clip_own_boxes", f"WITH {_POINTS}, b AS (SELECT id, x - 50 - id % 200 AS min_x, y - 50 - id % 150 AS min_y, x + 50 + id % 200 AS max_x, y + 50 + id % 150 AS max_y FROM p), c AS (SELECT id, greatest(min_x, 0) AS min_x, greatest(min_y, 0) AS min_y, least(max_x, 5000) AS max_x, least(max_y, 5000) AS max_y, (max_x - min_x) * (max_y - min_y) AS area FROM b) SELECT id, {R6('min_x')} AS min_x, {R6('min_y')} AS min_y, {R6('max_x')} AS max_x, {R6('max_y')} AS max_y, {R6('(max_x - min_x) * (max_y - min_y) / area')} AS share FROM c WHERE min_x < max_x AND min_y < max_y")
def _(spark, sf_dir):
    """Every point's own box, cut to the extent; boxes outside go."""
    own = points(spark, sf_dir).selectExpr("id", "x - 50 - id % 200 AS min_x", "y - 50 - id % 150 AS min_y", "x + 50 + id % 200 AS max_x", "y + 50 + id % 150 AS max_y")
    cut = J.clip_boxes(own.withColumn("area", (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))), (0.0, 0.0, 5000.0, 5000.0))
    share = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")) / F.col("area")
    return cut.select("id", *[r6(c).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")], r6(share).alias("share"))


@query("j13_tile_coverage", f"WITH {_DIAMONDS}, {_POINTS}, h AS (SELECT DISTINCT id FROM p JOIN z ON {_IN}) SELECT id % 20 AS tile_id, {R6('count(h.id) / count(*)')} AS coverage FROM p LEFT JOIN h USING (id) GROUP BY 1 HAVING count(h.id) / count(*) > 0.2")
def _(spark, sf_dir):
    p = points(spark, sf_dir)
    hit = J.rasterize(p, diamonds(spark), "x", "y", 1000.0, ["id"])
    share = p.join(hit, "id", "left").groupBy((F.col("id") % 20).alias("tile_id")).agg(F.avg(F.col("zone_id").isNotNull().cast("int")).alias("coverage"))
    return share.where("coverage > 0.2").select("tile_id", r6("coverage").alias("coverage"))


@query("j14_series_with_composite", f"{OBS}, c AS (SELECT tile_id, y, x, median(nir) AS m FROM obs GROUP BY ALL) SELECT oid, {R6('nir - m')} AS off FROM obs JOIN c USING (tile_id, y, x)")
def _(spark, sf_dir):
    rows = obs(spark, sf_dir)
    composite = rows.groupBy("tile_id", "y", "x").agg(F.median("nir").alias("m"))
    return rows.join(composite, ["tile_id", "y", "x"]).select("oid", r6(F.col("nir") - F.col("m")).alias("off"))


@query("j15_nearest_grid_value", "SELECT id, arg_min(sid, struct_pack(d := d, sx := sx, sy := sy)) AS nearest FROM (SELECT c_custkey AS id, s_suppkey AS sid, s_acctbal AS sx, (s_suppkey * 53 % 9000)::DOUBLE AS sy, (c_acctbal - s_acctbal) * (c_acctbal - s_acctbal) + ((c_custkey * 37 % 9000) - (s_suppkey * 53 % 9000)::DOUBLE) * ((c_custkey * 37 % 9000) - (s_suppkey * 53 % 9000)::DOUBLE) AS d FROM customer, supplier) GROUP BY id")
def _(spark, sf_dir):
    sources = load(spark, sf_dir, "supplier").selectExpr("s_suppkey AS nearest", "s_acctbal AS sx", "cast(s_suppkey * 53 % 9000 as double) AS sy")
    return J.nearest_grid(points(spark, sf_dir), sources, "x", "y", "nearest", ["id"])


@query("j16_bands_to_one_series", "SELECT o_orderkey, count(*) FILTER (l_linenumber = 1) AS b1, count(*) FILTER (l_linenumber = 2) AS b2, count(*) FILTER (l_linenumber = 3) AS b3 FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber <= 3 GROUP BY o_orderkey")
def _(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").where("l_linenumber <= 3").join(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    wide = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).pivot("l_linenumber", [1, 2, 3]).agg(F.count("l_orderkey"))
    return wide.select("o_orderkey", *[F.coalesce(F.col(str(i)), F.lit(0)).alias(f"b{i}") for i in (1, 2, 3)])


@query("j17_repeat_coarse_pixels", f"{PIX} SELECT f.tile_id, f.y, f.x, {R6('c.v')} AS coarse FROM pix f JOIN pix c ON f.tile_id = c.tile_id AND f.y // 2 = c.y AND f.x // 2 = c.x")
def _(spark, sf_dir):
    fine = pix(spark, sf_dir)
    coarse = fine.where("y < 4 AND x < 4").select("tile_id", F.col("y").alias("cy"), F.col("x").alias("cx"), F.col("v").alias("coarse"))
    keyed = fine.select("tile_id", "y", "x", F.expr("y div 2").alias("cy"), F.expr("x div 2").alias("cx"))
    return keyed.join(coarse, ["tile_id", "cy", "cx"]).select("tile_id", "y", "x", r6("coarse").alias("coarse"))


@query("j18_tile_statistics_by_id", f"{PIX} SELECT tile_id, label, {R6('avg(v)')} AS mean FROM pix GROUP BY tile_id, label")
def _(spark, sf_dir):
    stats = pix(spark, sf_dir).groupBy("tile_id").agg(F.avg("v").alias("mean"))
    info = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tile_id"), "label")
    return info.join(stats, "tile_id").select("tile_id", "label", r6("mean").alias("mean"))
