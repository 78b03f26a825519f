"""Queries of aggregates, sketches, metrics and top lists."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.operators import aggregates as G
from skyloom.operators import joins as J
from skyloom.operators import sketches as S
from skyloom.plans.catalog import load, query
from skyloom.plans.q_joins import _DIAMONDS, _IN, _POINTS, diamonds, points
from skyloom.plans.standins import OBS, PIX, R6, SER, obs, pix, r6, ser

FOUR = ["blue", "red", "nir", "swir"]
PX = "tile_id, y, x"


def _agg(name: str, keys: str, exprs: dict, where: str | None = None, extra: str = ""):
    """Grouped aggregates of the observations: ``out: (Column function, SQL)``."""
    sql = f"{OBS} SELECT {keys}, " + ", ".join(f"{s} AS {n}" for n, (_, s) in exprs.items()) + f" FROM obs {'WHERE ' + where if where else ''} GROUP BY ALL {extra}"

    @query(name, sql)
    def run(spark, sf_dir):
        rows = obs(spark, sf_dir)
        rows = rows.where(where) if where else rows
        return rows.groupBy(*keys.split(", ")).agg(*[f().alias(n) for n, (f, _) in exprs.items()])


_agg("a01_valid_count", PX, {"n_valid": (lambda: F.count_if("valid"), "count(*) FILTER (valid)")})
_agg("a02_valid_fraction", "tile_id, ts", {"valid_frac": (lambda: r6(G.valid_fraction()), R6("avg(valid::INT)"))})
_agg("a05_class_frequency", PX, {f"freq_{k}": (lambda k=k: r6(F.try_divide(F.count_if(F.col("scl") == k), F.count_if(F.col("scl") != 7))), R6(f"count(*) FILTER (scl = {k}) / nullif(count(*) FILTER (scl <> 7), 0)")) for k in (1, 2, 3)})
_agg("a06_median_composite", PX, {b: (lambda b=b: r6(F.median(b)), R6(f"median({b})")) for b in FOUR})
_agg("a07_clear_mean", PX, {"nir": (lambda: r6(F.avg(F.when(F.col("valid"), F.col("nir")))), R6("avg(nir) FILTER (valid)"))})
_agg("a08_last_nonzero_mosaic", PX, {"red": (lambda: r6(G.last_nonzero("red", ["ts", "oid"])), R6("arg_max(red, (ts, oid)) FILTER (red <> 0)")), "masks": (lambda: F.bit_or("scl"), "bit_or(scl)")})
_agg("a25_mean_cloud", PX, {"cloud": (lambda: r6(F.avg("clp") / 255), R6("avg(clp) / 255"))})
_agg("a28_complete_tiles", "tile_id, ts", {"complete": (lambda: F.bool_and("is_data"), "bool_and(is_data)")})
_agg("a29_water_coverage", "tile_id, ts", {"enough": (lambda: F.count_if(F.col("blue") > 0.05) >= 0.05 * F.count("*"), "count(*) FILTER (blue > 0.05::DOUBLE) >= 0.05 * count(*)")})
_agg("a31_channel_statistics", "scl", {f"{n}_{b}": (lambda f=f, b=b: r6(f(b)), R6(f"{s}({b})")) for b in ("nir", "swir") for n, f, s in (("mean", F.avg, "avg"), ("std", F.stddev_pop, "stddev_pop"))})
_agg("a42_maximum_over_time", PX, {"swir": (lambda: r6(F.max("swir")), R6("max(swir)"))})
_agg("a43_maximum_class", PX, {"cls": (lambda: F.max("scl"), "max(scl)")})
_agg("a24_masked_subwindow", "tile_id, ts", {"mean": (lambda: r6(F.avg(F.when(F.col("valid"), F.col("nir")))), R6("avg(nir) FILTER (valid)")), "std": (lambda: r6(F.stddev_pop(F.when(F.col("valid"), F.col("nir")))), R6("stddev_pop(nir) FILTER (valid)"))}, "y BETWEEN 4 AND 11 AND x < 8")
_agg("l04_extreme_frames", "tile_id", {"lowest": (lambda: F.date_format(F.min_by("ts", F.struct("nir", "oid")), "yyyy-MM-dd"), "strftime(arg_min(ts, (nir, oid)), '%Y-%m-%d')"), "highest": (lambda: F.date_format(F.max_by("ts", F.struct("nir", "oid")), "yyyy-MM-dd"), "strftime(arg_max(ts, (nir, oid)), '%Y-%m-%d')")})


@query("a03_frames_above_valid_fraction", f"{OBS} SELECT oid FROM obs WHERE (tile_id, ts) IN (SELECT (tile_id, ts) FROM obs GROUP BY tile_id, ts HAVING avg(valid::INT) > 0.6::DOUBLE)")
def _(spark, sf_dir):
    return G.frames_above(obs(spark, sf_dir), 0.6).select("oid")


@query("a04_frames_up_to_cloud", f"{OBS} SELECT tile_id, ts, {R6('avg(clp)')} AS cloud FROM obs GROUP BY tile_id, ts HAVING avg(clp) <= 0.4051::DOUBLE")
def _(spark, sf_dir):
    return obs(spark, sf_dir).groupBy("tile_id", "ts").agg(F.avg("clp").alias("cloud")).where("cloud <= 0.4051D").select("tile_id", "ts", r6("cloud").alias("cloud"))


@query("a09_monthly_baseline", f"{OBS} SELECT {PX}, month(ts)::INT AS month, {R6('avg(nir)')} AS mean, {R6('stddev_pop(nir)')} AS sd FROM obs GROUP BY ALL")
def _(spark, sf_dir):
    return G.baseline(obs(spark, sf_dir), "nir").select("tile_id", "y", "x", "month", r6("mean").alias("mean"), r6("sd").alias("sd"))


@query("a10_anomaly", f"{OBS}, b AS (SELECT {PX}, month(ts) AS m, avg(nir) AS mean, stddev_pop(nir) AS sd FROM obs GROUP BY ALL) SELECT oid, round((mean - nir) / CASE WHEN sd > 1e-12::DOUBLE THEN sd END, 4) + 0.0::DOUBLE AS anomaly FROM obs o JOIN b USING (tile_id, y, x) WHERE b.m = month(o.ts)")
def _(spark, sf_dir):
    rows = obs(spark, sf_dir)
    return G.anomalies(rows, G.baseline(rows, "nir"), "nir").select("oid", (F.round("anomaly", 4) + F.lit(0.0)).alias("anomaly"))


@query("a11_median_per_cluster", f"SELECT c_nationkey, {R6('median(c_acctbal)')} AS wealth FROM customer GROUP BY 1")
def _(spark, sf_dir):
    return load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(r6(F.median("c_acctbal")).alias("wealth"))


_ZONED = f"WITH {_DIAMONDS}, {_POINTS}, h AS (SELECT id, max(zone_id) AS zone_id FROM p JOIN z ON {_IN} GROUP BY id)"


def zoned(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.join(J.rasterize(p, diamonds(spark), "x", "y", 1000.0, ["id"]), "id")


@query("a12_zonal_statistics", f"{_ZONED} SELECT zone_id, {R6('avg(x)')} AS mean, {R6('stddev_pop(x)')} AS std, {R6('median(x)')} AS median FROM h JOIN p USING (id) GROUP BY zone_id")
def _(spark, sf_dir):
    return zoned(spark, sf_dir).groupBy("zone_id").agg(r6(F.avg("x")).alias("mean"), r6(F.stddev_pop("x")).alias("std"), r6(F.median("x")).alias("median"))


@query("a13_zone_mean_without_missing", f"{_ZONED} SELECT zone_id, {R6('avg(x) FILTER (id % 3 <> 0)')} AS mean FROM h JOIN p USING (id) GROUP BY zone_id")
def _(spark, sf_dir):
    from skyloom.functions.algebra import missing_nan

    value = missing_nan(F.when(F.col("id") % 3 != 0, F.col("x")).otherwise(F.lit(float("nan"))))
    return zoned(spark, sf_dir).groupBy("zone_id").agg(r6(F.avg(value)).alias("mean"))


@query("a14_zone_distribution", f"{_ZONED} SELECT zone_id, {R6('min(x)')} AS low, {R6('quantile_cont(x, 0.25)')} AS q1, {R6('quantile_cont(x, 0.5)')} AS q2, {R6('quantile_cont(x, 0.75)')} AS q3, {R6('max(x)')} AS high FROM h JOIN p USING (id) GROUP BY zone_id")
def _(spark, sf_dir):
    q = zoned(spark, sf_dir).groupBy("zone_id").agg(F.percentile("x", F.array(*[F.lit(v) for v in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("q"))
    return q.select("zone_id", *[r6(F.col("q")[i]).alias(n) for i, n in enumerate(["low", "q1", "q2", "q3", "high"])])


@query("a15_interval_statistics", f"SELECT event_type, strftime(time_bucket(INTERVAL 2 DAY, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS day, {R6('min(value)')} AS min, {R6('max(value)')} AS max, {R6('avg(value)')} AS mean, {R6('stddev_pop(value)')} AS stdev, count(value) AS n FROM events GROUP BY ALL")
def _(spark, sf_dir):
    stats = G.interval_statistics(load(spark, sf_dir, "events"), ["event_type"], "value", "2 days")
    return stats.select("event_type", F.date_format("interval_from", "yyyy-MM-dd").alias("day"), *[r6(c).alias(c) for c in ("min", "max", "mean", "stdev")], "n")


def _sketch(name: str, mode: str, keys: list[str], sql_keys: str, pixelwise: bool = False):
    """The sketch's count, and whether its median's true rank is within 2 % of one half."""
    month = "month(ts)::INT AS month"
    bands = "unpivot (SELECT tile_id, y, x, ts, nir, swir FROM obs) ON nir, swir INTO NAME band VALUE v"
    select = ", ".join(month if k == "month" else k for k in keys)

    @query(name, f"{OBS}, u AS ({bands}) SELECT {select + ', ' if keys else ''}count(v) AS n, true AS close FROM u {'GROUP BY ALL' if keys else ''}")
    def run(spark, sf_dir):
        rows = obs(spark, sf_dir)
        sk = S.sketch(rows, ["nir", "swir"], mode, pixelwise, ["tile_id"])
        got = sk.select(*keys, "n", S.quantile("sketch", 0.5).alias("median"))
        long = S.long_bands(rows.withColumn("month", F.month("ts")), ["nir", "swir"], [c for c in ("ts", "month", "tile_id")])
        # bands and months are few, whatever the rows
        joined = long.join(got if {"ts", "tile_id"} & set(keys) else F.broadcast(got), keys or F.lit(True))
        below, upto = F.count_if(F.col("v") < F.col("median")), F.count_if(F.col("v") <= F.col("median"))
        return joined.groupBy(*keys, "n").agg(((below <= 0.52 * F.count("*") + 1) & (upto >= 0.48 * F.count("*") - 1)).alias("close"))


_sketch("a16_sketch_standard", "standard", ["band"], "band")
_sketch("a17_sketch_timewise", "timewise", ["band", "ts"], "band, ts")
_sketch("a18_sketch_monthly", "monthly", ["band", "month"], "band, month")
_sketch("a19_sketch_total", "total", [], "")
_sketch("a20_sketch_pixelwise", "standard", ["tile_id", "band"], "tile_id, band", True)


@query("a21_merged_sketches", f"{OBS}, u AS (unpivot (SELECT tile_id, nir, swir FROM obs) ON nir, swir INTO NAME band VALUE v) SELECT band, count(v) AS n, true AS same_rank FROM u GROUP BY band")
def _(spark, sf_dir):
    rows = obs(spark, sf_dir)
    merged = S.merge(S.sketch(rows, ["nir", "swir"], pixelwise=True, keys=["tile_id"]), ["band"]).select("band", "n", S.quantile("sketch", 0.5).alias("m"))
    long = S.long_bands(rows, ["nir", "swir"], []).join(F.broadcast(merged), "band")
    return long.groupBy("band", "n").agg((F.abs(F.avg((F.col("v") <= F.col("m")).cast("int")) - 0.5) < 0.03).alias("same_rank"))


@query("a22_limits_and_scaling", f"{OBS} SELECT tile_id, count(*) AS n, true AS close FROM obs GROUP BY tile_id")
def _(spark, sf_dir):
    from skyloom.functions.algebra import scale_to
    from skyloom.operators.sampling import exact_quantiles

    rows = obs(spark, sf_dir)
    merged = S.merge(S.sketch(rows, ["nir"], pixelwise=True, keys=["tile_id"]))
    limits = merged.select(S.quantile("sketch", 0.01).alias("lo"), S.quantile("sketch", 0.99).alias("hi"))
    exact = exact_quantiles(rows, "nir", [0.01, 0.99]).select(F.col("q")[0].alias("elo"), F.col("q")[1].alias("ehi"))
    both = rows.join(F.broadcast(limits), F.lit(True)).join(F.broadcast(exact), F.lit(True))
    return both.groupBy("tile_id").agg(F.count("*").alias("n"), (F.max(F.abs(scale_to("nir", "lo", "hi", missing=0) - scale_to("nir", "elo", "ehi", missing=0))) < 0.1).alias("close"))


@query("a23_tree_reduction", f"SELECT event_type, {R6('sum(value)')} AS total, max(event_id) AS last FROM events GROUP BY 1")
def _(spark, sf_dir):
    """A user's reducer, merged in a tree."""
    from skyloom.operators.scans import reduce_ordered

    rows = load(spark, sf_dir, "events").select("event_type", "event_id", F.col("value").alias("total"), F.col("event_id").alias("last"))
    return reduce_ordered(rows, ["event_type"], ["event_id"], ["total", "last"], lambda a, b: (a[0] + b[0], max(a[1], b[1]))).select("event_type", r6("total").alias("total"), "last")


@query("a23_ordered_reduction", f"""WITH o AS (SELECT event_type, ts, event_id, value, lag(value) OVER w AS before, row_number() OVER w AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
SELECT event_type, {R6('max(value) FILTER (i = 1)')} AS first, {R6('max(value) FILTER (i = n)')} AS last, count(*) FILTER (value > before) AS rises, {R6('coalesce(max(value - before), -1e9::DOUBLE)')} AS steepest FROM o GROUP BY event_type""")
def _(spark, sf_dir):
    """A reducer that doesn't commute: where one stretch ends and the next begins matters."""
    from skyloom.operators.scans import reduce_ordered

    def join(a, b):
        step = b[0] - a[1]
        return a[0], b[1], a[2] + b[2] + (step > 0), max(a[3], b[3], step)

    rows = load(spark, sf_dir, "events").select("event_type", "ts", "event_id", F.col("value").alias("first"), F.col("value").alias("last"), F.lit(0).cast("long").alias("rises"), F.lit(-1e9).alias("steepest"))
    merged = reduce_ordered(rows, ["event_type"], ["ts", "event_id"], ["first", "last", "rises", "steepest"], join, chunk=256)
    return merged.select("event_type", r6("first").alias("first"), r6("last").alias("last"), "rises", r6("steepest").alias("steepest"))


@query("a26_class_distribution", f"{SER} SELECT class, count(*) AS n FROM ser GROUP BY class")
def _(spark, sf_dir):
    return ser(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n"))


@query("a27_histogram_by_class", f"{SER} SELECT class, (CASE WHEN v < 0 THEN 0 WHEN v >= 500 THEN 26 ELSE floor(v / 20) + 1 END)::BIGINT AS bin, count(*) AS n FROM ser GROUP BY ALL")
def _(spark, sf_dir):
    return ser(spark, sf_dir).groupBy("class", F.width_bucket("v", F.lit(0.0), F.lit(500.0), F.lit(25)).alias("bin")).agg(F.count("*").alias("n"))


_FIELDS = "f AS (SELECT o_custkey AS tile_id, o_orderkey % 7 + 1.0::DOUBLE AS w, o_totalprice / 10000 AS h FROM orders)"


@query("a30_area_ratio", f"WITH {_FIELDS}, a AS (SELECT tile_id, sum(w * h / 2) AS area FROM f GROUP BY tile_id) SELECT c_custkey AS tile_id, round(coalesce(area / (1000 + c_nationkey * 10), -1), 5) + 0.0 AS ratio FROM customer LEFT JOIN a ON tile_id = c_custkey")
def _(spark, sf_dir):
    """Triangular fields of the orders' sizes on tiles of the customers; a tile without a field has -1."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    w, h, left = F.col("o_orderkey") % 7 + 1.0, F.col("o_totalprice") / 10000, F.col("o_orderkey") % 11
    ring = F.array(corner(left, F.lit(0)), corner(left + w, F.lit(0)), corner(left, h))
    fields = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), J.ring_area(ring).alias("area")).groupBy("c_custkey").agg(F.sum("area").alias("area"))
    tiles = load(spark, sf_dir, "customer").select("c_custkey", (1000.0 + F.col("c_nationkey") * 10).alias("tile_area"))
    ratio = F.coalesce(F.try_divide("area", "tile_area"), F.lit(-1.0))
    return tiles.join(fields, "c_custkey", "left").select(F.col("c_custkey").alias("tile_id"), (F.round(ratio, 5) + F.lit(0.0)).alias("ratio"))


@query("a32_point_density", "SELECT floor(c_acctbal / 250)::BIGINT AS cx, floor((c_custkey * 37 % 9000) / 250)::BIGINT AS cy, count(*) AS n FROM customer GROUP BY ALL")
def _(spark, sf_dir):
    return points(spark, sf_dir).groupBy(F.floor(F.col("x") / 250).alias("cx"), F.floor(F.col("y") / 250).alias("cy")).agg(F.count("*").alias("n"))


_CALENDAR = "c AS (SELECT unnest(generate_series(date_trunc('month', min(ts))::DATE, last_day(max(ts)), INTERVAL 1 DAY))::DATE AS d FROM events), k AS (SELECT c.d, count(event_id) AS n FROM c LEFT JOIN events ON ts::DATE = c.d GROUP BY c.d)"


def calendar(spark, sf_dir):
    """Every day of the months that the events touch, with their number."""
    events = load(spark, sf_dir, "events")
    days = events.agg(F.trunc(F.min("ts"), "month").alias("lo"), F.last_day(F.max("ts")).alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("d"))
    counts = events.groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    return days.join(counts, "d", "left").select("d", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("a33_calendar_heat_map", f"WITH {_CALENDAR} SELECT year(d)::INT AS year, month(d)::INT AS month, day(d)::INT AS day, n FROM k")
def _(spark, sf_dir):
    return calendar(spark, sf_dir).select(F.year("d").alias("year"), F.month("d").alias("month"), F.dayofmonth("d").alias("day"), "n")


@query("a33_calendar_by_day", f"WITH {_CALENDAR} SELECT strftime(d, '%Y-%m') AS month, {', '.join(f'max(n) FILTER (day(d) = {i}) AS day_{i:02d}' for i in range(1, 32))} FROM k GROUP BY 1")
def _(spark, sf_dir):
    """A row for each month and a column for each day; days that a month lacks are null, days without events 0."""
    wide = calendar(spark, sf_dir).withColumn("day", F.dayofmonth("d")).groupBy(F.date_format("d", "yyyy-MM").alias("month")).pivot("day", list(range(1, 32)))
    return wide.agg(F.max("n")).select("month", *[F.col(str(i)).alias(f"day_{i:02d}") for i in range(1, 32)])


@query("a34_gap_histogram", f"{SER} SELECT gap, count(*) AS n FROM (SELECT date_diff('day', lag(ts) OVER (PARTITION BY px ORDER BY ts, oid)::DATE, ts::DATE)::INT AS gap FROM ser) WHERE gap IS NOT NULL GROUP BY gap")
def _(spark, sf_dir):
    w = Window.partitionBy("px").orderBy("ts", "oid")
    return ser(spark, sf_dir).select(F.datediff("ts", F.lag("ts").over(w)).alias("gap")).where("gap IS NOT NULL").groupBy("gap").agg(F.count("*").alias("n"))


_JUDGED = "WITH j AS (SELECT event_id, user_id, event_type AS t, CASE WHEN event_id % 5 = 0 THEN 'view' ELSE event_type END AS p, (event_id % 4)::DOUBLE AS w, value AS v, value * 1.1::DOUBLE AS pv, event_type <> 'error' AS m FROM events)"


def judged(spark, sf_dir):
    return load(spark, sf_dir, "events").selectExpr("event_id", "user_id", "event_type AS t", "CASE WHEN event_id % 5 = 0 THEN 'view' ELSE event_type END AS p", "cast(event_id % 4 as double) AS w", "value AS v", "value * 1.1D AS pv", "event_type <> 'error' AS m")


@query("a35_confusion_matrix", f"{_JUDGED} SELECT t, {', '.join(f'''count(*) FILTER (p = '{k}') AS pred_{k}''' for k in ('view', 'click', 'purchase'))} FROM j GROUP BY t")
def _(spark, sf_dir):
    return G.confusion(judged(spark, sf_dir), "t", "p", ["view", "click", "purchase"])


@query("a35_confusion_of_all_classes", f"{_JUDGED} SELECT t, p, count(*) AS n, {R6('count(*) / sum(count(*)) OVER (PARTITION BY t)')} AS share FROM j GROUP BY t, p")
def _(spark, sf_dir):
    """One row for each pair of classes that occurs, whatever classes there are, with its share of the true class."""
    counts = judged(spark, sf_dir).groupBy("t", "p").agg(F.count("*").alias("n"))
    return counts.select("t", "p", "n", r6(F.col("n") / F.sum("n").over(Window.partitionBy("t"))).alias("share"))


@query("a36_class_scores", f"{_JUDGED}, s AS (SELECT t AS class, count(*) AS support, count(*) FILTER (t = p) AS tp FROM j GROUP BY t), c AS (SELECT p AS class, count(*) AS claimed FROM j GROUP BY p) SELECT class, support, {R6('tp / claimed')} AS precision, {R6('tp / support')} AS recall, {R6('coalesce(2.0 * tp / nullif(claimed + support, 0), 0)')} AS f1 FROM s JOIN c USING (class)")
def _(spark, sf_dir):
    return G.class_scores(judged(spark, sf_dir), "t", "p").select("class", "support", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query("a37_masked_accuracy_and_kappa", f"{_JUDGED}, n AS (SELECT sum(w) AS n, sum(w) FILTER (t = p) AS same, sum(w) FILTER (t = p AND m) / sum(w) FILTER (m) AS acc FROM j), e AS (SELECT sum(a * b) AS ab FROM (SELECT t AS k, sum(w) AS a FROM j GROUP BY t) JOIN (SELECT p AS k, sum(w) AS b FROM j GROUP BY p) USING (k)) SELECT {R6('acc')} AS accuracy, {R6('(same / n - ab / (n * n)) / (1 - ab / (n * n))')} AS kappa FROM n, e")
def _(spark, sf_dir):
    rows = judged(spark, sf_dir)
    acc = rows.agg(F.try_divide(F.sum(F.when(F.col("m") & (F.col("t") == F.col("p")), F.col("w"))), F.sum(F.when(F.col("m"), F.col("w")))).alias("accuracy"))
    return acc.join(F.broadcast(G.cohen_kappa(rows, "t", "p", F.col("w"))), F.lit(True)).select(r6("accuracy").alias("accuracy"), r6("kappa").alias("kappa"))


@query("a38_masked_errors", f"{_JUDGED} SELECT {R6('sum(CASE WHEN m THEN (pv - v) * (pv - v) ELSE 0 END) / count(*) FILTER (m)')} AS mse, {R6('(var_pop(pv) FILTER (m AND pv <> 0) / var_pop(v) FILTER (m AND v <> 0) - 1) ** 2')} AS sve FROM j")
def _(spark, sf_dir):
    return judged(spark, sf_dir).agg(r6(G.masked_mse("v", "pv", "m")).alias("mse"), r6(G.squared_variance_error("v", "pv", "m")).alias("sve"))


@query("a39_intersection_over_union", f"{OBS} SELECT tile_id, {R6('count(*) FILTER (valid AND is_data) / count(*) FILTER (valid OR is_data)')} AS iou, {R6('avg((scl = 3)::INT) FILTER (scl <> 7)')} AS acc FROM obs GROUP BY tile_id")
def _(spark, sf_dir):
    return obs(spark, sf_dir).groupBy("tile_id").agg(r6(G.iou(F.col("valid"), F.col("is_data"))).alias("iou"), r6(F.avg(F.when(F.col("scl") != 7, (F.col("scl") == 3).cast("int")))).alias("acc"))


@query("a40_agreement_of_products", f"{OBS}, p AS (SELECT {PX}, avg(nir) AS a, median(nir) AS b FROM obs GROUP BY ALL) SELECT tile_id, count(*) FILTER (abs(round(a, 4) - b) > 0.05) AS differing FROM p GROUP BY tile_id")
def _(spark, sf_dir):
    rows = obs(spark, sf_dir)
    both = rows.groupBy(*G.PIXEL).agg(F.avg("nir").alias("a"), F.median("nir").alias("b"))
    return both.groupBy("tile_id").agg(F.count_if(F.abs(F.round("a", 4) - F.col("b")) > 0.05).alias("differing"))


@query("a41_wealth_classes", "SELECT c_custkey, ((c_acctbal > 0)::INT + (c_acctbal > 2500)::INT + (c_acctbal > 5000)::INT + (c_acctbal > 7500)::INT)::INT AS class FROM customer")
def _(spark, sf_dir):
    from skyloom.functions.algebra import label_bins

    return load(spark, sf_dir, "customer").select("c_custkey", label_bins("c_acctbal", [0.0, 2500.0, 5000.0, 7500.0]).cast("int").alias("class"))


@query("a44_quantile_grid", f"{SER} SELECT q, true AS close FROM (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9])::DOUBLE AS q)")
def _(spark, sf_dir):
    rows = ser(spark, sf_dir)
    sk = rows.agg(F.kll_sketch_agg_double("v", S.K).alias("sketch"))
    grid = sk.select(F.explode(F.array(*[F.struct(F.lit(q).alias("q"), S.quantile("sketch", q).alias("value")) for q in (0.1, 0.25, 0.5, 0.75, 0.9)])).alias("g")).select("g.*")
    true = rows.join(F.broadcast(grid), F.lit(True)).groupBy("q").agg(F.avg((F.col("v") <= F.col("value")).cast("int")).alias("cdf"))
    return true.select("q", (F.abs(F.col("cdf") - F.col("q")) < 0.03).alias("close"))


@query("a45_weighted_batch_metrics", f"{_JUDGED}, b AS (SELECT user_id, avg((t = p)::INT) AS metric, count(*) FILTER (m) AS n FROM j GROUP BY user_id) SELECT {R6('sum(metric * n) / sum(n)')} AS metric FROM b")
def _(spark, sf_dir):
    batches = judged(spark, sf_dir).groupBy("user_id").agg(F.avg((F.col("t") == F.col("p")).cast("int")).alias("metric"), F.count_if("m").alias("n"))
    return batches.agg(r6(F.try_divide(F.sum(F.col("metric") * F.col("n")), F.sum("n"))).alias("metric"))


@query("a46_keep_full_tiles_as_bytes", f"{PIX}, t AS (SELECT tile_id, min(v) AS lo, max(v) AS hi FROM pix GROUP BY tile_id HAVING avg((abs(v) > 0.01)::INT) >= 0.9::DOUBLE) SELECT tile_id, y, x, floor(round((v - lo) / nullif(hi - lo, 0) * 255, 6))::INT AS byte FROM pix JOIN t USING (tile_id)")
def _(spark, sf_dir):
    rows = pix(spark, sf_dir)
    full = rows.groupBy("tile_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg((F.abs("v") > 0.01).cast("int")).alias("f")).where("f >= 0.9D")
    scaled = F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * 255
    return rows.join(full, "tile_id").select("tile_id", "y", "x", F.floor(F.round(scaled, 6)).cast("int").alias("byte"))


@query("a47_light_levels", "WITH m AS (SELECT o_custkey AS tile_id, max(o_totalprice) / 10000 AS light FROM orders GROUP BY 1) SELECT tile_id, CASE WHEN light < 0 THEN NULL WHEN light < 1 THEN 'none' WHEN light < 2 THEN 'low' WHEN light < 9 THEN 'medium' WHEN light < 18 THEN 'high' WHEN light < 58 THEN 'very high' END AS level FROM m")
def _(spark, sf_dir):
    tiles = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("tile_id")).agg((F.max("o_totalprice") / 10000).alias("light"))
    return tiles.select("tile_id", G.in_steps("light", [0, 1, 2, 9, 18, 58], ["none", "low", "medium", "high", "very high"]).alias("level"))


@query("l01_sort_and_renumber", "SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS idx, c_custkey FROM customer")
def _(spark, sf_dir):
    from skyloom.operators.sampling import ranked

    rows = load(spark, sf_dir, "customer").select("c_custkey", (-F.col("c_acctbal")).alias("down"))
    return ranked(rows, [], ["down", "c_custkey"], "idx").select(F.col("idx").cast("long").alias("idx"), "c_custkey")


@query("l02_top_zones_by_mean", f"SELECT n_name, {R6('avg(c_acctbal)')} AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY avg(c_acctbal) DESC, n_name LIMIT 10")
def _(spark, sf_dir):
    joined = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.avg("c_acctbal").alias("mean")).orderBy(F.desc("mean"), "n_name").limit(10).select("n_name", r6("mean").alias("mean"))


@query("l03_prefix_and_sort", "SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'S') ORDER BY p_type, p_partkey")
def _(spark, sf_dir):
    return load(spark, sf_dir, "part").where(F.startswith("p_type", F.lit("S"))).select("p_partkey", "p_type").orderBy("p_type", "p_partkey")


@query("l05_top_scenes_per_tile", f"{OBS}, f AS (SELECT tile_id, ts, avg(valid::INT) AS frac FROM obs GROUP BY ALL) SELECT tile_id, ts FROM f QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY round(frac, 9) DESC, ts DESC) <= 5")
def _(spark, sf_dir):
    frames = obs(spark, sf_dir).groupBy("tile_id", "ts").agg(G.valid_fraction().alias("frac"))
    w = Window.partitionBy("tile_id").orderBy(F.desc(F.round("frac", 9)), F.desc("ts"))
    return frames.withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("tile_id", "ts")


@query("l06_natural_tile_order", f"{OBS} SELECT DISTINCT y, x FROM obs ORDER BY y, x")
def _(spark, sf_dir):
    return obs(spark, sf_dir).select("y", "x").distinct().orderBy("y", "x")
