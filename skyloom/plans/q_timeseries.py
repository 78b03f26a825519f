"""Queries of time series, composites, climatology and thinning."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.functions.algebra import ndi
from skyloom.operators import aggregates as G
from skyloom.operators import timeseries as T
from skyloom.plans.catalog import load, query
from skyloom.plans.standins import OBS, PIX, R6, SER, obs, pix, r6, ser

PX = "tile_id, y, x"
NDVI = "((nir - red) / nullif(nir + red, 0))"
FRAMES = f"{OBS}, fr AS (SELECT *, (dense_rank() OVER (PARTITION BY tile_id ORDER BY ts) - 1)::INT AS t FROM obs)"
ORDER = ("ts", "oid")


@query("w01_extreme_indices", f"{FRAMES} SELECT {PX}, coalesce(arg_max(t, (nir, -t)) FILTER (valid), 0)::INT AS argmax, coalesce(arg_min(t, (nir, t)) FILTER (valid), 0)::INT AS argmin FROM fr GROUP BY ALL")
def _(spark, sf_dir):
    return T.extreme_times(T.frame_numbers(obs(spark, sf_dir)), "nir", "valid")


@query("w02_slope_indices", f"""{FRAMES}, n AS (SELECT *, lead(nir) OVER w - lag(nir) OVER w AS rise, date_diff('day', (lag(ts) OVER w)::DATE, (lead(ts) OVER w)::DATE) AS days FROM fr WHERE valid WINDOW w AS (PARTITION BY {PX} ORDER BY ts, oid)),
s AS (SELECT {PX}, t, rise / nullif(days, 0) AS slope FROM n), m AS (SELECT {PX}, arg_max(t, (slope, -t)) FILTER (slope IS NOT NULL) AS hi, arg_min(t, (slope, t)) FILTER (slope IS NOT NULL) AS lo FROM s GROUP BY ALL)
SELECT {PX}, coalesce(hi, 0)::INT AS argmax, coalesce(lo, 0)::INT AS argmin FROM (SELECT DISTINCT {PX} FROM obs) LEFT JOIN m USING (tile_id, y, x)""")
def _(spark, sf_dir):
    return T.slope_times(T.frame_numbers(obs(spark, sf_dir)), "nir", "valid", tie=["oid"])


_AT = (("max_ndvi", "max", "k"), ("min_ndvi", "min", "k"), ("max_slope", "max", "slope"), ("min_slope", "min", "slope"), ("max_red", "max", "red"))


@query("w03_bands_at_extremes", f"""{OBS}, n AS (SELECT *, {NDVI} AS k FROM obs WHERE valid), r AS (SELECT *, (lead(k) OVER w - lag(k) OVER w) / nullif(date_diff('day', (lag(ts) OVER w)::DATE, (lead(ts) OVER w)::DATE), 0) AS slope FROM n WINDOW w AS (PARTITION BY {PX} ORDER BY ts, oid))
SELECT {PX}, """ + ", ".join(f"{R6(f'arg_{f}({b}, (round({k}, 9), oid)) FILTER ({k} IS NOT NULL)')} AS {b}_{n}" for n, f, k in _AT for b in ("blue", "swir")) + " FROM r GROUP BY ALL")
def _(spark, sf_dir):
    rows = T.with_slopes(obs(spark, sf_dir).withColumn("k", ndi("nir", "red")), "k", "valid", tie=["oid"])
    key = lambda k: F.when(F.col(k).isNotNull(), F.struct(F.round(k, 9), "oid"))
    picks = [r6((F.max_by if f == "max" else F.min_by)(b, key(k))).alias(f"{b}_{n}") for n, f, k in _AT for b in ("blue", "swir")]
    return rows.groupBy("tile_id", "y", "x").agg(*picks)


_HOLES = f"{SER}, g AS (SELECT px, ts, oid, CASE WHEN valid THEN v END AS v FROM ser)"
_FWD = "last_value(v IGNORE NULLS) OVER (PARTITION BY px ORDER BY ts, oid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_BACK = "first_value(v IGNORE NULLS) OVER (PARTITION BY px ORDER BY ts, oid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
for _ops, _sql in {"f": _FWD, "b": _BACK, "fb": f"coalesce({_FWD}, {_BACK})", "bf": f"coalesce({_BACK}, {_FWD})"}.items():

    @query(f"w04_fill_{_ops}", f"{_HOLES} SELECT oid, {R6(_sql)} AS v FROM g")
    def _(spark, sf_dir, ops=_ops):
        rows = ser(spark, sf_dir).withColumn("v", F.when(F.col("valid"), F.col("v")))
        return T.fill(rows, "v", ops, ["px"], ORDER).select("oid", r6("v").alias("v"))


@query("w04_fill_band_axis", f"{PIX}, g AS (SELECT tile_id, y * 8 + x AS i, CASE WHEN v > 0 THEN v END AS v FROM pix) SELECT tile_id, i, {R6('last_value(v IGNORE NULLS) OVER (PARTITION BY tile_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS v FROM g")
def _(spark, sf_dir):
    bands = F.transform("embedding", lambda x: F.when(x > 0, x.cast("double")))
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tile_id"), F.posexplode(T.fill_array(bands)).alias("i", "v"))
    return rows.select("tile_id", F.col("i").cast("long").alias("i"), r6("v").alias("v"))


@query("w05_lower_percentile", f"{OBS}, q AS (SELECT {PX}, list_sort(list(swir))[1 + floor((count(*) - 1) * 0.4::DOUBLE)::INT] AS q FROM obs GROUP BY ALL) SELECT {PX}, arg_min(oid, (abs(swir - q), ts, oid)) AS oid FROM obs JOIN q USING (tile_id, y, x) GROUP BY ALL")
def _(spark, sf_dir):
    return T.lower_percentile(obs(spark, sf_dir), "swir", 40, time=ORDER).select("tile_id", "y", "x", "oid")


def _nearest_rank_sql(key: str, p: int, where: str = "true") -> str:
    return f"{OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY {PX} ORDER BY {key}, ts, oid) - 1 AS rk, count(*) OVER (PARTITION BY {PX}) AS n FROM obs WHERE {where} AND {key} IS NOT NULL) SELECT {PX}, oid, {R6('nir')} AS nir, {R6('swir')} AS swir FROM r WHERE rk = floor((n - 1) * ({p} / 100.0::DOUBLE) + 0.5::DOUBLE)"


def _composite(name: str, key, key_sql: str, p: int, where: str = "valid"):
    @query(name, _nearest_rank_sql(key_sql, p, where))
    def run(spark, sf_dir):
        rows = obs(spark, sf_dir).where(where).withColumn("key", key())
        return T.nearest_rank(rows, "key", p, time=ORDER).select("tile_id", "y", "x", "oid", r6("nir").alias("nir"), r6("swir").alias("swir"))


_composite("w06_nearest_rank", lambda: F.col("swir"), "swir", 60, "true")
_composite("w07_composite_of_valid", lambda: F.col("swir"), "swir", 50)
_composite("w08_blue_composite", lambda: F.col("blue"), "blue", 25)
_composite("w09_hot_composite", lambda: F.round(F.col("blue") - 0.5 * F.col("red") - 0.08, 9), "round(blue - 0.5::DOUBLE * red - 0.08::DOUBLE, 9)", 25)


@query("w10_max_ndvi_composite", f"{OBS}, k AS (SELECT *, {NDVI} AS k FROM obs WHERE valid), c AS (SELECT {PX}, median(k) AS med, arg_min(oid, (-k, ts, oid)) AS hi, arg_min(oid, (k, ts, oid)) AS lo FROM k WHERE k IS NOT NULL GROUP BY ALL) SELECT {PX}, CASE WHEN med < 0.6::DOUBLE THEN lo ELSE hi END AS oid FROM c")
def _(spark, sf_dir):
    rows = obs(spark, sf_dir).where("valid").withColumn("ndvi", ndi("nir", "red"))
    return T.max_ndvi_composite(rows, time=ORDER, water_below=0.6).select("tile_id", "y", "x", "oid")


@query("w11_max_ndwi_composite", f"{OBS}, k AS (SELECT *, (nir - swir) / nullif(nir + swir, 0) AS k FROM obs WHERE valid) SELECT {PX}, arg_min(oid, (-k, ts, oid)) AS oid FROM k WHERE k IS NOT NULL GROUP BY ALL")
def _(spark, sf_dir):
    rows = obs(spark, sf_dir).where("valid").withColumn("k", ndi("nir", "swir"))
    return T.extreme_composite(rows, "k", True, time=ORDER).select("tile_id", "y", "x", "oid")


@query("w12_max_ratio_composite", f"{OBS}, k AS (SELECT *, greatest(nir, swir) / nullif(blue, 0) AS k FROM obs WHERE valid) SELECT {PX}, arg_min(oid, (-k, ts, oid)) AS oid FROM k WHERE k IS NOT NULL GROUP BY ALL")
def _(spark, sf_dir):
    rows = obs(spark, sf_dir).where("valid").withColumn("k", F.try_divide(F.greatest("nir", "swir"), F.col("blue")))
    return T.extreme_composite(rows, "k", True, time=ORDER).select("tile_id", "y", "x", "oid")


@query("w13_reference_scenes", f"{OBS}, f AS (SELECT tile_id, ts, round(avg(valid::INT), 9) AS frac FROM obs GROUP BY ALL) SELECT tile_id, ts, {R6('frac')} AS frac FROM f QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY frac DESC, ts DESC) <= 3")
def _(spark, sf_dir):
    frames = obs(spark, sf_dir).groupBy("tile_id", "ts").agg(F.round(G.valid_fraction(), 9).alias("frac"))
    w = Window.partitionBy("tile_id").orderBy(F.desc("frac"), F.desc("ts"))
    return frames.withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("tile_id", "ts", r6("frac").alias("frac"))


@query("w14_histogram_matching", f"""{OBS}, c AS (SELECT {PX}, median(nir) AS r FROM obs GROUP BY ALL), m AS (SELECT tile_id, ts, avg(nir) AS ms, stddev_pop(nir) AS ss, avg(r) AS mr, stddev_pop(r) AS sr FROM obs JOIN c USING (tile_id, y, x) GROUP BY ALL)
SELECT oid, round(nir * (sr / ss) + (mr - ms * (sr / ss)), 4) + 0.0::DOUBLE AS nir FROM (SELECT tile_id, ts, ms, CASE WHEN ss > 1e-12::DOUBLE THEN ss END AS ss, mr, sr FROM m) m JOIN obs USING (tile_id, ts)""")
def _(spark, sf_dir):
    rows = obs(spark, sf_dir)
    composite = rows.groupBy("tile_id", "y", "x").agg(F.median("nir").alias("nir"))
    return T.histogram_match(rows, composite, ["nir"]).select("oid", (F.round("nir", 4) + F.lit(0.0)).alias("nir"))


def _interpolated(name: str, outside, sql_outside: str):
    sql = f"""{SER}, k AS (SELECT px, ts, avg(v) AS v FROM ser WHERE valid GROUP BY ALL), g AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-05', INTERVAL 7 DAY)) AS day0),
a AS (SELECT p.px, day0, l.ts AS lt, l.v AS lv FROM (SELECT DISTINCT px, day0 FROM k, g) p ASOF LEFT JOIN k l ON p.px = l.px AND p.day0 >= l.ts),
b AS (SELECT a.*, r.ts AS rt, r.v AS rv FROM a ASOF LEFT JOIN k r ON a.px = r.px AND a.day0 <= r.ts)
SELECT px, strftime(day0, '%Y-%m-%d') AS day, coalesce({R6("CASE WHEN lt = rt THEN lv ELSE lv + epoch_us(day0 - lt) / epoch_us(rt - lt) * (rv - lv) END")}, {sql_outside}) AS v FROM b"""

    @query(name, sql)
    def run(spark, sf_dir):
        rows = ser(spark, sf_dir).withColumn("v", F.when(F.col("valid"), F.col("v")))
        grid = F.expr("sequence(timestamp_ntz'2024-01-01', timestamp_ntz'2024-02-05', INTERVAL 7 DAYS)")
        return T.interpolate(rows, grid, ["px"], "ts", "v", outside).select("px", F.date_format("ts", "yyyy-MM-dd").alias("day"), r6("v").alias("v"))


_interpolated("w15_linear_interpolation", None, "NULL")
_interpolated("w16_interpolation_with_no_data", -1.0, "-1.0::DOUBLE")


@query("w17_relaxed_cloud_threshold", f"""{SER}, k AS (SELECT px, ts, oid, ceil(round(v / 490 / 0.05::DOUBLE, 9))::INT AS k FROM ser), e AS (SELECT * FROM k WHERE k < 21), n AS (SELECT *, row_number() OVER (PARTITION BY px ORDER BY k, ts) AS rn FROM e)
SELECT px, {R6("CASE WHEN a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL THEN greatest(a, b, c) END * 0.05::DOUBLE")} AS threshold FROM (SELECT px, min(k) FILTER (ts <= TIMESTAMP '2024-01-05') AS a, min(k) FILTER (ts >= TIMESTAMP '2024-01-25') AS b, min(k) FILTER (rn = 2) AS c FROM n GROUP BY px)""")
def _(spark, sf_dir):
    rows = ser(spark, sf_dir).withColumn("cloud", F.col("v") / 490)
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    return T.usable_threshold(rows, "cloud", at("2024-01-05"), at("2024-01-25"), ["px"]).select("px", r6("threshold").alias("threshold"))


@query("w19_circular_smoothing", f"{SER}, a AS (SELECT px, list(v ORDER BY ts, oid) AS s FROM ser GROUP BY px), u AS (SELECT px, s, unnest(range(1, len(s) + 1)) AS i FROM a) SELECT px, i, {R6(' + '.join(f's[((i - 1 + {k - 2} + 2 * len(s)) % len(s)) + 1] * {w}::DOUBLE' for k, w in enumerate((0.05, 0.6, 1, 0.6, 0.05))).join(['(', ') / 2.3::DOUBLE']))} AS v FROM u")
def _(spark, sf_dir):
    series = F.transform(F.array_sort(F.collect_list(F.struct("ts", "oid", "v"))), lambda s: s["v"])
    smooth = ser(spark, sf_dir).groupBy("px").agg(series.alias("s")).select("px", F.posexplode(T.circular_smooth(F.col("s"))).alias("i", "v"))
    return smooth.select("px", (F.col("i") + 1).cast("long").alias("i"), r6("v").alias("v"))


_DAILY = "SELECT px, ts::DATE AS d, {} AS v FROM ser GROUP BY ALL"


@query("w20_consecutive_dry_days", f"{SER}, d AS ({_DAILY.format('sum(v)')}), g AS (SELECT px, year(d)::INT AS year, date_diff('day', DATE '1970-01-01', d) - row_number() OVER (PARTITION BY px, year(d) ORDER BY d) AS island FROM d WHERE v < 120) SELECT px, year, max(n) AS longest FROM (SELECT px, year, island, count(*) AS n FROM g GROUP BY ALL) GROUP BY ALL")
def _(spark, sf_dir):
    return T.longest_dry_run(ser(spark, sf_dir), ["px"], "v", 120.0, order=["oid"])


for _i, (_name, (_how, _test, _limit)) in enumerate(T.CLIMATE.items(), 21):

    @query(f"w{_i}_{_name}", f"{SER}, d AS ({_DAILY.format(f'{_how}(v / 5 - 10)')}) SELECT px, year(d)::INT AS year, count(*) FILTER (v {_test} {_limit}::DOUBLE) AS days FROM d GROUP BY ALL")
    def _(spark, sf_dir, name=_name):
        return T.climate_days(ser(spark, sf_dir).withColumn("v", F.col("v") / 5 - 10), name, ["px"], "v", order=["oid"])


@query("w26_violent_precipitation", f"{SER}, s AS (SELECT px, ts, sum(v) OVER w AS s, count(*) OVER w AS n FROM ser WINDOW w AS (PARTITION BY px ORDER BY ts, oid ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT px, year(ts)::INT AS year, count(*) FILTER (n = 3 AND s > 150) AS events FROM s GROUP BY ALL")
def _(spark, sf_dir):
    return T.rolling_events(ser(spark, sf_dir), ["px"], "v", 3, 150.0, ORDER)


@query("w27_transform_chain", f"{SER}, d AS ({_DAILY.format('avg(v)')}) SELECT px, year(d)::INT AS year, count(*) FILTER (v > 60) AS days FROM d GROUP BY ALL")
def _(spark, sf_dir):
    return T.count_days(ser(spark, sf_dir), ["px"], "v", "mean", ">", 60.0, order=["oid"])


def _thin_sql(desc: bool, gap: int) -> str:
    step, order = ("<", "max") if desc else (">", "min")
    edge = f"t.ts {step} k.ts {'-' if desc else '+'} INTERVAL {gap} SECOND"
    return f"""WITH RECURSIVE t AS (SELECT DISTINCT user_id AS px, date_trunc('second', ts) AS ts FROM events),
k AS (SELECT px, {order}(ts) AS ts, 1 AS n FROM t GROUP BY px UNION ALL SELECT k.px, (SELECT {order}(t.ts) FROM t WHERE t.px = k.px AND {edge}), k.n + 1 FROM k WHERE k.ts IS NOT NULL)"""


@query("w28_thin_acquisitions", f"{_thin_sql(False, 86400)} SELECT px, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM k WHERE ts IS NOT NULL")
def _(spark, sf_dir):
    return T.thin(ser(spark, sf_dir), ["px"], "ts", 86400).select("px", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("w29_thin_in_reverse", f"{_thin_sql(True, 172800)}, c AS (SELECT px, count(ts) AS n FROM k GROUP BY px) SELECT px, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, c.n >= 4 AS enough FROM k JOIN c USING (px) WHERE ts IS NOT NULL AND k.n <= 4")
def _(spark, sf_dir):
    return T.thin(ser(spark, sf_dir), ["px"], "ts", 172800, True, 4).select("px", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "enough")


_WINDOWS = f"{FRAMES}, n AS (SELECT tile_id, max(t) + 1 AS n FROM fr GROUP BY tile_id), fc AS (SELECT DISTINCT tile_id, t, n, greatest(least(t - 5, n - 11), 0) AS lo FROM fr JOIN n USING (tile_id))"


def windows(frames):
    sized = frames.groupBy("tile_id").agg((F.max("t") + 1).alias("n"))
    distinct = frames.select("tile_id", "t").distinct().join(sized, "tile_id")
    low, past = T.context_bounds(F.col("t"), F.col("n"), 11)
    return distinct.select("tile_id", F.col("t").alias("mid"), low.alias("lo"), past.alias("past"))


@query("w30_context_window", f"{_WINDOWS} SELECT tile_id, t AS mid, lo, least(lo + 11, n) AS past FROM fc")
def _(spark, sf_dir):
    return windows(T.frame_numbers(obs(spark, sf_dir))).select("tile_id", F.col("mid").cast("int").alias("mid"), F.col("lo").cast("int").alias("lo"), F.col("past").cast("int").alias("past"))


@query("w31_statistics_in_window", f"""{_WINDOWS}, m AS (SELECT tile_id, t, avg(nir) AS v FROM fr GROUP BY ALL),
j AS (SELECT fc.tile_id, fc.t AS mid, count(*) AS n, min(m.v) AS low, avg(m.v) AS mean, any_value(c.v) AS target FROM fc JOIN m ON m.tile_id = fc.tile_id AND m.t >= fc.lo AND m.t < least(fc.lo + 11, fc.n) JOIN m c ON c.tile_id = fc.tile_id AND c.t = fc.t GROUP BY fc.tile_id, fc.t)
SELECT tile_id, mid, {R6('low')} AS low, {R6('mean')} AS mean, {R6('target - low')} AS above_low, {R6('target * (1 + 1 / nullif(n - 1, 0)) - n * mean / nullif(n - 1, 0)')} AS above_mean FROM j""")
def _(spark, sf_dir):
    frames = T.frame_numbers(obs(spark, sf_dir))
    per_frame = frames.groupBy("tile_id", "t").agg(F.avg("nir").alias("v"))
    spans = windows(frames).select("tile_id", "mid", F.explode(F.sequence(F.col("lo"), F.col("past") - 1)).alias("t"))
    stats = T.window_statistics(spans.join(per_frame, ["tile_id", "t"]), "v", ["tile_id", "mid"], "mid")
    return stats.select("tile_id", F.col("mid").cast("int").alias("mid"), *[r6(c).alias(c) for c in ("low", "mean", "above_low", "above_mean")])


@query("w32_combined_cloud_verdict", f"{OBS} SELECT oid, (clp > 0.4::DOUBLE AND swir > 0.5::DOUBLE AND is_data) AS cloud FROM obs")
def _(spark, sf_dir):
    return obs(spark, sf_dir).select("oid", ((F.col("clp") > 0.4) & (F.col("swir") > 0.5) & F.col("is_data")).alias("cloud"))


@query("w34_month_label", f"{SER} SELECT oid, month(ts)::INT AS month FROM ser")
def _(spark, sf_dir):
    return ser(spark, sf_dir).select("oid", F.month("ts").alias("month"))


@query("w35_time_normalisation", f"{OBS}, b AS (SELECT tile_id, min(ts)::DATE AS lo, max(ts)::DATE AS hi FROM obs GROUP BY tile_id) SELECT oid, {R6('''date_diff('day', lo, ts::DATE) / nullif(date_diff('day', lo, hi), 0)''')} AS t FROM obs JOIN b USING (tile_id)")
def _(spark, sf_dir):
    rows = obs(spark, sf_dir)
    limits = rows.groupBy("tile_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return rows.join(limits, "tile_id").select("oid", r6(F.try_divide(F.datediff("ts", "lo"), F.datediff("hi", "lo"))).alias("t"))


@query("flagship_valid_max_composite", f"{OBS}, g AS (SELECT tile_id, ts FROM obs GROUP BY ALL HAVING avg(valid::INT) > 0.5::DOUBLE), k AS (SELECT *, {NDVI} AS k FROM obs WHERE valid AND (tile_id, ts) IN (SELECT (tile_id, ts) FROM g)) SELECT {PX}, arg_min(oid, (-k, ts, oid)) AS oid, {R6('max(k)')} AS ndvi, count(*) AS n FROM k WHERE k IS NOT NULL GROUP BY ALL")
def _(spark, sf_dir):
    """The greatest-index composite of frames that are more than half valid."""
    rows = G.frames_above(obs(spark, sf_dir), 0.5).where("valid").withColumn("ndvi", ndi("nir", "red")).where("ndvi IS NOT NULL")
    best = F.min(F.struct((-F.col("ndvi")).alias("k"), "ts", "oid"))
    return rows.groupBy("tile_id", "y", "x").agg(best.alias("m"), F.count("*").alias("n")).select("tile_id", "y", "x", "m.oid", r6(-F.col("m.k")).alias("ndvi"), "n")
