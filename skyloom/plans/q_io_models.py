"""Queries of sources, models, hooks for user functions, and streaming jobs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from skyloom.operators import models as M
from skyloom.operators import timeseries as T
from skyloom.plans.catalog import load, query
from skyloom.plans.staging import shared_dir
from skyloom.plans.standins import OBS, PIX, R6, SER, obs, pix, r6, ser
from skyloom.sources import formats as I
from skyloom.streaming import jobs as X
from skyloom.streaming import stateful as S


def _scratch(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- sources and sinks


@query("s01_load_wanted_features", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def _(spark, sf_dir):
    return I.read_columns(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"], "l_quantity > 45")


@query("s02_save_by_tile", f"{OBS} SELECT tile_id, count(*) AS n FROM obs GROUP BY tile_id")
def _(spark, sf_dir):
    path = _scratch(spark, "tiles")
    I.write_tiles(obs(spark, sf_dir).hint("rebalance", "tile_id"), path, ["tile_id", "oid", "nir"])
    return spark.read.parquet(path).groupBy(F.col("tile_id").cast("long").alias("tile_id")).agg(F.count("*").alias("n"))


@query("s03_save_valid_tiles", f"{OBS} SELECT tile_id, y, x, count(*) AS n FROM obs GROUP BY ALL HAVING bool_and(valid)")
def _(spark, sf_dir):
    rows = obs(spark, sf_dir).withColumn("tile", F.struct("tile_id", "y", "x"))
    return I.only_valid_tiles(rows, F.col("valid"), "tile").groupBy("tile_id", "y", "x").agg(F.count("*").alias("n"))


_FEATURES = "SELECT c_custkey AS id, round(c_acctbal, 2) AS lon, (c_custkey * 37 % 9000)::DOUBLE AS lat FROM customer"


def features(spark, sf_dir):
    return load(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "round(c_acctbal, 2) AS lon", "cast(c_custkey * 37 % 9000 as double) AS lat")


@query("s04_read_geojson", _FEATURES)
def _(spark, sf_dir):
    path = _scratch(spark, "geojson")
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    feature = F.struct(F.struct("id").alias("properties"), point.alias("geometry"))
    # a collection of at most a thousand features is one line
    line = F.floor(F.monotonically_increasing_id() / 1000).alias("line")
    collections = features(spark, sf_dir).groupBy(line).agg(F.collect_list(feature).alias("features"))
    collections.select(F.to_json(F.struct("features")).alias("value")).write.text(path)
    rows = spark.read.text(path).select(F.explode(I.geojson_features(F.col("value"))).alias("f"))
    return rows.select(F.col("f.properties.id").cast("long").alias("id"), I.point_of(F.col("f.geometry.coordinates")).alias("p")).select("id", F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))


@query("s05_vector_layer_in_box", "SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 100 AND 3000 AND (c_custkey * 37 % 9000) BETWEEN 500 AND 6000")
def _(spark, sf_dir):
    boxes = load(spark, sf_dir, "customer").selectExpr("c_custkey", "c_acctbal AS min_x", "c_acctbal AS max_x", "c_custkey * 37 % 9000 AS min_y", "c_custkey * 37 % 9000 AS max_y")
    return I.within_bbox(boxes, 100, 500, 3000, 6000).select("c_custkey")


@query("s06_collection_by_box_and_predicate", "SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 100 AND 3000 AND c_mktsegment = 'BUILDING'")
def _(spark, sf_dir):
    boxes = load(spark, sf_dir, "customer").selectExpr("c_custkey", "c_mktsegment", "c_acctbal AS min_x", "c_acctbal AS max_x", "0 AS min_y", "0 AS max_y")
    return I.within_bbox(boxes, 100, -1, 3000, 1, F.col("c_mktsegment") == "BUILDING").select("c_custkey")


@query("s07_located_posts", f"SELECT event_id, {R6('value')} AS lat, {R6('user_id')} AS lon FROM events WHERE event_id % 3 = 0")
def _(spark, sf_dir):
    geo = F.when(F.col("event_id") % 3 == 0, F.struct(F.lit("Point").alias("type"), F.array(F.col("value"), F.col("user_id").cast("double")).alias("coordinates")))
    posts = load(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", geo.alias("geo"))).alias("j"))
    parsed = posts.select(F.from_json("j", "event_id long, geo struct<type:string,coordinates:array<double>>").alias("p")).select("p.*")
    return I.located_posts(parsed).select("event_id", r6("point.lat").alias("lat"), r6("point.lon").alias("lon"))


@query("s08_ids_in_batches", "SELECT count(DISTINCT o_custkey) AS ids, true AS bounded FROM orders")
def _(spark, sf_dir):
    lines = load(spark, sf_dir, "orders").select(F.concat(F.col("o_custkey").cast("string"), F.lit(" ")).alias("line")).unionAll(load(spark, sf_dir, "nation").select("n_name"))
    sizes = I.id_batches(lines, "line").groupBy("batch").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("ids"), (F.max("n") <= 100).alias("bounded"))


@query("s09_mapping_table", "SELECT n_nationkey, n_name FROM nation")
def _(spark, sf_dir):
    path = _scratch(spark, "mapping")
    named = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("﻿n_nationkey"), "n_name")
    named.write.csv(path, sep=";", header=True)
    return I.read_mapping(spark, path).select(F.col("n_nationkey").try_cast("int").alias("n_nationkey"), "n_name")


@query("s10_flatten_statistics", f"SELECT event_type AS zone, strftime(ts, '%Y-%m-%d') AS day, {R6('min(value)')} AS min, {R6('max(value)')} AS max, NULL::DOUBLE AS mean FROM events GROUP BY ALL")
def _(spark, sf_dir):
    day = F.date_format("ts", "yyyy-MM-dd")
    per = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("zone"), day.alias("day")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    stats = F.struct(F.col("lo").alias("min"), F.col("hi").alias("max"), F.lit("NaN").alias("mean"))
    band = F.struct(F.create_map(F.lit("B0"), F.struct(stats.alias("stats"))).alias("bands"))
    entry = F.struct(F.struct(F.col("day").alias("from"), F.col("day").alias("to")).alias("interval"), F.create_map(F.lit("default"), band).alias("outputs"))
    response = per.groupBy("zone").agg(F.to_json(F.struct(F.collect_list(entry).alias("data"))).alias("response"))
    return I.flatten_statistics(response, "response", ["B0"]).select("zone", F.col("interval_from").alias("day"), r6("min").alias("min"), r6("max").alias("max"), r6("mean").alias("mean"))


def _weather(spark, sf_dir):
    """A response for each twenty tiles: they are places on a grid of four columns, their values the hourly steps."""
    rows = load(spark, sf_dir, "embeddings").select(F.expr("vec_id div 20").alias("run"), "vec_id", "embedding")
    packed = rows.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("s"))
    data = F.flatten(F.transform("s", lambda x: F.transform(x["embedding"], lambda v: v.cast("double"))))
    lons = F.transform("s", lambda x: x["vec_id"].cast("double"))
    start = F.lit(1704067200).cast("long")
    interval = F.struct(start.alias("start"), (start + 3600 * F.size(F.element_at("s", 1)["embedding"])).alias("end"), F.lit(3600).cast("long").alias("stride"), F.lit(None).cast("array<string>").alias("timestrings"))
    code = F.struct(F.lit(11).alias("code"), F.lit("2 m").alias("level"), F.lit("mean").alias("aggregation"), F.array(F.struct(data.alias("data"))).alias("timeIntervals"))
    return packed.select("run", F.struct(lons.alias("lats"), lons.alias("lons"), F.lit(4).alias("nx"), F.lit(5).alias("ny"), F.array(interval).alias("timeIntervals"), F.array(code).alias("codes")).alias("response"))


_WEATHER = "SELECT run, vec_id, pos, i, v FROM (SELECT vec_id // 20 AS run, vec_id, row_number() OVER (PARTITION BY vec_id // 20 ORDER BY vec_id) - 1 AS pos, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)"


@query("s11_weather_rows", f"SELECT run, vec_id::DOUBLE AS lon, strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (i - 1), '%Y-%m-%d %H:%M') AS time, '11_2 m_mean' AS variable, {R6('v')} AS value FROM ({_WEATHER})")
def _(spark, sf_dir):
    rows = I.weather_rows(_weather(spark, sf_dir), "response")
    return rows.select("run", "lon", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("time"), "variable", r6("value").alias("value"))


@query("s12_weather_grid", f"SELECT run, (pos % 4)::INT AS x, (4 - pos // 4)::INT AS y, {R6('sum(v)')} AS value FROM ({_WEATHER}) GROUP BY ALL")
def _(spark, sf_dir):
    grid = I.weather_grid(I.weather_rows(_weather(spark, sf_dir), "response"), 4, 5)
    return grid.groupBy("run", "x", "y").agg(r6(F.sum("value")).alias("value"))


@query("s13_time_axis", "SELECT user_id, 24 AS regular, strftime(min(ts), '%Y%m%dT%H%M') AS first FROM events GROUP BY user_id")
def _(spark, sf_dir):
    start = F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))
    named = F.concat(F.date_format("first", "yyyyMMdd'T'HHmm"), F.lit("-20300101T0000"))
    rows = load(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first"))
    kinds = lambda strings: F.struct(start.alias("start"), (start + 86400).alias("end"), F.lit(3600).cast("long").alias("stride"), strings.alias("timestrings"))
    regular = F.size(I.interval_times(kinds(F.lit(None).cast("array<string>"))))
    from_name = F.element_at(I.interval_times(kinds(F.array(named))), 1)
    return rows.select("user_id", regular.alias("regular"), F.date_format(from_name, "yyyyMMdd'T'HHmm").alias("first"))


@query("s14_raster_to_rows", f"{PIX} SELECT tile_id, y::INT AS y, x::INT AS x, tile_id * 64 + y * 8 + x AS p_id, {R6('tile_id * 80 + x * 10 + 5')} AS cx, {R6('80 - y * 10 - 5')} AS cy, {R6('v')} AS v FROM pix")
def _(spark, sf_dir):
    raster = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("embedding", r * 8 + 1, 8))
    tiles = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tile_id"), (F.col("vec_id") * 80.0).alias("min_x"), F.lit(80.0).alias("max_y"), raster.alias("raster"))
    return I.raster_rows(tiles, "raster", 10.0).select("tile_id", "y", "x", "p_id", r6("cx").alias("cx"), r6("cy").alias("cy"), r6(F.col("v").cast("double")).alias("v"))


@query("s15_rows_to_raster", f"SELECT vec_id AS tile_id, {R6('embedding[1]')} AS first, {R6('embedding[64]')} AS last, len(embedding) AS n FROM embeddings")
def _(spark, sf_dir):
    return I.rows_to_raster(pix(spark, sf_dir), "v").select("tile_id", r6(F.element_at("values", 1)).alias("first"), r6(F.element_at("values", -1)).alias("last"), F.size("values").cast("long").alias("n"))


@query("s16_write_csv_and_features", "SELECT c_custkey AS id, true AS same FROM customer")
def _(spark, sf_dir):
    a, b = _scratch(spark, "csv"), _scratch(spark, "features")
    rows = features(spark, sf_dir)
    I.write_csv(rows, a)
    I.write_features(rows, b, ["id"])
    csv = spark.read.csv(a, header=True, schema="id long, lon double, lat double")
    back = spark.read.schema("properties struct<id:long>, geometry struct<coordinates:array<double>>").json(b).select("properties.id", F.element_at("geometry.coordinates", 1).alias("lon2"))
    return csv.join(back, "id").select("id", (F.abs(F.col("lon") - F.col("lon2")) < 1e-9).alias("same"))


@query("s17_search_catalog", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderstatus = 'F' AND o_orderdate BETWEEN '1996-01-01' AND '1996-12-31' AND o_custkey BETWEEN 10 AND 900")
def _(spark, sf_dir):
    catalog = load(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderstatus AS collection", "o_orderdate AS ts", "o_custkey AS min_x", "o_custkey AS max_x", "0 AS min_y", "0 AS max_y")
    found = I.search_catalog(catalog, "F", "1996-01-01", "1996-12-31", ["o_orderkey", "ts"], (10, -1, 900, 1))
    return found.select("o_orderkey", F.date_format("ts", "yyyy-MM-dd").alias("day"))


# ---- models


def _pixels(spark, sf_dir):
    return obs(spark, sf_dir).select("oid", "blue", "red", "nir", "swir", (F.col("nir") + F.col("swir") > 1.0).cast("int").alias("label"))


BANDS = ["blue", "red", "nir", "swir"]


@query("m01_boosted_trees")
def _(spark, sf_dir):
    rows = _pixels(spark, sf_dir)
    model = M.train_trees(rows, BANDS, "label", rounds=5)
    scored = M.score(model, rows)
    return scored.groupBy("label").agg(F.count("*").alias("n"), (F.avg((F.col("prediction") == F.col("label")).cast("int")) > 0.9).alias("accurate"))


@query("m02_score_pixels", f"{OBS} SELECT (nir + swir > 1.0::DOUBLE)::INT AS label, count(*) AS n, true AS accurate FROM obs GROUP BY 1")
def _(spark, sf_dir):
    rows = _pixels(spark, sf_dir)
    model = M.train_scaled_logistic(rows, BANDS, "label")
    return M.score(model, rows).groupBy("label").agg(F.count("*").alias("n"), (F.avg(F.abs(F.col("probability_1") - F.col("label"))) < 0.2).alias("accurate"))


@query("m03_scale_then_predict", f"{OBS} SELECT tile_id, count(*) AS n, true AS accurate FROM obs GROUP BY tile_id")
def _(spark, sf_dir):
    rows = obs(spark, sf_dir).withColumn("label", (F.col("nir") > 0.5).cast("int"))
    scored = M.score(M.train_scaled_logistic(rows, BANDS, "label"), rows)
    return scored.groupBy("tile_id").agg(F.count("prediction").alias("n"), (F.avg((F.col("prediction") == F.col("label")).cast("int")) > 0.95).alias("accurate"))


@query("m04_cross_validated_logistic", f"{OBS} SELECT (nir + swir > 1.0::DOUBLE)::INT AS label, count(*) AS n, true AS accurate FROM obs GROUP BY 1")
def _(spark, sf_dir):
    rows = _pixels(spark, sf_dir)
    model = M.train_scaled_logistic(rows, BANDS, "label", folds=10)
    return model.transform(rows).groupBy("label").agg(F.count("prediction").alias("n"), (F.avg((F.col("prediction") == F.col("label")).cast("int")) > 0.9).alias("accurate"))


@query("m05_linear_regression", f"{OBS} SELECT {R6('regr_slope(swir, nir)')} AS slope, {R6('regr_intercept(swir, nir)')} AS intercept, {R6('regr_r2(swir, nir)')} AS r2 FROM obs")
def _(spark, sf_dir):
    return M.linear_regression(obs(spark, sf_dir), "swir", "nir").select(*[r6(c).alias(c) for c in ("slope", "intercept", "r2")])


@query("m07_clean_rows", f"{OBS} SELECT oid FROM obs WHERE valid AND red > 0")
def _(spark, sf_dir):
    rows = obs(spark, sf_dir).withColumn("a", F.when(F.col("valid"), F.col("nir"))).withColumn("b", F.when(F.col("red") > 0, F.col("red")).otherwise(F.lit(float("inf"))))
    return M.clean_rows(rows, ["a", "b"]).select("oid")


@query("m08_batch_inference", f"{OBS} SELECT oid, {R6('1 / (1 + exp(-(2 * nir - swir)))')} AS p FROM obs")
def _(spark, sf_dir):
    import numpy as np

    def model(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"p": 1 / (1 + np.exp(-(2 * pdf["nir"] - pdf["swir"])))})

    return M.predict_batches(obs(spark, sf_dir).select("oid", "nir", "swir"), model, "p double", ["oid"]).select("oid", r6("p").alias("p"))


@query("m09_feature_importance")
def _(spark, sf_dir):
    return M.importances(M.train_trees(_pixels(spark, sf_dir), BANDS, "label", rounds=3), BANDS)


_SPLINE = f"""{SER.replace('WITH', 'WITH RECURSIVE', 1)}, d AS (SELECT px, date_diff('day', DATE '1970-01-01', ts::DATE)::DOUBLE AS t, avg(v) AS v FROM ser GROUP BY ALL),
s AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY px) AS n, t - lag(t) OVER w AS h0, lead(t) OVER w - t AS h1, lag(v) OVER w AS v0, lead(v) OVER w AS v1, lead(t) OVER w AS t1 FROM d WINDOW w AS (PARTITION BY px ORDER BY t)),
f AS (SELECT px, i, n, 0.0::DOUBLE AS c, 0.0::DOUBLE AS e FROM s WHERE i = 1 UNION ALL SELECT s.px, s.i, s.n, h1 / (2 * (h0 + h1) - h0 * f.c), (6 * ((v1 - v) / h1 - (v - v0) / h0) - h0 * f.e) / (2 * (h0 + h1) - h0 * f.c) FROM f JOIN s ON s.px = f.px AND s.i = f.i + 1 WHERE s.i < s.n),
b AS (SELECT px, i, 0.0::DOUBLE AS m FROM s WHERE i = n UNION ALL SELECT f.px, f.i, f.e - f.c * b.m FROM b JOIN f ON f.px = b.px AND f.i = b.i - 1 WHERE f.i > 1),
k AS (SELECT s.*, coalesce(b.m, 0) AS m, lead(coalesce(b.m, 0)) OVER (PARTITION BY s.px ORDER BY s.i) AS m1 FROM s LEFT JOIN b ON b.px = s.px AND b.i = s.i),
a AS (SELECT px, unnest(range(min(t)::INT, max(t)::INT + 1, 7)) AS day FROM d GROUP BY px)
SELECT a.px, a.day::INT AS day, {R6('(t1 - day) / h1 * v + (day - t) / h1 * v1 + ((((t1 - day) / h1) ** 3 - (t1 - day) / h1) * m + (((day - t) / h1) ** 3 - (day - t) / h1) * m1) * h1 * h1 / 6')} AS v
FROM a JOIN k ON k.px = a.px AND k.i = (SELECT greatest(1, least(max(n) - 1, count(*) FILTER (s.t <= a.day))) FROM s WHERE s.px = a.px)"""


@query("w18_spline_resampling", _SPLINE)
def _(spark, sf_dir):
    return M.spline_resample(ser(spark, sf_dir), "px", "ts", "v", 7).select("px", "day", r6("v").alias("v"))


@query("w33_doubly_logistic_fit")
def _(spark, sf_dir):
    return M.doubly_logistic_fit(ser(spark, sf_dir), "px", "ts", "v")


# ---- hooks for user functions


@query("u01_chained_tasks", f"{SER} SELECT class, {R6('avg(v * 2 + 1)')} AS mean FROM ser WHERE valid GROUP BY class")
def _(spark, sf_dir):
    only_valid = lambda d: d.where("valid")
    scaled = lambda d, k: d.withColumn("v", F.col("v") * k + 1)
    return ser(spark, sf_dir).transform(only_valid).transform(scaled, 2).groupBy("class").agg(r6(F.avg("v")).alias("mean"))


@query("u03_zip_features", f"{OBS} SELECT oid, {R6('nir * 0.6::DOUBLE + swir * 0.4::DOUBLE')} AS mixed FROM obs")
def _(spark, sf_dir):
    from skyloom.functions.algebra import zip_with

    return obs(spark, sf_dir).select("oid", r6(zip_with(lambda a, b: a * 0.6 + b * 0.4, "nir", "swir")).alias("mixed"))


@query("u04_user_aggregation", f"{SER} SELECT px, {R6('max(v) - min(v)')} AS spread FROM ser GROUP BY px")
def _(spark, sf_dir):
    spread = lambda c: F.max(c) - F.min(c)
    return ser(spark, sf_dir).groupBy("px").agg(r6(spread("v")).alias("spread"))


@query("u05_frame_predicate", f"{OBS} SELECT oid FROM obs WHERE (tile_id, ts) IN (SELECT (tile_id, ts) FROM obs GROUP BY ALL HAVING max(clp) <= 0.6::DOUBLE)")
def _(spark, sf_dir):
    rows = obs(spark, sf_dir)
    clear = rows.groupBy("tile_id", "ts").agg((F.max("clp") <= 0.6).alias("ok")).where("ok").select("tile_id", "ts")
    return rows.join(clear, ["tile_id", "ts"], "left_semi").select("oid")


@query("u06_python_per_row", f"{SER} SELECT oid, {R6('v * v')} AS squared FROM ser")
def _(spark, sf_dir):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"oid": pdf["oid"], "squared": pdf["v"] ** 2})

    return ser(spark, sf_dir).select("oid", "v").mapInPandas(run, "oid long, squared double").select("oid", r6("squared").alias("squared"))


@query("u07_fan_out_over_arguments", f"{SER} SELECT k, count(*) FILTER (v > k * 50) AS n FROM ser, range(0, 5) r(k) GROUP BY k")
def _(spark, sf_dir):
    arguments = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))
    return ser(spark, sf_dir).withColumn("k", arguments).groupBy("k").agg(F.count_if(F.col("v") > F.col("k") * 50).alias("n"))


@query("u08_table_valued_function", "SELECT user_id, part, n FROM (SELECT user_id, unnest(['low', 'high']) AS part, unnest([count(*) FILTER (value <= 50), count(*) FILTER (value > 50)]) AS n FROM events GROUP BY user_id)")
def _(spark, sf_dir):
    @F.udtf(returnType="part string, n long")
    class Halves:
        def eval(self, low: int, high: int):
            yield "low", low
            yield "high", high

    counts = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("value") <= 50).alias("low"), F.count_if(F.col("value") > 50).alias("high"))
    return counts.lateralJoin(Halves(F.col("low").outer(), F.col("high").outer())).select("user_id", "part", "n")


@query("u09_slice_by_slice", f"{PIX} SELECT tile_id, y, {R6('avg(v)')} AS mean FROM pix GROUP BY ALL")
def _(spark, sf_dir):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.groupby(["tile_id", "y"], as_index=False).agg(mean=("v", "mean"))

    out = pix(spark, sf_dir).select("tile_id", "y", "v").groupBy("tile_id").applyInPandas(run, "tile_id long, y long, mean double")
    return out.select("tile_id", "y", r6("mean").alias("mean"))


# ---- streaming, run over all files that are there


def _stream(spark, sf_dir, late="40 days", twice=False):
    events = load(spark, sf_dir, "events")
    path = _scratch(spark, "arrivals")
    (events.unionAll(events) if twice else events).repartitionByRange(4, "ts").write.parquet(path)
    return X.read_new(spark, path, events.schema, late=late)


@query("x01_ingest_exactly_once", "SELECT event_id FROM events")
def _(spark, sf_dir):
    return X.drain(X.once_each(_stream(spark, sf_dir, twice=True), ["event_id"]).select("event_id"), "once", "append", _scratch(spark, "x01")).select("event_id")


@query("x02_anomaly_against_baseline", f"{SER}, b AS (SELECT px, month(ts) AS m, avg(v) AS mean, stddev_pop(v) AS sd FROM ser GROUP BY ALL) SELECT oid, round((mean - v) / CASE WHEN sd > 1e-12::DOUBLE THEN sd END, 4) + 0.0::DOUBLE AS anomaly FROM ser s JOIN b USING (px) WHERE b.m = month(s.ts)")
def _(spark, sf_dir):
    from skyloom.operators.aggregates import baseline

    base = baseline(load(spark, sf_dir, "events"), "value", ["user_id"])
    out = X.stream_anomalies(_stream(spark, sf_dir), base, "value", ["user_id"])
    return X.drain(out.select(F.col("event_id").alias("oid"), (F.round("anomaly", 4) + F.lit(0.0)).alias("anomaly")), "anomaly", "append", _scratch(spark, "x02")).select("oid", "anomaly")


@query("x03_tumbling_statistics", f"SELECT event_type, strftime(time_bucket(INTERVAL 2 DAY, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS day, {R6('min(value)')} AS min, {R6('max(value)')} AS max, {R6('avg(value)')} AS mean, count(value) AS n FROM events GROUP BY ALL")
def _(spark, sf_dir):
    stats = X.interval_statistics(_stream(spark, sf_dir), ["event_type"], "value", "2 days")
    got = X.drain(stats, "stats", "update", _scratch(spark, "x03"))
    latest = got.groupBy("event_type", "interval_from").agg(F.max(F.struct("__batch", "min", "max", "mean", "n")).alias("s")).select("event_type", "interval_from", "s.*")
    return latest.select("event_type", F.date_format("interval_from", "yyyy-MM-dd").alias("day"), r6("min").alias("min"), r6("max").alias("max"), r6("mean").alias("mean"), "n")


@query("x04_sliding_alerts", f"WITH w AS (SELECT user_id, ts, value, unnest([0, 1, 2]) AS k FROM events) SELECT user_id, strftime(date_trunc('hour', ts) - INTERVAL 1 HOUR * k, '%Y-%m-%d %H') AS hour, {R6('sum(value)')} AS total FROM w GROUP BY ALL HAVING sum(value) > 150")
def _(spark, sf_dir):
    alerts = X.sliding_alerts(_stream(spark, sf_dir), ["user_id"], "value", "3 hours", "1 hour", 150.0)
    got = X.drain(alerts, "alerts", "update", _scratch(spark, "x04"))
    latest = got.groupBy("user_id", "window_from").agg(F.max_by("total", "__batch").alias("total"))
    return latest.select("user_id", F.date_format("window_from", "yyyy-MM-dd HH").alias("hour"), r6("total").alias("total"))


@query("x05_acquisition_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, count(DISTINCT s) AS sessions, count(*) AS n FROM s GROUP BY user_id")
def _(spark, sf_dir):
    events, path, mark = load(spark, sf_dir, "events"), _scratch(spark, "arrivals"), _scratch(spark, "x05")
    events.repartitionByRange(4, "ts").write.parquet(path)
    _close(spark, events, path)
    stream = X.without_marks(X.read_new(spark, path, events.schema, late="40 days"), "event_id")
    sessions = X.drain(X.acquisition_sessions(stream, ["user_id"], "1 day"), "sessions", "append", mark)
    return sessions.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


def _close(spark, events, path: str, after: str = "90 days") -> None:
    last = events.agg(F.max("ts").alias("ts")).first()["ts"]
    if last is not None:
        X.closing_mark(spark, path, events.schema, F.lit(last) + F.expr(f"INTERVAL {after}"))


@query("x08_idempotent_sink", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, sf_dir):
    out, mark = _scratch(spark, "x08"), _scratch(spark, "x08-mark")
    X.write_idempotent(_stream(spark, sf_dir).select("event_id", "event_type"), out, ["event_type"], mark).awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query("x06_running_dry_spells", f"""WITH d AS (SELECT user_id, ts::DATE AS day, sum(value) AS v FROM events GROUP BY ALL), g AS (SELECT *, date_diff('day', DATE '1970-01-01', day)::INT AS n, max(day) OVER (PARTITION BY user_id) AS last FROM d),
i AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, v < 120 ORDER BY n) AS island FROM g), l AS (SELECT user_id, island, v < 120 AS dry, n AS last_day FROM i WHERE day = last)
SELECT l.user_id, any_value(last_day) AS last_day, (count(*) FILTER (dry))::INT AS length FROM l JOIN i ON i.user_id = l.user_id AND i.island = l.island AND (i.v < 120) = dry GROUP BY l.user_id""")
def _(spark, sf_dir):
    """The raw events stream in; a user's last run comes out once a closing mark has moved the watermark past its last day."""
    events, path, mark = load(spark, sf_dir, "events"), _scratch(spark, "days"), _scratch(spark, "x06")
    events.repartitionByRange(4, "ts").write.parquet(path)
    _close(spark, events, path)
    spells = S.dry_spells(X.without_marks(X.read_new(spark, path, events.schema, late="40 days"), "event_id"), "user_id", "value", 120.0)
    got = X.drain(spells, "spells", "append", mark).where("kind = 'run'")
    return got.groupBy("user_id").agg(F.max("last_day").alias("last_day"), F.max_by("length", "last_day").alias("length"))


_LATE = "event_id % 10 = 3"
_LATE_SQL = f"""WITH e AS (SELECT *, {_LATE} AS late, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 DAY AS closes FROM events),
w AS (SELECT max(ts) - INTERVAL 5 DAY AS mark FROM e WHERE NOT late)"""


def _late_stream(spark, sf_dir, name: str):
    """Two deliveries into one folder, each of as many files as it has tasks: all but a tenth of the events, then those; a closing mark ends all days."""
    events, path, mark, got = load(spark, sf_dir, "events"), _scratch(spark, "late"), _scratch(spark, name), None
    for arrived in (f"NOT {_LATE}", _LATE, None):
        if arrived:
            events.where(arrived).write.mode("append").parquet(path)
        else:
            _close(spark, events, path)
        stream = X.without_marks(X.read_new(spark, path, events.schema, late="5 days"), "event_id")
        got = X.drain(S.daily_counts_and_late(stream, ["event_type"], "event_id"), "late", "append", mark)
    return got


@query("x07_late_data_policy", f"{_LATE_SQL} SELECT event_type, count(*) AS batch, count(*) FILTER (NOT late OR closes > mark) AS streamed, count(*) FILTER (late AND closes <= mark) AS dropped FROM e, w GROUP BY event_type")
def _(spark, sf_dir):
    """A tenth of the events arrive after the watermark has passed most of their days: what the stream counted, what it dropped, and the batch run over all."""
    got = _late_stream(spark, sf_dir, "x07").groupBy("event_type").agg(F.sum(F.when(F.col("kind") == "day", F.col("n")).otherwise(0)).alias("streamed"), F.count_if(F.col("kind") == "late").alias("dropped"))
    batch = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("batch"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return batch.join(got, "event_type", "left").select("event_type", "batch", zero("streamed"), zero("dropped"))


@query("x07_dropped_rows", f"{_LATE_SQL} SELECT event_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM e, w WHERE late AND closes <= mark")
def _(spark, sf_dir):
    """The rows that the stream dropped, from its own side output."""
    late = _late_stream(spark, sf_dir, "x07-rows").where("kind = 'late'")
    return late.select(F.col("id").alias("event_id"), "event_type", F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyy-MM-dd").alias("day"))


@query("x07_reconciled_days", "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf_dir):
    """Daily counts as the stream closed them, mended by its late rows: equal to a batch run."""
    got = _late_stream(spark, sf_dir, "x07-days").groupBy("event_type", "day").agg(F.sum("n").alias("n"))
    return got.select("event_type", F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyy-MM-dd").alias("day"), "n")
