"""Readers and writers of the file shapes that observations, labels and statistics come in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_columns(spark: SparkSession, path: str, columns: Sequence[str], where: str | None = None) -> DataFrame:
    """Only the wanted columns and rows of a Parquet table: both reach the scan."""
    rows = spark.read.parquet(path)
    return (rows.where(where) if where else rows).select(*columns)


def write_tiles(df: DataFrame, path: str, columns: Sequence[str] | None = None, by: Sequence[str] = ("tile_id",)) -> None:
    """Write by tile; the tiles at hand replace their former files, and others stay."""
    out = df.select(*columns) if columns else df
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def only_valid_tiles(df: DataFrame, check: Column, by: str = "tile_id") -> DataFrame:
    """Rows of the tiles whose every row passes the check; null fails."""
    good = df.groupBy(by).agg(F.bool_and(F.coalesce(check, F.lit(False))).alias("__ok")).where("__ok").select(by)
    return df.join(good, by, "left_semi")


GEOMETRY = "struct<type:string,coordinates:string>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """``(properties, type, coordinates)`` of every feature of whole GeoJSON files; coordinates stay JSON text."""
    schema = f"features array<struct<properties:map<string,string>,geometry:{GEOMETRY}>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return rows.select("f.properties", "f.geometry.type", "f.geometry.coordinates")


def geojson_features(text: Column) -> Column:
    """The features of a GeoJSON text as an array."""
    return F.from_json(text, f"features array<struct<properties:map<string,string>,geometry:{GEOMETRY}>>")["features"]


def point_of(coordinates: Column) -> Column:
    """``struct<x, y>`` of a point's coordinates as JSON text."""
    xy = F.from_json(coordinates, "array<double>")
    return F.struct(F.element_at(xy, 1).alias("x"), F.element_at(xy, 2).alias("y"))


def within_bbox(df: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float, where: Column | None = None) -> DataFrame:
    """Rows whose box meets the given one: plain comparisons, which the scan can use to skip row groups."""
    meets = (F.col("min_x") <= max_x) & (F.col("max_x") >= min_x) & (F.col("min_y") <= max_y) & (F.col("max_y") >= min_y)
    return df.where(meets if where is None else meets & where)


def located_posts(posts: DataFrame, geo: str = "geo") -> DataFrame:
    """Posts with a place, as features with (lon, lat) in place of (lat, lon)."""
    c = F.col(f"{geo}.coordinates")
    feature = F.struct(F.element_at(c, 2).alias("lon"), F.element_at(c, 1).alias("lat"))
    return posts.where(F.col(geo).isNotNull() & (F.size(c) == 2)).withColumn("point", feature).drop(geo)


def id_batches(lines: DataFrame, column: str, size: int = 100) -> DataFrame:
    """``(id, batch)``: ids that parse, in batches of at most so many.

    Ids are first cut into ranges by a range partitioning of their own, so the batch number
    counts ranges and then rows in a range; no window spans the whole table.
    """
    ids = lines.select(F.trim(F.col(column)).try_cast("long").alias("id")).where("id IS NOT NULL").distinct()
    part = F.spark_partition_id()
    from pyspark.sql.window import Window

    placed = ids.repartitionByRange("id").withColumn("__part", part)
    order = F.row_number().over(Window.partitionBy("__part").orderBy("id")) - 1
    return placed.withColumn("batch", F.struct("__part", F.floor(order / size).alias("n"))).drop("__part")


def read_mapping(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """A separated table with a header; a byte-order mark before the first name is dropped."""
    rows = spark.read.csv(path, sep=sep, header=True)
    return rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])


def flatten_statistics(df: DataFrame, column: str, bands: Sequence[str]) -> DataFrame:
    """One row for each interval and band of a statistics response: min, max, mean, stDev, sampleCount as doubles."""
    stats = "struct<min:string,max:string,mean:string,stDev:string,sampleCount:string,noDataCount:string>"
    band = f"struct<bands:map<string,struct<stats:{stats}>>>"
    parsed = F.from_json(F.col(column), f"data array<struct<interval:struct<`from`:string,`to`:string>,outputs:map<string,{band}>>>")
    rows = df.withColumn("__d", F.explode(parsed["data"])).select(*[c for c in df.columns if c != column], F.col("__d.interval.from").alias("interval_from"), F.explode("__d.outputs").alias("output", "__o"))
    rows = rows.select("*", F.explode("__o.bands").alias("band", "__b")).where(F.col("band").isin(*bands))
    number = lambda n: F.when(F.lower(F.col(f"__b.stats.{n}")) != "nan", F.col(f"__b.stats.{n}").try_cast("double")).alias(n)
    return rows.select(*[c for c in rows.columns if not c.startswith("__")], *[number(n) for n in ("min", "max", "mean", "stDev", "sampleCount", "noDataCount")])


WEATHER = "struct<lats:array<double>,lons:array<double>,nx:int,ny:int,timeIntervals:array<struct<start:long,end:long,stride:long,timestrings:array<string>>>,codes:array<struct<code:int,level:string,aggregation:string,timeIntervals:array<struct<data:array<double>>>>>>"


def interval_times(interval: Column) -> Column:
    """Times of an interval: from start to before end by stride, or the first part of strings such as ``20200101T0000-20200102T0000``."""
    regular = F.transform(F.sequence(interval["start"], interval["end"] - 1, interval["stride"]), lambda s: F.timestamp_seconds(s))
    named = F.transform(interval["timestrings"], lambda s: F.to_timestamp(F.split_part(s, F.lit("-"), F.lit(1)), "yyyyMMdd'T'HHmm"))
    return F.when(F.coalesce(F.size(interval["timestrings"]), F.lit(0)) > 0, named).otherwise(regular)


def weather_rows(df: DataFrame, response: str) -> DataFrame:
    """``(…, lon, lat, place, ts, variable, value)`` of a columnar weather response; place counts locations from 0.

    A code's values of one interval are in order of place, then time.
    """
    r = F.col(response)
    keep = [c for c in df.columns if c != response]
    codes = df.select(*keep, r.alias("r"), F.explode(r["codes"]).alias("code"))
    spans = codes.select(*keep, "r", "code", F.posexplode("code.timeIntervals").alias("__i", "__s"))
    timed = spans.withColumn("__t", interval_times(F.element_at(F.col("r.timeIntervals"), F.col("__i") + 1)))
    values = timed.select(*keep, "r", "code", "__t", F.posexplode("__s.data").alias("__p", "value"))
    n = F.size("__t")
    place = F.floor(F.col("__p") / n).cast("int")
    name = F.concat_ws("_", F.col("code.code").cast("string"), "code.level", "code.aggregation")
    return values.select(*keep, F.element_at(F.col("r.lons"), place + 1).alias("lon"), F.element_at(F.col("r.lats"), place + 1).alias("lat"), place.alias("place"), F.element_at("__t", F.col("__p") % n + 1).alias("ts"), name.alias("variable"), "value")


def weather_grid(rows: DataFrame, nx: int, ny: int) -> DataFrame:
    """Places of a row-major grid as ``(y, x)``, with y counted from the top."""
    return rows.withColumn("x", F.col("place") % nx).withColumn("y", F.lit(ny - 1) - F.floor(F.col("place") / nx).cast("int"))


def raster_rows(tiles: DataFrame, raster: str, resolution: float | None = None) -> DataFrame:
    """A nested raster column as one row for each pixel, with a pixel number and, given a resolution, its centre."""
    rows = tiles.select(*[c for c in tiles.columns if c != raster], F.size(F.element_at(raster, 1)).alias("__w"), F.size(raster).alias("__h"), F.posexplode(raster).alias("y", "__r"))
    rows = rows.select(*[c for c in rows.columns if c != "__r"], F.posexplode("__r").alias("x", "v"))
    rows = rows.withColumn("p_id", F.col("tile_id") * F.col("__h") * F.col("__w") + F.col("y") * F.col("__w") + F.col("x"))
    if resolution:
        rows = rows.withColumn("cx", F.col("min_x") + F.col("x") * resolution + resolution / 2).withColumn("cy", F.col("max_y") - F.col("y") * resolution - resolution / 2)
    return rows.drop("__w", "__h")


def rows_to_raster(pixels: DataFrame, value: str, keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Pixels as one row-major array for each tile; a tile must fit in a row."""
    got = F.array_sort(F.collect_list(F.struct("y", "x", F.col(value).alias("v"))))
    return pixels.groupBy(*keys).agg(F.transform(got, lambda s: s["v"]).alias("values"))


def write_features(df: DataFrame, path: str, properties: Sequence[str], x: str = "lon", y: str = "lat") -> None:
    """One GeoJSON point feature for each line."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(x), F.col(y)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), point.alias("geometry"))
    df.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def search_catalog(acquisitions: DataFrame, collection: str, start, end, fields: Sequence[str], bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Fields of a collection's acquisitions in [start, end] that meet the box."""
    found = acquisitions.where((F.col("collection") == collection) & F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    return (within_bbox(found, *bbox) if bbox else found).select(*fields)


