"""The given tables in the roles of observations, rasters, frames and parcels, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.plans.catalog import load

_OBS = {
    "oid": "((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey",
    "tile_id": "l_suppkey % 20", "y": "l_partkey % 16", "x": "l_partkey // 16 % 16", "ts": "l_shipdate",
    "blue": "l_discount", "red": "l_tax", "nir": "l_quantity / 50.0", "swir": "l_extendedprice / 99991.0",
    "is_data": "l_linestatus = 'O'", "valid": "l_returnflag <> 'R'", "scl": "l_linenumber", "clp": "l_tax * 10.0",
}
#: One row per observation: tile, pixel, time, four bands, masks. ``oid`` is unique.
OBS = "WITH obs AS (SELECT " + ", ".join(f"{e.replace(' 50.0', ' 50.0::DOUBLE').replace(' 99991.0', ' 99991.0::DOUBLE').replace(' 10.0', ' 10.0::DOUBLE')} AS {n}" for n, e in _OBS.items()) + " FROM lineitem)"
#: One row per pixel of an 8 x 8 tile.
PIX = "WITH pix AS (SELECT tile_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, v, label FROM (SELECT vec_id AS tile_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"
#: One band in time for each user.
SER = "WITH ser AS (SELECT user_id AS px, ts, event_id AS oid, value AS v, event_type AS class, event_type <> 'error' AS valid FROM events)"


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark_sql = {n: e.replace("l_partkey // 16", "(l_partkey div 16)").replace("50.0", "50D").replace("99991.0", "99991D").replace("10.0", "10D") for n, e in _OBS.items()}
    return load(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in spark_sql.items()])


def pix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tile_id"), "label", F.posexplode("embedding").alias("i", "v"))
    return rows.select("tile_id", F.expr("cast(i div 8 as bigint)").alias("y"), (F.col("i") % 8).cast("long").alias("x"), F.col("v").cast("double").alias("v"), "label")


def ser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("px"), "ts", F.col("event_id").alias("oid"), F.col("value").alias("v"), F.col("event_type").alias("class"), (F.col("event_type") != "error").alias("valid"))


def r6(c) -> F.Column:
    """Six digits, and no negative zero, as ``R6`` gives."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def R6(sql: str) -> str:
    return f"(round(({sql})::DOUBLE, 6) + 0.0::DOUBLE)"
