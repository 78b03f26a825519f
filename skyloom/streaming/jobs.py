"""Streaming jobs that keep anomalies and interval statistics up to date as observations arrive.

All read files with a fixed schema, take ``timestamp`` event times and carry a watermark, so
state is bounded: what is later than the watermark is dropped, and a batch run over all files
reconciles it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators.aggregates import anomalies
from skyloom.streaming.stateful import ROCKS, STORE


def read_new(spark: SparkSession, path: str, schema, time: str = "ts", late: str = "2 days", files_per_trigger: int = 64) -> DataFrame:
    """A stream of a folder's Parquet files, with event time and watermark."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def once_each(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key once, however often its observation is delivered within the watermark."""
    return stream.dropDuplicatesWithinWatermark(list(keys))


def stream_anomalies(stream: DataFrame, baseline: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Stream-static join with the monthly baseline."""
    return anomalies(stream, baseline, value, keys)


def interval_statistics(stream: DataFrame, keys: Sequence[str], value: str, every: str, time: str = "ts") -> DataFrame:
    stats = [F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.count(value).alias("n")]
    return stream.groupBy(*keys, F.window(time, every).alias("w")).agg(*stats).withColumn("interval_from", F.col("w.start")).drop("w")


def sliding_alerts(stream: DataFrame, keys: Sequence[str], value: str, length: str, slide: str, above: float, time: str = "ts") -> DataFrame:
    """Windows whose sum exceeds the limit."""
    return stream.groupBy(*keys, F.window(time, length, slide).alias("w")).agg(F.sum(value).alias("total")).where(F.col("total") > above).withColumn("window_from", F.col("w.start")).drop("w")


def acquisition_sessions(stream: DataFrame, keys: Sequence[str], gap: str, time: str = "ts") -> DataFrame:
    """Frames less than the gap apart, in a chain, are one pass. Greedy thinning differs: it compares with the last kept one.

    In append mode a session comes out once the watermark has passed its end by the gap, and leaves the state.
    """
    return stream.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), "n")


def write_idempotent(stream: DataFrame, path: str, by: Sequence[str], checkpoint: str):
    """Each batch replaces its own folder, so a batch that runs twice leaves one copy."""

    def put(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", *by).parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closing_mark(spark: SparkSession, path: str, schema, at: Column, time: str = "ts") -> None:
    """Adds a row to the folder that has an event time only: the watermark moves on to it, and what is open before it closes.

    It stands for the clock of a source that has fallen silent. Streams drop it by ``without_marks``.
    """
    empty = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != time else at.cast(f.dataType).alias(f.name) for f in schema.fields]
    spark.range(1).select(*empty).write.mode("append").parquet(path)


def without_marks(stream: DataFrame, id_col: str, time: str = "ts") -> DataFrame:
    """The rows with an id. The condition also takes the event time, so that the optimizer leaves it above the watermark, which has seen the marks."""
    return stream.where(F.when(F.col(time).isNull(), False).otherwise(F.col(id_col).isNotNull()))


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str, progress: list | None = None) -> DataFrame:
    """Run over what is there and return the result as a table, written to the checkpoint's folder.

    Called again with the same name and checkpoint, it goes on with what has come since. ``progress`` gets the last
    trigger's report. Operators with state of their own need the RocksDB store, which is set for the run.
    """
    spark = stream.sparkSession
    store = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    out = f"{checkpoint}/{name}-out"

    def put(df: DataFrame, batch: int) -> None:
        df.withColumn("__batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        spark.conf.unset(STORE) if store is None else spark.conf.set(STORE, store)
    if progress is not None and query.lastProgress:
        progress.append(query.lastProgress)
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*").drop("batch")
