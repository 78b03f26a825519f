"""Aggregates over pixels, frames, zones and time, as DataFrame functions and aggregate Columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIXEL = ["tile_id", "y", "x"]
FRAME = ["tile_id", "ts"]


def class_frequency(label, classes: Sequence, no_data=0) -> list[Column]:
    """For each class, its share of the observations that have data; null where none has."""
    c = F.col(label)
    there = F.count_if(c != F.lit(no_data))
    return [F.try_divide(F.count_if(c == F.lit(k)), there).alias(f"freq_{k}") for k in classes]


def valid_fraction(valid: str = "valid") -> Column:
    return F.avg(F.col(valid).cast("int"))


def frames_above(obs: DataFrame, threshold: float, valid: str = "valid") -> DataFrame:
    """Observations of frames whose valid fraction exceeds the threshold."""
    good = obs.groupBy(*FRAME).agg(valid_fraction(valid).alias("__f")).where(F.col("__f") > threshold).select(*FRAME)
    return obs.join(good, FRAME, "left_semi")


def last_nonzero(value: str, order: Sequence[str]) -> Column:
    """The value of the latest observation that isn't 0."""
    return F.max_by(F.when(F.col(value) != 0, F.col(value)), F.when(F.col(value) != 0, F.struct(*order)))


def baseline(obs: DataFrame, value: str, keys: Sequence[str] = PIXEL) -> DataFrame:
    """Mean and population deviation for each pixel and calendar month."""
    return obs.groupBy(*keys, F.month("ts").alias("month")).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def anomalies(obs: DataFrame, base: DataFrame, value: str, keys: Sequence[str] = PIXEL, sign: int = 1) -> DataFrame:
    """``(mean - value) / sd`` of each observation; null where the deviation is 0. ``sign=-1`` turns it round."""
    keyed = obs.withColumn("month", F.month("ts")).join(base, [*keys, "month"])
    return keyed.withColumn("anomaly", F.lit(sign) * F.try_divide(F.col("mean") - F.col(value), F.when(F.col("sd") > 1e-12, F.col("sd"))))


def interval_statistics(obs: DataFrame, keys: Sequence[str], value: str, every: str) -> DataFrame:
    """Minimum, maximum, mean, population deviation and count for each key and interval; non-finite values are missing."""
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    stats = [f(finite).alias(n) for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("stdev", F.stddev_pop), ("n", F.count))]
    return obs.groupBy(*keys, F.window(F.col("ts").cast("timestamp"), every).alias("w")).agg(*stats).withColumn("interval_from", F.col("w.start")).drop("w")


def confusion(df: DataFrame, truth: str, predicted: str, classes: Sequence) -> DataFrame:
    """One row for each true class with a count column for each predicted one."""
    return df.groupBy(truth).agg(*[F.count_if(F.col(predicted) == F.lit(k)).alias(f"pred_{k}") for k in classes])


def class_scores(df: DataFrame, truth: str, predicted: str, weight: Column | None = None) -> DataFrame:
    """Precision, recall and F1 of each class that occurs on either side."""
    w = F.lit(1) if weight is None else weight
    sides = F.explode(F.array(F.struct(F.col(truth).alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p"))))
    rows = df.select(F.when(F.col(truth) == F.col(predicted), w).otherwise(0).alias("hit"), w.alias("w"), sides.alias("s")).select("hit", "w", "s.*")
    c = rows.groupBy("class").agg(F.sum(F.col("hit") * F.col("t")).alias("tp"), F.sum(F.col("w") * F.col("t")).alias("support"), F.sum(F.col("w") * F.col("p")).alias("claimed"))
    precision, recall = F.try_divide(F.col("tp"), F.col("claimed")), F.try_divide(F.col("tp"), F.col("support"))
    return c.select("class", "support", precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"))


def cohen_kappa(df: DataFrame, truth: str, predicted: str, weight: Column) -> DataFrame:
    """Weighted Cohen's kappa, one row: agreement beyond what the marginals give by chance."""
    marginals = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.sum(weight).alias("w"))
    total = marginals.agg(F.sum("w").alias("n"), F.sum(F.when(F.col("t") == F.col("p"), F.col("w")).otherwise(0)).alias("same"))
    by_t, by_p = marginals.groupBy(F.col("t").alias("k")).agg(F.sum("w").alias("a")), marginals.groupBy(F.col("p").alias("k")).agg(F.sum("w").alias("b"))
    chance = by_t.join(by_p, "k").agg(F.sum(F.col("a") * F.col("b")).alias("ab"))
    expected = F.col("ab") / (F.col("n") * F.col("n"))
    return total.join(F.broadcast(chance), F.lit(True)).select(F.try_divide(F.col("same") / F.col("n") - expected, 1 - expected).alias("kappa"))  # one row each


def masked_mse(target, predicted, mask) -> Column:
    p, t, m = F.col(predicted), F.col(target), F.col(mask).cast("double")
    return F.try_divide(F.sum((p * m - t * m) * (p * m - t * m)), F.sum(m))


def squared_variance_error(target, predicted, mask) -> Column:
    """``(var(pred) / var(target) - 1)²`` over the masked values that aren't 0."""
    part = lambda c: F.var_pop(F.when(F.col(mask) & (F.col(c) != 0), F.col(c)))
    ratio = F.try_divide(part(predicted), part(target)) - 1
    return ratio * ratio


def iou(a: Column, b: Column) -> Column:
    return F.try_divide(F.count_if(a & b), F.count_if(a | b))


def in_steps(x, edges: Sequence[float], names: Sequence[str]) -> Column:
    """The name of the half-open step [edge i, edge i+1) that holds the value, else null."""
    c = F.col(x) if isinstance(x, str) else x
    return reduce(lambda acc, s: acc.when((c >= s[0]) & (c < s[1]), F.lit(s[2])), list(zip(edges[1:], edges[2:], names[1:])), F.when((c >= edges[0]) & (c < edges[1]), F.lit(names[0])))
