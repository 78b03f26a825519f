"""Running values over ordered rows of a key, in two levels, so that a key with very many rows is spread over tasks.

Rows are dealt to slices by ranges of key and order. A window runs within each slice; what a slice takes over from those
before it comes from a table of one row for each key and slice. Reductions go in order too: rows are folded in
chunks, and so are the chunks' results until one is left.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.operators.sampling import ranked
from skyloom.plans.staging import is_empty, stage

#: Rows of a chunk of a rolling window, or of a reduction, at least.
CHUNK = 4096


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int = 0) -> DataFrame:
    """The rows with ``__slice``, ranges of keys and order, staged."""
    wanted = [slices] if slices else []
    return stage(df.repartitionByRange(*wanted, *keys, *order).withColumn("__slice", F.spark_partition_id()), "slices")


def known(cut: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], out: str, backward: bool = False) -> DataFrame:
    """Add ``out``: of ``sliced`` rows, the last value that isn't null up to each row, or the first from it on."""
    there = Window.partitionBy(*keys, "__slice").orderBy(*order)
    ends = F.max if not backward else F.min
    point = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(value).alias("v"))
    every = cut.groupBy(*keys, "__slice").agg(ends(F.when(F.col(value).isNotNull(), point))["v"].alias("__edge"))
    along = Window.partitionBy(*keys).orderBy("__slice")
    if backward:
        inside = F.first(value, ignorenulls=True).over(there.rowsBetween(0, Window.unboundedFollowing))
        carried = F.first("__edge", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
    else:
        inside = F.last(value, ignorenulls=True).over(there.rowsBetween(Window.unboundedPreceding, 0))
        carried = F.last("__edge", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    carry = stage(every.select(*[F.col(c).alias(f"__of_{c}") for c in keys], F.col("__slice").alias("__of"), carried.alias("__carry")), "carry")
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"__of_{c}")), keys, F.col("__slice") == F.col("__of"))
    joined = cut.withColumn("__in", inside).join(carry, same, "left")
    return joined.withColumn(out, F.coalesce("__in", "__carry")).drop("__in", "__carry", "__of", *[f"__of_{c}" for c in keys])


def rolling(df: DataFrame, keys: Sequence[str], order: Sequence[str], steps: int, out: str, *aggregates: Column, chunk: int = CHUNK, slices: int = 0) -> DataFrame:
    """Add ``out``: a struct of aggregates over the last ``steps`` rows, null before there are so many.

    Rows are numbered and cut to chunks of places; the last rows of a chunk are copied to the next one, which looks back on them.
    """
    size = max(chunk, 2 * steps)
    placed = ranked(df, list(keys), list(order), "__p", slices).drop("__p_of")
    at, ahead = F.floor(F.col("__p") / size), F.col("__p") % size >= size - (steps - 1)
    copies = F.explode(F.when(ahead, F.array(F.struct(at.alias("c"), F.lit(False).alias("copy")), F.struct((at + 1).alias("c"), F.lit(True).alias("copy")))).otherwise(F.array(F.struct(at.alias("c"), F.lit(False).alias("copy")))))
    held = placed.withColumn("__k", copies).withColumn("__c", F.col("__k.c"))
    w = Window.partitionBy(*keys, "__c").orderBy("__p").rowsBetween(1 - steps, 0)
    full = F.when(F.count("*").over(w) == steps, F.struct(*[a.over(w).alias(f"v{i}") for i, a in enumerate(aggregates)]))
    return held.withColumn(out, full).where("NOT __k.copy").drop("__k", "__c", "__p")


def runs(df: DataFrame, keys: Sequence[str], number: str, slices: int = 0) -> DataFrame:
    """``(…keys, first, n)``: runs of consecutive whole numbers, which are distinct for a key."""
    placed = ranked(df.select(*keys, number), list(keys), [number], "__p", slices)
    return placed.groupBy(*keys, (F.col(number) - F.col("__p")).alias("__run")).agg(F.min(number).alias("first"), F.count("*").alias("n")).drop("__run")


def following(times: DataFrame, keys: Sequence[str], time: str, gap: int, out: str = "next", slices: int = 0) -> DataFrame:
    """Add ``out``: the key's first time that is more than ``gap`` after a row's own; null if there is none. Times are distinct whole numbers."""
    asked = times.select(*keys, (F.col(time) + gap + 1).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast("long").alias("__known"), F.col(time).cast("long").alias("__own"))
    there = times.select(*keys, F.col(time).alias("__at"), F.lit(1).alias("__side"), F.col(time).cast("long").alias("__known"), F.lit(None).cast("long").alias("__own"))
    cut = sliced(asked.unionByName(there), keys, ["__at", "__side"], slices)
    return known(cut, "__known", keys, ["__at", "__side"], out, backward=True).where("__side = 0").select(*keys, F.col("__own").alias(time), out)


def visited(links: DataFrame, keys: Sequence[str], start: str, then: str, most: int | None = None) -> DataFrame:
    """``(…keys, start, place)``: the nodes on each key's path from its least ``start`` along ``start -> then``, by pointer doubling.

    A round doubles both the places that are known and the length of the jumps, so the number of rounds is the logarithm of the
    longest path (or of ``most``); every step is an equi join on key and node.
    """
    jump = stage(links.where(F.col(then).isNotNull()).select(*keys, F.col(start).alias("a"), F.col(then).alias("b")), "jumps")
    found = [stage(links.groupBy(*keys).agg(F.min(start).alias("a")).withColumn("place", F.lit(0).cast("long")), "starts")]
    length = 1
    while most is None or length < most:
        reached = reduce(DataFrame.unionAll, found)
        new = stage(reached.join(jump, [*keys, "a"]).select(*keys, F.col("b").alias("a"), (F.col("place") + length).alias("place")), "reached")
        if is_empty(new):
            break
        found.append(new)
        onward = jump.select(*keys, F.col("a").alias("b"), F.col("b").alias("c"))
        jump, length = stage(jump.join(onward, [*keys, "b"]).select(*keys, "a", F.col("c").alias("b")), "jumps"), 2 * length
    out = reduce(DataFrame.unionAll, found).withColumnRenamed("a", start)
    return out if most is None else out.where(F.col("place") < most)


def reduce_ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], reducer: Callable[[tuple, tuple], tuple], chunk: int = CHUNK, slices: int = 0) -> DataFrame:
    """``(…keys, …columns)``: the rows' values of ``columns`` merged in order by any associative function of two tuples.

    The function needs neither commute nor have a neutral element. Rows are numbered, chunks of neighbours are folded, and so are the chunks'
    results again, so a key of n rows takes as many rounds as n has digits to the base ``chunk``, and no group holds more than one chunk.
    """
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (*keys, *columns))

    def fold(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values("__p")[list(columns)].itertuples(index=False, name=None))
        merged = reduce(reducer, rows)
        own = list(group)
        return pd.DataFrame([[*own[:-1], *merged, own[-1]]], columns=[*keys, *columns, "__p"])

    placed = ranked(df.select(*keys, *order, *[F.col(c).alias(f"__v_{c}") for c in columns]), list(keys), list(order), "__p", slices)
    part = placed.select(*keys, *[F.col(f"__v_{c}").alias(c) for c in columns], "__p", F.floor(F.col("__p") / chunk).alias("__c"))
    part = stage(part.groupBy(*keys, "__c").applyInPandas(fold, f"{kinds}, __p long"), "folded")
    size = max(2, chunk)
    while not is_empty(part.where("__p > 0")):
        part = stage(part.withColumn("__c", F.floor(F.col("__p") / size)).groupBy(*keys, "__c").applyInPandas(fold, f"{kinds}, __p long"), "merged")
    return part.drop("__p")
