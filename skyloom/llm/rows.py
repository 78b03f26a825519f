"""Small things that the operators share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.plans.staging import stage


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name in df.columns:
        name += "_"
    return name


#: Files whose names may be broadcast, some 10 MB.
FILES = 100_000


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows, each with a number of its own in a further column, and the column's name.

    Stages decide on rows by it, as an id may be null or on several rows. Rows of Parquet files
    are numbered by file and place, which a lost task finds again; other rows are staged.
    """
    name = fresh(docs, "row_number")
    path, at, file = (fresh(docs, f"row_{c}") for c in ("path", "place", "file"))
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(at))
    except AnalysisException:  # not a plain scan of Parquet files
        return stage(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name
    files = stage(placed.select(path).distinct().withColumn(file, F.row_number().over(Window.orderBy(path)).cast("long")), "files")
    if files.count() > FILES:
        return stage(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name
    return placed.join(F.broadcast(files), path).withColumn(name, F.shiftleft(file, 40) + F.col(at)).select(*docs.columns, name), name


def keep_rows(rows: DataFrame, numbers: DataFrame, number: str) -> DataFrame:
    """The ``numbered`` rows whose number is in the one column of ``numbers``, without it."""
    name = fresh(rows, "kept_number")
    return rows.join(numbers.select(F.col(numbers.columns[0]).alias(name)), F.col(number) == F.col(name), "left_semi").drop(number)


#: Bits of a filter of ids: 1 MB at any size, so it may be broadcast.
FILTER_BITS = 1 << 23


def flagged(rows: DataFrame, key: str, ids: DataFrame, name: str) -> DataFrame:
    """``rows`` with the boolean column ``name``: false if the long ``key`` isn't among ``ids`` (one column) for sure.

    A bitmap of hashes is broadcast. Beyond some 10^7 ids nearly all rows are flagged; an exact join follows in any case.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1
    number = fresh(rows, "bitmap_number")
    held = ids.select(bit(ids.columns[0]).alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit)").alias(number)).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias(f"{number}_bits"))
    held = stage(held, "bitmap")
    at = F.bitmap_bit_position(bit(key))
    byte = F.conv(F.hex(F.substring(F.col(f"{number}_bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    on = F.call_function("shiftright", byte, (at % 8).cast("int")) % 2 == 1
    return rows.withColumn(number, F.bitmap_bucket_number(bit(key))).join(F.broadcast(held), number, "left").withColumn(name, F.coalesce(on & F.col(key).isNotNull(), F.lit(False))).drop(number, f"{number}_bits")


def values(batches: Iterator, *names: str) -> Iterator[tuple]:
    """The Python values of the named columns, row by row, so that long texts don't pile up."""
    for batch in batches:
        columns = [batch.column(n) for n in names]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def chunked(rows: Iterator[dict], schema, most: int = 20_000) -> Iterator:
    """Arrow batches of at most so many row dicts."""
    import pyarrow as pa

    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)
