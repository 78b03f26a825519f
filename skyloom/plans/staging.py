"""Tables written to the cluster's shared folder, to cut lineage and to compute a step once.

A staged table survives the loss of any executor: it is ordinary Parquet in the folder
that ``spark.checkpoint.dir`` names, which driver and executors share.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}
_staged: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset and the master is local (tests), a new local folder."""
    at = spark.conf.get(SETTING, None)
    if not at:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {SETTING} to a folder that driver and executors share")
        at = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return at.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back, with the same schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def staged_mark(spark: SparkSession) -> int:
    """How many tables this application has staged and not dropped: what is staged later comes after this mark."""
    return len(_staged.get(spark.sparkContext.applicationId, []))


def drop_staged(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Delete the tables that this application has staged after the mark ``since``, but for ``keep``; call it once what was made of them is written. Returns their number."""
    held = _staged.pop(spark.sparkContext.applicationId, [])
    kept = [p for i, p in enumerate(held) if i < since or p == getattr(keep, "staged_at", None)]
    if kept:
        _staged[spark.sparkContext.applicationId] = kept
    jvm, gone = spark.sparkContext._jvm, [p for p in held if p not in set(kept)]
    for path in gone:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(gone)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
