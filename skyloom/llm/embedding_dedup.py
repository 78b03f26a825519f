"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A rotation flips signs by a seed and applies the fast Walsh-Hadamard transform, three times
over. The hash of a rotated unit vector is the nearest signed axis: its coordinate of greatest
absolute value. A table's bucket is the pair of hashes by two rotations. Every vector lies in
its own bucket of each table, and also looks into those of the next nearest axes (multiprobe);
whoever meets there is a candidate, and the cosine in double precision decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.rows import table
from skyloom.operators.graph import connected_components
from skyloom.plans.staging import stage

COSINE = 0.93
TABLES = 10
#: Buckets that a vector looks into, its own included.
PROBES = 4
SEED = 20240501


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, whose length is a power of two."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def _rotated(x: np.ndarray, which: int, seed: int) -> np.ndarray:
    signs = np.random.default_rng([seed, which]).integers(0, 2, (3, x.shape[1])) * 2 - 1
    for s in signs:
        x = hadamard(x * s)
    return x


def _axes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two nearest signed axes of each row, and how much farther the second is."""
    rows, size = np.arange(len(x)), np.abs(x)
    first = size.argmax(axis=1)
    a = size[rows, first]
    size[rows, first] = -1
    second = size.argmax(axis=1)
    sign = lambda i: 2 * i + (x[rows, i] < 0)
    return np.stack([sign(first), sign(second)], axis=1), a - size[rows, second]


def buckets(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """``(vectors, tables, probes)`` bucket numbers, a vector's own bucket first.

    The probes follow by how little farther their axes are: the second axis of either hash,
    then of both.
    """
    d = 1 << max(1, int(unit.shape[1] - 1).bit_length())
    x = np.zeros((len(unit), d))
    x[:, : unit.shape[1]] = unit
    out = np.empty((len(x), tables, 4), np.int64)
    for t in range(tables):
        (a, da), (b, db) = _axes(_rotated(x, 2 * t, seed)), _axes(_rotated(x, 2 * t + 1, seed))
        swap = db < da
        one = np.where(swap, a[:, 0] * 2 * d + b[:, 1], a[:, 1] * 2 * d + b[:, 0])
        two = np.where(swap, a[:, 1] * 2 * d + b[:, 0], a[:, 0] * 2 * d + b[:, 1])
        out[:, t] = np.stack([a[:, 0] * 2 * d + b[:, 0], one, two, a[:, 1] * 2 * d + b[:, 1]], axis=1)
    return out[:, :, :probes]


def _vectors(docs: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``(vec, label, v, width)`` of rows that can link: labelled, no null or non-finite component, not zero."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = docs.select(F.col(id_col).cast("long").alias("vec"), F.col(label_col).alias("label"), v.alias("v")).where(F.col("vec").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(finite & F.exists("v", lambda x: x != 0)).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("width", F.size("v"))


def _hash_batches(batches):
    """Bucket rows of each distinct vector: its own bucket, and those that it looks into."""
    for batch in batches:
        width = batch.column("width").to_numpy()
        ids, labels = batch.column("node").to_numpy(), batch.column("label")
        values = batch.column("v")
        for d in np.unique(width):
            at = np.flatnonzero(width == d)
            x = np.array([values[int(i)].values.to_numpy() for i in at])
            x = x / np.abs(x).max(axis=1, keepdims=True)
            got = buckets(x / np.sqrt((x * x).sum(axis=1, keepdims=True)))
            n, t, p = got.shape
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids[at], t * p)), labels.take(pa.array(np.repeat(at, t * p))), pa.array(np.full(n * t * p, d, np.int32)), pa.array(np.tile(np.repeat(np.arange(t, dtype=np.int32), p), n)), pa.array(got.reshape(-1)), pa.array(np.tile(np.arange(p) == 0, n * t))],
                names=["node", "label", "width", "tab", "bucket", "own"],
            )


def _cosines(batches):
    for batch in batches:
        if batch.num_rows:
            # the two vectors of a pair are of one length; each batch has a stretch for each length
            size = np.diff(batch.column("va").offsets.to_numpy())
            ok = np.zeros(batch.num_rows, bool)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                a, b = (batch.column(c).take(pa.array(at)).flatten().to_numpy().reshape(len(at), d) for c in ("va", "vb"))
                ok[at] = cosines(a, b) >= COSINE
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of either, in double precision, scaled so that no square overflows or vanishes."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    dot = lambda x, y: (x * y).sum(axis=1)
    return dot(a, b) / np.sqrt(dot(a, a) * dot(b, b))


def vector_links(docs: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """``(vec, node, copies)`` of the vectors that can link, and ``(a, b)`` links of nodes, a < b.

    A node is the smallest id among the copies of one vector with one label.
    """
    rows = _vectors(docs, id_col, vec_col, label_col).groupBy("vec").agg(F.min(F.struct("label", "v")).alias("least"))
    rows = stage(rows.select("vec", "least.label", "least.v"), "vectors")
    same = rows.groupBy("label", "v").agg(F.min("vec").alias("node"), F.count("*").alias("copies"))
    nodes = stage(same.withColumn("width", F.size("v")), "nodes")
    members = stage(rows.join(nodes.select("label", "v", "node", "copies"), ["label", "v"]).select("vec", "node", "copies"), "members")
    hashed = nodes.select("node", "label", "width", "v").mapInArrow(_hash_batches, f"node long, label {nodes.schema['label'].dataType.simpleString()}, width int, tab int, bucket long, own boolean")
    hashed = stage(hashed, "buckets")
    key = ["label", "width", "tab", "bucket"]
    there = hashed.where("own").select(*key, F.col("node").alias("x"))
    looks = hashed.select(*key, F.col("node").alias("y"))
    pairs = there.join(looks, key).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    left, right = nodes.select(F.col("node").alias("a"), F.col("v").alias("va")), nodes.select(F.col("node").alias("b"), F.col("v").alias("vb"))
    links = pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb").mapInArrow(_cosines, "a long, b long")
    return members, stage(links, "links")


def embedding_dedup(docs: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per vector.

    Vectors link if their labels are equal and their cosine is at least 0.93; copies of a
    vector link with each other. Vectors of different length don't link. A null label or id,
    and a vector that is null, empty, zero, or holds a null or non-finite component, links with
    nothing and is a component of its own. Of rows that repeat an id, and can link, the one of
    the least label, then of the least vector, counts. An empty
    table gives no rows; other columns are ignored.
    """
    members, links = vector_links(docs, id_col, vec_col, label_col)
    copies = members.groupBy("node").agg(F.max("copies").alias("copies"))
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(links.select("b", "a"))
    degree = ends.join(copies.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.sum("copies").alias("others"))
    of_node = copies.join(degree, "node", "left").join(connected_components(links, "a", "b"), "node", "left")
    of_node = of_node.select("node", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "node").alias("component"))
    found = members.join(of_node, "node").select(F.col("vec").alias("__vec"), "n", "component")
    ids = docs.select(F.col(id_col).cast("long").alias("vec_id"))
    ids = ids.where("vec_id IS NOT NULL").distinct().unionAll(ids.where("vec_id IS NULL"))
    joined = ids.join(found, F.col("vec_id") == F.col("__vec"), "left")
    own = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), own.alias("component_id"), own.eqNullSafe(F.col("vec_id")).alias("kept"))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))
