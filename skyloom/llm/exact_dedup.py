"""Exact dedup by composable polynomial fingerprints.

A text's bytes, without ASCII white space, are the coefficients of a polynomial that is
evaluated modulo two primes. Chunks are hashed apart and combined by
``hash(left + right) = hash(left) * base^len(right) + hash(right)``, so that the chunks of a
huge document are hashed by different tasks. Texts of equal fingerprint and length are then
compared with the one that stays, chunk by chunk; a text that differs from it (a collision)
is grouped by its SHA-256 instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.llm.rows import chunked, flagged, keep_rows, numbered, table, values
from skyloom.plans.staging import is_empty, stage

WHITE = b" \t\n\x0b\x0c\r"
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 16777619)
#: Characters hashed at a time. So many terms of a byte times a power below 2^31 fit in 64 bits.
CHUNK_CHARS = 1 << 16
#: Texts longer than so many characters are hashed by several tasks.
HUGE_CHARS = 1 << 22


def _table(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[:n][::-1].copy()


_powers: list[np.ndarray] = []


def chunk_hash(data: bytes) -> tuple[int, int]:
    """The polynomial of at most 4 * CHUNK_CHARS bytes, modulo either prime."""
    if not _powers:
        _powers.extend(_table(b, p, 4 * CHUNK_CHARS) for b, p in zip(BASES, PRIMES))
    terms = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    n = len(terms)
    return tuple(int(np.dot(terms, t[len(t) - n :])) % p for t, p in zip(_powers, PRIMES))


def combine(left: tuple[int, int], right: tuple[int, int], right_bytes: int) -> tuple[int, int]:
    """The hash of two pieces one after the other."""
    return tuple((a * pow(b, right_bytes, p) + c) % p for a, c, b, p in zip(left, right, BASES, PRIMES))


def pieces(text: str, size: int = CHUNK_CHARS):
    """The text's chunks as bytes without white space."""
    for at in range(0, len(text), size):
        yield text[at : at + size].encode("utf-8", "surrogatepass").translate(None, WHITE)


def fingerprint(text: str, size: int = CHUNK_CHARS) -> tuple[int, int, int, str]:
    """Both hashes, the bytes without white space and their SHA-256, in one pass over the chunks."""
    at, n, sha = (0, 0), 0, hashlib.sha256()
    for data in pieces(text, size):
        at, n = combine(at, chunk_hash(data), len(data)), n + len(data)
        sha.update(data)
    return *at, n, sha.hexdigest()


def _digest(text: str) -> tuple[int, str]:
    n, sha = 0, hashlib.sha256()
    for data in pieces(text):
        n += len(data)
        sha.update(data)
    return n, sha.hexdigest()


_ROW = pa.schema([("id", pa.int64()), ("points", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("sha", pa.string())])
_PIECE = pa.schema([("id", pa.int64()), ("points", pa.int64()), ("n", pa.int64()), ("sha", pa.string()), ("whole", pa.binary()), ("at", pa.int64()), ("data", pa.binary())])
_HASHED = pa.schema([*_PIECE][:6] + [("h1", pa.int64()), ("h2", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())])


def _spark(schema: pa.Schema) -> T.StructType:
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)


def _fingerprint_rows(batches):
    def rows():
        for key, text in values(batches, "id", "text"):
            h1, h2, n, sha = fingerprint(text)
            yield {"id": key, "points": len(text), "h1": h1, "h2": h2, "n": n, "sha": sha}

    return chunked(rows(), _ROW)


def _piece_rows(batches):
    def rows():
        for key, text in values(batches, "id", "text"):
            n, sha = _digest(text)
            whole = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
            for at, data in enumerate(pieces(text)):
                yield {"id": key, "points": len(text), "n": n, "sha": sha, "whole": whole, "at": at, "data": data}

    return chunked(rows(), _PIECE, 64)


def _hash_rows(batches):
    def rows():
        for key, points, n, sha, whole, at, data in values(batches, "id", "points", "n", "sha", "whole", "at", "data"):
            h1, h2 = chunk_hash(data)
            yield {"id": key, "points": points, "n": n, "sha": sha, "whole": whole, "at": at, "h1": h1, "h2": h2} | {f"s{i + 1}": pow(BASES[i], len(data), PRIMES[i]) for i in (0, 1)}

    return chunked(rows(), _HASHED)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge_chars: int = HUGE_CHARS) -> DataFrame:
    """``(id, points, h1, h2, n, sha)`` of every row; a null text counts as empty.

    Texts over ``huge_chars`` are cut into chunks that are dealt over all tasks, hashed
    there and combined in order by the fold of ``combine``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    plain = rows.where(F.length("text") <= huge_chars).mapInArrow(_fingerprint_rows, _spark(_ROW))
    cut = rows.where(F.length("text") > huge_chars).mapInArrow(_piece_rows, _spark(_PIECE))
    hashed = cut.repartition("id", "at").mapInArrow(_hash_rows, _spark(_HASHED))
    fold = lambda i: F.aggregate("parts", F.lit(0).cast("long"), lambda acc, x: (acc * x[f"s{i}"] + x[f"h{i}"]) % F.lit(PRIMES[i - 1]))
    # rows that are alike have the same chunks, so a chunk's count is the rows'
    chunks = hashed.groupBy(*hashed.columns).agg(F.count("*").alias("times"))
    huge = (
        chunks.groupBy("id", "points", "n", "sha", "whole").agg(F.array_sort(F.collect_list(F.struct("at", "h1", "h2", "s1", "s2"))).alias("parts"), F.max("times").alias("times"))
        .withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("id", "points", fold(1).alias("h1"), fold(2).alias("h2"), "n", "sha")
    )
    return plain.unionByName(huge)


_TOLD = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64())])


def _texts(batches):
    for batch in batches:
        prints = [fingerprint(x.as_py())[:3] for x in batch.column("text")]
        columns = [pa.array([p[i] for p in prints], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), *columns], names=["id", "text", "h1", "h2", "n"])


def _differing(batches):
    def rows():
        for h1, h2, n, a, b in values(batches, "h1", "h2", "n", "text", "other"):
            if not same_text(a, b):
                yield {"h1": h1, "h2": h2, "n": n}

    return chunked(rows(), _TOLD)


def same_text(a: str, b: str, size: int = CHUNK_CHARS) -> bool:
    """Whether two texts are equal without white space, streaming both chunk by chunk."""
    if a == b:
        return True
    left, right, x, y = pieces(a, size), pieces(b, size), b"", b""
    while True:
        x, y = x or next(left, None), y or next(right, None)
        while x == b"":
            x = next(left, None)
        while y == b"":
            y = next(right, None)
        if x is None or y is None:
            return x is None and y is None
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return False
        x, y = x[n:], y[n:]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge_chars: int = HUGE_CHARS) -> DataFrame:
    """One row per document: ``(doc_id, keep_id, group_size, kept, text_sha256)``.

    Texts are equal if identical without the characters ``[\\x20\\x09-\\x0D]``; null is empty, and
    all empty texts are one group. Of a group the row with the most code points, then the
    smallest id (nulls last) stays. Rows that repeat id and text count towards the group's size,
    and one of them is kept. An empty table gives no rows; other columns are ignored.

    Fingerprints are shuffled for all rows; texts only of rows that share one, and of the few others
    that a filter of 1 MB lets pass (of all once some 10^7 rows share one). A group of any
    size is a partial aggregate and an equi join whose hot keys adaptive execution splits.
    """
    prints = stage(fingerprints(docs, id_col, text_col, huge_chars), "fingerprints")
    rank = F.struct((-F.col("points")).alias("points"), F.col("id").isNull().alias("none"), F.col("id"))
    key = ["h1", "h2", "n"]
    groups = stage(prints.groupBy(key).agg(F.count("*").alias("size"), F.min(rank).alias("best")), "groups").withColumnRenamed("size", "group_size")
    clashes = _collisions(docs, id_col, text_col, prints, groups, key)
    if clashes is not None:
        # collisions: these fingerprints are told apart by the SHA-256 of the whole text
        prints = prints.join(clashes.withColumn("clash", F.lit(True)), key, "left").withColumn("part", F.when(F.col("clash"), F.col("sha")).otherwise("")).drop("clash")
        key = [*key, "part"]
        groups = prints.groupBy(key).agg(F.count("*").alias("group_size"), F.min(rank).alias("best"))
    once = prints.groupBy(*prints.columns).agg(F.count("*").alias("times"))
    best = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("points") == -F.col("best.points"))
    return (
        once.join(groups, key).withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
        .select(F.col("id").alias("doc_id"), F.col("best.id").alias("keep_id"), "group_size", (best & (F.col("time") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))
    )


def _collisions(docs: DataFrame, id_col: str, text_col: str, prints: DataFrame, groups: DataFrame, key: list[str]) -> DataFrame | None:
    """The fingerprints of which some text differs from the text that stays, or None."""
    shared = groups.where("group_size > 1").select(*key, F.col("best.id").alias("keep"))
    ids = prints.join(shared, key).select(F.col("id").alias("__id")).distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = flagged(rows, "id", ids, "may").where("may OR id IS NULL").drop("may")
    texts = rows.join(ids, rows["id"].eqNullSafe(F.col("__id")), "left_semi").mapInArrow(_texts, "id long, text string, h1 long, h2 long, n long")
    texts = stage(texts.join(shared, key), "shared_texts")
    stays = stage(texts.where(F.col("id").eqNullSafe(F.col("keep"))).groupBy(key).agg(F.max("text").alias("other")), "kept_texts")
    told = stage(texts.where(~F.col("id").eqNullSafe(F.col("keep"))).join(stays, key).select(*key, "text", "other").mapInArrow(_differing, _spark(_TOLD)).distinct(), "collisions")
    return None if is_empty(told) else told


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact dedup keeps, with all their columns."""
    rows, number = numbered(docs)
    groups = exact_dedup(rows, number, text_col).select(F.col("doc_id").alias("__row"), F.col("keep_id").alias("__group"))
    points = F.coalesce(F.length(text_col), F.lit(0))
    ranked = rows.select(F.col(number).alias("__row"), F.struct((-points).alias("points"), F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(number).alias("row")).alias("rank"))
    best = groups.join(ranked, "__row").groupBy("__group").agg(F.min("rank").alias("best")).select("best.row")
    return keep_rows(rows, best, number)


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH n AS (
  SELECT doc_id, coalesce(length(text), 0) AS points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents
), r AS (
  SELECT *, row_number() OVER w AS rn, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
