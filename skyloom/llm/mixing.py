"""Mixing sources to target weights by capped water-filling.

Sources share a total by weight; a source that would exceed its greatest number of epochs is
clamped there and the excess is shared anew by weight, until none exceeds it. The fixed
point has a closed form: with sources in order of cap over weight, the clamped ones are a
prefix, and all others stand at one common level per weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.llm.rows import fresh, table
from skyloom.plans.staging import stage

#: A word of a text.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"
#: Hexadecimal digits of the draw that name a slice of a source: so many slices share a hot source's order.
SLICE_DIGITS = 3


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw_of(id_col: str, text_col: str, seed: str = SEED) -> F.Column:
    """The MD5 of seed and id, in hexadecimal digits; of seed and text where the id is null."""
    return F.md5(F.coalesce(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), F.concat(F.lit(f"{seed}::"), F.coalesce(text_col, F.lit("")))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Sources by code point, null last, take the weights in turn. The window runs over one row
    for each source, not over documents. A source of size 0 has target 0.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    cap = epochs * F.col("source_size")
    tight = Window.orderBy(cap / F.col("weight"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (share * F.sum("source_size").over(everything) - epochs * F.coalesce(F.sum("source_size").over(tight), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(tight), F.lit(0.0)))
    # the first source that isn't clamped sets the level; if all are, each has its cap
    found = weighed.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= cap)
    common = F.min(F.when(F.col("free"), F.struct(cap / F.col("weight"), F.col("source").isNull(), F.coalesce("source", F.lit("")), F.col("level")).alias("s"))).over(everything)["level"]
    return found.withColumn("target", F.least(cap.cast("double"), F.coalesce(common, F.lit(float("inf"))) * F.col("weight"))).select("source", "source_size", "target")


def plan_mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """``(doc_id, size, source, source_size, target, draw, times)``: how often the mix repeats each row.

    Each row of a source is taken as many whole times as the target holds the source's size,
    and once more if it is drawn: rows are drawn in the order of the MD5 of seed and id until
    they hold the rest of the target; the row that crosses it is drawn if at least half of it
    still fits. Rows that repeat an id have one draw, so those of a source are taken alike; rows
    without an id are drawn by their text. The source may be null too. An empty table gives no rows.

    The order is cut into slices by the draw's first digits. One sum for each slice tells which
    slices lie wholly before the crossing, and only the slice at the crossing is ordered by a
    window over its draws, so neither a source nor an id with a third of all rows is in one task.
    """
    draw = draw_of(id_col, text_col, seed)
    rows = docs.select(F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"), F.col(source_col).alias("source"), draw.alias("draw"))
    rows = stage(rows.withColumn("slice", F.substring("draw", 1, SLICE_DIGITS)), "sizes")
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    targets = source_targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = stage(targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    before = F.coalesce(F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = lambda left, right: F.col(f"{left}.source").eqNullSafe(F.col(f"{right}.source"))
    placed = slices.withColumn("before", before).alias("s").join(targets.alias("t"), same("s", "t")).select(F.struct("s.source").alias("key"), "slice", "slice_size", "before", "source_size", "target", "whole", "rest")
    placed = stage(placed, "slices")
    joined = rows.withColumn("key", F.struct("source")).join(placed, ["key", "slice"])
    out = ["doc_id", "size", "source", "source_size", "target", "draw"]
    crossing = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("slice_size") > F.col("rest"))
    clear = joined.where(~crossing).select(*out, (F.col("whole") + F.when(F.col("before") < F.col("rest"), 1).otherwise(0)).cast("long").alias("times"))
    # rows of one draw stand at one place of the order
    at = joined.where(crossing)
    draws = at.groupBy("key", "slice", "draw", "before", "rest").agg(F.sum("size").alias("held"))
    start = F.col("before") + F.coalesce(F.sum("held").over(Window.partitionBy("key", "slice").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = draws.withColumn("start", start).where(F.col("start") + F.col("held") / 2 <= F.col("rest")).select("key", "draw", F.lit(1).alias("drawn"))
    some = at.join(drawn, ["key", "draw"], "left")
    return clear.unionByName(some.select(*out, (F.col("whole") + F.coalesce("drawn", F.lit(0))).cast("long").alias("times")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Pipeline stage: the rows of ``docs``, each as often as the mixture takes it."""
    draw, of, times, time, source = (fresh(docs, c) for c in ("mix_draw", "mix_draw_of", "mix_times", "mix_time", "mix_source"))
    plan = plan_mixture(docs, **options).groupBy(F.col("draw").alias(of), F.col("source").alias(source)).agg(F.max("times").alias(times)).where(F.col(times) > 0)
    names = [options.get(c, d) for c, d in (("id_col", "doc_id"), ("text_col", "text"), ("seed", SEED))]
    joined = docs.withColumn(draw, draw_of(*names)).join(plan, (F.col(draw) == F.col(of)) & F.col(options.get("source_col", "source")).eqNullSafe(F.col(source)))
    return joined.withColumn(time, F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*docs.columns)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """``taken`` is the row's size times its repetitions."""
    return plan_mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


OP5_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(coalesce('mix-1:' || doc_id::VARCHAR, 'mix-1::' || coalesce(text, ''))) AS draw FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - 2 * coalesce(sum(source_size) OVER p, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level
  FROM w WINDOW p AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT level AS common FROM l WHERE level * weight <= 2 * source_size ORDER BY 2 * source_size / weight, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce((SELECT common FROM c) * weight, 2.0::DOUBLE * source_size)) AS target FROM w
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t
), o AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.draw) AS held
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN rest > 0 AND upto - held + held / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM o
"""
