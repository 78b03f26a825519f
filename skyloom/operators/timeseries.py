"""Per-pixel time series: indices of extremes, filling, composites, interpolation, runs and thinning.

All windows of one pixel share one partitioning by the pixel's keys, so that several need one
exchange. A frame's number counts the distinct times of its tile from 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.operators import scans
from skyloom.plans.staging import stage

PIXEL = ("tile_id", "y", "x")


def frame_numbers(obs: DataFrame, tile: str = "tile_id", time: str = "ts") -> DataFrame:
    """Add ``t``. Frames are numbered on the tile's distinct times, a table far smaller than the pixels."""
    frames = obs.select(tile, time).distinct()
    return obs.join(frames.withColumn("t", F.row_number().over(Window.partitionBy(tile).orderBy(time)) - 1), [tile, time])


def extreme_times(obs: DataFrame, value: str, valid: str | None = None, keys: Sequence[str] = PIXEL, t: str = "t") -> DataFrame:
    """``(…keys, argmax, argmin)``: frame numbers of the extremes, the first of equal ones; 0 if nothing is valid."""
    v = F.col(value) if valid is None else F.when(F.col(valid), F.col(value))
    key = F.when(v.isNotNull(), F.struct(v.alias("v"), (-F.col(t)).alias("t")))
    low = F.when(v.isNotNull(), F.struct(v.alias("v"), F.col(t).alias("t")))
    return obs.groupBy(*keys).agg(F.coalesce(-F.max(key)["t"], F.lit(0)).alias("argmax"), F.coalesce(F.min(low)["t"], F.lit(0)).alias("argmin"))


def with_slopes(obs: DataFrame, value: str, valid: str, keys: Sequence[str] = PIXEL, time: str = "ts", tie: Sequence[str] = (), out: str = "slope") -> DataFrame:
    """The valid rows with their slope: the central difference over valid neighbours in days.

    Ends of a series and neighbours of one day have none.
    """
    w = Window.partitionBy(*keys).orderBy(time, *tie)
    rise = F.lead(value).over(w) - F.lag(value).over(w)
    days = F.datediff(F.lead(time).over(w), F.lag(time).over(w))
    return obs.where(F.col(valid)).withColumn(out, F.try_divide(rise, days))


def slope_times(obs: DataFrame, value: str, valid: str, keys: Sequence[str] = PIXEL, t: str = "t", time: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    """Frame numbers of the greatest and least slope; 0 where a pixel has no slope."""
    found = extreme_times(with_slopes(obs, value, valid, keys, time, tie), "slope", None, keys, t)
    return obs.select(*keys).distinct().join(found, list(keys), "left").select(*keys, F.coalesce("argmax", F.lit(0)).alias("argmax"), F.coalesce("argmin", F.lit(0)).alias("argmin"))


def fill(obs: DataFrame, value: str, operations: str = "f", keys: Sequence[str] = PIXEL, order: Sequence[str] = ("ts",), sentinel=None) -> DataFrame:
    """Fill missing values forward (f), backward (b), or one after the other (fb, bf); a sentinel counts as missing."""
    if not operations or set(operations) - {"f", "b"}:
        raise ValueError("operations are a sequence of f and b")
    v = F.col(value) if sentinel is None else F.when(F.col(value) != F.lit(sentinel), F.col(value))
    rows = scans.sliced(obs.withColumn("__v", v), keys, order)
    first = operations[0]
    wanted = [first] + [c for c in "fb" if c != first and c in operations]
    for c in wanted:
        rows = scans.known(rows, "__v", keys, order, f"__{c}", backward=c == "b")
    return rows.withColumn(value, F.coalesce(*[f"__{c}" for c in wanted])).select(*obs.columns)


def fill_array(values: Column, forward: bool = True) -> Column:
    """Fill along an array of bands."""
    run = lambda a: F.aggregate(a, F.slice(a, 1, 0), lambda acc, x: F.concat(acc, F.array(F.coalesce(x, F.when(F.size(acc) > 0, F.try_element_at(acc, F.lit(-1)))))))
    return run(values) if forward else F.reverse(run(F.reverse(values)))


def nearest_rank(obs: DataFrame, key: str, percentile: float, keys: Sequence[str] = PIXEL, time: Sequence[str] = ("ts",)) -> DataFrame:
    """The rows that stand at the percentile of ``key``: rank floor((n - 1) p / 100 + 0.5) in stable order; missing keys don't count."""
    known = obs.where(F.col(key).isNotNull() & ~F.isnan(key))
    w = Window.partitionBy(*keys)
    place = F.row_number().over(w.orderBy(key, *time)) - 1
    wanted = F.floor((F.count("*").over(w) - 1) * (percentile / 100) + 0.5)
    return known.withColumn("__p", place).withColumn("__w", wanted).where("__p = __w").drop("__p", "__w")


def lower_percentile(obs: DataFrame, key: str, percentile: float, keys: Sequence[str] = PIXEL, time: Sequence[str] = ("ts",)) -> DataFrame:
    """The rows of least distance to the lower percentile of ``key``, rank floor((n - 1) p / 100); the first in time of equal ones."""
    known = obs.where(F.col(key).isNotNull() & ~F.isnan(key))
    values = F.array_sort(F.collect_list(key))
    at = F.floor((F.size("v") - 1) * (percentile / 100)).cast("int") + 1
    quantile = known.groupBy(*keys).agg(values.alias("v")).select(*keys, F.element_at("v", at).alias("__q"))
    rank = F.struct(F.abs(F.col(key) - F.col("__q")).alias("d"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(time)], F.struct(*obs.columns).alias("row"))
    return known.join(quantile, list(keys)).groupBy(*keys).agg(F.min(rank).alias("__m")).select("__m.row.*")


def extreme_composite(obs: DataFrame, key: str, greatest: bool, keys: Sequence[str] = PIXEL, time: Sequence[str] = ("ts",)) -> DataFrame:
    """Each pixel's row of greatest or least ``key``, the first in time of equal ones: one aggregate, no sort."""
    k = F.col(key)
    rank = F.struct((-k if greatest else k).alias("k"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(time)], F.struct(*obs.columns).alias("row"))
    return obs.where(k.isNotNull() & ~F.isnan(k)).groupBy(*keys).agg(F.min(rank).alias("__m")).select("__m.row.*")


def max_ndvi_composite(obs: DataFrame, ndvi: str = "ndvi", keys: Sequence[str] = PIXEL, time: Sequence[str] = ("ts",), water_below: float = -0.05) -> DataFrame:
    """The row of greatest NDVI, or of least where the pixel's median is below the limit (water)."""
    k = F.col(ndvi)
    rest = [*[F.col(c).alias(f"o{i}") for i, c in enumerate(time)], F.struct(*obs.columns).alias("row")]
    found = obs.where(k.isNotNull() & ~F.isnan(k)).groupBy(*keys).agg(F.median(k).alias("__med"), F.min(F.struct((-k).alias("k"), *rest)).alias("__hi"), F.min(F.struct(k.alias("k"), *rest)).alias("__lo"))
    return found.select(F.when(F.col("__med") < water_below, F.col("__lo.row")).otherwise(F.col("__hi.row")).alias("r")).select("r.*")


def histogram_match(obs: DataFrame, composite: DataFrame, bands: Sequence[str], keys: Sequence[str] = PIXEL, frame: Sequence[str] = ("tile_id", "ts")) -> DataFrame:
    """Each frame's bands moved and stretched to the composite's mean and deviation over jointly valid pixels."""
    ref = composite.select(*keys, *[F.col(b).alias(f"__r_{b}") for b in bands])
    joined = obs.join(ref, list(keys))
    stats = []
    for b in bands:
        s, r = F.when(F.col(f"__r_{b}").isNotNull(), F.col(b)), F.when(F.col(b).isNotNull(), F.col(f"__r_{b}"))
        stats += [F.avg(s).alias(f"__ms_{b}"), F.stddev_pop(s).alias(f"__ss_{b}"), F.avg(r).alias(f"__mr_{b}"), F.stddev_pop(r).alias(f"__sr_{b}")]
    per_frame = joined.groupBy(*frame).agg(*stats)
    out = obs.join(per_frame, list(frame))
    for b in bands:
        gain = F.try_divide(F.col(f"__sr_{b}"), F.when(F.col(f"__ss_{b}") > 1e-12, F.col(f"__ss_{b}")))
        out = out.withColumn(b, F.col(b) * gain + (F.col(f"__mr_{b}") - F.col(f"__ms_{b}") * gain))
    return out.select(*obs.columns)


def interpolate(series: DataFrame, grid: Column, keys: Sequence[str], time: str, value: str, outside: float | None = None) -> DataFrame:
    """Linear interpolation at the grid's times; before the first and after the last valid value, ``outside``.

    ``grid`` is an array of times, the same for all keys. Values of one time are averaged. One union and two
    scans in slices; the right end is closed.
    """
    at = F.unix_micros(F.col(time).cast("timestamp"))
    valid = series.where(F.col(value).isNotNull()).groupBy(*keys, time).agg(F.avg(value).alias("v"))
    valid = valid.select(*keys, time, F.lit(0).alias("__side"), F.struct(at.alias("s"), "v").alias("__p"))
    asked = valid.select(*keys).distinct().select(*keys, F.explode(grid).alias(time)).withColumn("__side", F.lit(1))
    order = [time, "__side"]
    cut = scans.sliced(valid.unionByName(asked, allowMissingColumns=True), keys, order)
    got = scans.known(scans.known(cut, "__p", keys, order, "__l"), "__p", keys, order, "__r", backward=True).where("__side = 1")
    share = F.try_divide(at - F.col("__l.s"), F.col("__r.s") - F.col("__l.s"))
    # a value at the time itself is the last one up to it
    out = F.when(F.col("__l.s") == at, F.col("__l.v")).otherwise(F.col("__l.v") + share * (F.col("__r.v") - F.col("__l.v")))
    return got.select(*keys, time, F.coalesce(out, F.lit(outside)).alias(value))


def usable_threshold(obs: DataFrame, cloud: str, start, end, keys: Sequence[str] = PIXEL, time: str = "ts", step: float = 0.05) -> DataFrame:
    """The smallest cloud threshold, in steps, at which each pixel has two valid times that span [start, end]; null if none."""
    steps = round(1 / step) + 1
    first = F.ceil(F.round(F.greatest(F.col(cloud), F.lit(0.0)) / step, 9)).cast("int")
    each = obs.select(*keys, time, first.alias("__k")).where(F.col("__k") < steps)
    # the least step that lets in a time up to the start, one from the end on, and two times at all
    ranked = F.row_number().over(Window.partitionBy(*keys).orderBy("__k", time))
    agg = each.withColumn("__n", ranked).groupBy(*keys).agg(F.min(F.when(F.col(time) <= start, F.col("__k"))).alias("a"), F.min(F.when(F.col(time) >= end, F.col("__k"))).alias("b"), F.min(F.when(F.col("__n") == 2, F.col("__k"))).alias("c"))
    worst = F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("c").isNotNull(), F.greatest("a", "b", "c"))
    return agg.select(*keys, (worst * step).alias("threshold"))


def circular_smooth(values: Column, taps: Sequence[float] = (0.05, 0.6, 1, 0.6, 0.05)) -> Column:
    """A centred weighted mean over an array that wraps round."""
    n, half, total = F.size(values), len(taps) // 2, sum(taps)
    at = lambda i, k: F.element_at(values, F.pmod(i + (k - half), n) + 1)
    return F.transform(values, lambda x, i: sum((at(i, k) * w for k, w in enumerate(taps)), F.lit(0.0)) / total)


def daily(series: DataFrame, keys: Sequence[str], value: str, how: str, time: str = "ts") -> DataFrame:
    """``(…keys, day, v)``. Sums are rounded to nine digits, so that one exactly at a limit doesn't depend on the order of addition; means aren't, as the SQL doesn't."""
    f = {"sum": lambda c: F.round(F.sum(c), 9), "min": F.min, "max": F.max, "mean": F.avg}[how]
    return series.groupBy(*keys, F.to_date(time).alias("day")).agg(f(value).alias("v"))


def days_beyond(series: DataFrame, keys: Sequence[str], value: str, how: str, test: str, threshold: float, time: str = "ts", order: Sequence[str] = ()) -> DataFrame:
    """``(…keys, day, v, beyond)``: each day's aggregate, and whether it is strictly beyond the threshold.

    With ``order``, a sum or mean so near the threshold that the order of addition decides is added up again, value by value in that
    order; only the rows of such days are ordered. Without it, ``daily`` says what holds.
    """
    beyond = F.col("v") < threshold if test == "<" else F.col("v") > threshold
    if not order or how not in ("sum", "mean"):
        return daily(series, keys, value, how, time).withColumn("beyond", beyond)
    own, size = [*keys, "day"], F.col("n") if how == "mean" else F.lit(1)
    sums = series.withColumn("day", F.to_date(time)).groupBy(*own).agg(F.sum(value).alias("s"), F.count(value).alias("n"), F.sum(F.abs(value)).alias("all"))
    # two orders of n additions differ by less than 2 n 2^-53 times the sum of absolute values; as much again is for the division
    open_ = (F.col("n") > 1) & (F.abs(F.col("s") - threshold * size) < F.col("n") * 2.0**-51 * F.col("all"))
    of = [F.col(c).alias(f"__of_{c}") for c in own]
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in own])
    rows = series.withColumn("day", F.to_date(time)).join(sums.where(open_).select(*of), same, "left_semi")
    whole = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ties = stage(rows.withColumn("__s", F.sum(value).over(whole)).groupBy(*of).agg(F.first("__s").alias("__s")), "ties")
    mended = sums.join(ties, same, "left").withColumn("v", F.try_divide(F.coalesce("__s", "s"), size))
    return mended.select(*own, "v", beyond.alias("beyond"))


def count_days(series: DataFrame, keys: Sequence[str], value: str, how: str, test: str, threshold: float, time: str = "ts", order: Sequence[str] = ()) -> DataFrame:
    """Days of each year whose daily aggregate is strictly beyond the threshold; ``order`` as in ``days_beyond``."""
    days = days_beyond(series, keys, value, how, test, threshold, time, order)
    return days.groupBy(*keys, F.year("day").alias("year")).agg(F.count_if("beyond").alias("days"))


# The named climatological counts as (daily aggregate, test, threshold).
CLIMATE = {
    "heavy_precipitation_days": ("sum", ">", 40.0),
    "tropical_nights": ("min", ">", 20.0),
    "hot_days": ("max", ">", 30.0),
    "frost_days": ("min", "<", 0.0),
    "ice_days": ("max", "<", 0.0),
}


def climate_days(series: DataFrame, name: str, keys: Sequence[str], value: str, time: str = "ts", order: Sequence[str] = ()) -> DataFrame:
    return count_days(series, keys, value, *CLIMATE[name], time, order)


def longest_dry_run(series: DataFrame, keys: Sequence[str], value: str, below: float = 1.0, time: str = "ts", order: Sequence[str] = ()) -> DataFrame:
    """The longest run of consecutive days of each year whose daily sum is under the limit; days without data end a run. ``order`` as in ``days_beyond``."""
    days = days_beyond(series, keys, value, "sum", "<", below, time, order).where("beyond").withColumn("year", F.year("day"))
    found = scans.runs(days.withColumn("__day", F.datediff("day", F.lit("1970-01-01").cast("date"))), [*keys, "year"], "__day")
    return found.groupBy(*keys, "year").agg(F.max("n").alias("longest"))


def rolling_events(series: DataFrame, keys: Sequence[str], value: str, steps: int, above: float, order: Sequence[str] = ("ts",)) -> DataFrame:
    """How often, for each year, the sum of the last so many rows exceeds the limit."""
    sums = scans.rolling(series, keys, order, steps, "__s", F.sum(value))
    return sums.groupBy(*keys, F.year(order[0]).alias("year")).agg(F.count_if(F.col("__s.v0") > above).alias("events"))


def thin(series: DataFrame, keys: Sequence[str], time: str, gap_s: int, reverse: bool = False, most: int | None = None) -> DataFrame:
    """Greedy thinning: keep a time if it is more than ``gap_s`` after the last kept one (before it, in reverse).

    Each time is linked to the first one that may be kept after it, and the links are followed from the key's
    first time by pointer doubling, so a key may have any number of times. ``most`` keeps the first so many;
    ``enough`` tells whether there were that many.
    """
    sign = -1 if reverse else 1
    times = series.where(F.col(time).isNotNull()).select(*keys, (sign * F.unix_timestamp(F.col(time).cast("timestamp"))).alias("__t")).distinct()
    links = stage(scans.following(stage(times, "times"), keys, "__t", gap_s), "links")
    got = scans.visited(links, keys, "__t", "next", most)
    out = got.withColumn(time, F.timestamp_seconds(sign * F.col("__t")))
    if not most:
        return out.select(*keys, time)
    enough = stage(got.groupBy(*keys).agg((F.max("place") + 1 >= most).alias("enough")), "enough")
    return out.join(enough, list(keys)).select(*keys, time, "enough")


def context_bounds(t: Column, n: Column, size: int) -> tuple[Column, Column]:
    """First and past-the-last frame of a window of fixed size round t, shifted at the ends of n frames."""
    half = F.floor(F.lit(size) / 2).cast("int")
    low = F.greatest(F.least(t - half, n - size), F.lit(0))
    return low, F.least(low + size, n)


def window_statistics(rows: DataFrame, value: str, keys: Sequence[str], mid: str, t: str = "t") -> DataFrame:
    """``(…keys, low, mean, above_low, above_mean)`` of a window's frames, and of its target, the frame ``mid``, against them.

    ``above_mean`` is the target less the mean of the window's other frames; null if there are none.
    """
    n, own = F.count(value), F.max(F.when(F.col(t) == F.col(mid), F.col(value)))
    others = F.try_divide(F.sum(value) - own, n - 1)
    return rows.groupBy(*keys).agg(F.min(value).alias("low"), F.avg(value).alias("mean"), (own - F.min(value)).alias("above_low"), (own - others).alias("above_mean"))
