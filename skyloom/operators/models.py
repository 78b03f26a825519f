"""Model steps on tables: training, scoring, fits for each pixel."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators.sampling import quantiles_of, value_places
from skyloom.plans.staging import is_empty, stage


def clean_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose columns are all present and finite."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df


def linear_regression(df: DataFrame, y: str, x: str) -> DataFrame:
    """Slope, intercept and R² of one column on another: one aggregate."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def alike(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each distinct row of these columns once, with ``weight``, the number of rows like it; staged. A fit on these weights is a fit on all rows."""
    return stage(df.groupBy(*columns).agg(F.count("*").cast("double").alias("weight")), "alike")


def _assembled(columns: Sequence[str]):
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip")


#: Steps of a feature that a tree's thresholds part, at most.
STEPS = 32


def _cuts(df: DataFrame, column: str, steps: int) -> list[float]:
    """The middles between a column's values, or, if it has more than so many, its quantiles over all rows."""
    places = stage(value_places(df.select(F.col(column).cast("double").alias(column)).dropna(), column), "places")
    few = [r.value for r in places.select("value").orderBy("value").limit(steps + 1).collect()]
    if len(few) <= steps:
        return [(a + b) / 2 for a, b in zip(few, few[1:])] or few or [0.0]
    return sorted(set(quantiles_of(places, [k / steps for k in range(1, steps)]).first().q))


def train_trees(df: DataFrame, features: Sequence[str], label: str, depth: int = 4, rounds: int = 10, seed: int = 7, steps: int = STEPS):
    """A boosted-tree classifier of two classes, as a pipeline model.

    Features are cut to steps, and rows of the same steps and label are one row with their number as weight, so that
    the trees see all rows. With as many bins as the square root of those rows, the library looks at all of them for its thresholds, not at a sample.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import Bucketizer

    infinite, bins = float("inf"), [f"__bin_{c}" for c in features]
    cut = Bucketizer(splitsArray=[[-infinite, *_cuts(df, c, steps), infinite] for c in features], inputCols=list(features), outputCols=bins, handleInvalid="skip")
    rows, vectors = alike(cut.transform(df.select(*features, label)), [*bins, label]), _assembled(bins)
    trees = GBTClassifier(labelCol=label, weightCol="weight", maxDepth=depth, maxIter=rounds, seed=seed, maxBins=max(steps, math.isqrt(rows.count()) + 1))
    return PipelineModel(stages=[cut, vectors, trees.fit(vectors.transform(rows))])


def _scaler(rows: DataFrame, features: Sequence[str]):
    """Features less their mean over the deviation of the sample, of rows with weights."""
    from pyspark.ml.feature import SQLTransformer

    number = lambda x: f"cast('{x!r}' AS double)"
    w, n = F.col("weight"), F.sum("weight")
    mean = rows.agg(*[F.try_divide(F.sum(w * F.col(c)), n) for c in features]).first()
    off = [F.col(c) - F.lit(m) for c, m in zip(features, mean)]
    deviation = rows.agg(*[F.sqrt(F.try_divide(F.sum(w * o * o), n - 1)) for o in off]).first()
    scaled = [f"(`{c}` - {number(m)}) * {number(1 / d if d else 0.0)} AS `__scaled_{c}`" for c, m, d in zip(features, mean, deviation)]
    return SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__")


def train_scaled_logistic(df: DataFrame, features: Sequence[str], label: str, folds: int = 0, seed: int = 7):
    """Standardised features and logistic regression on all rows, as a pipeline model; with ``folds``, the penalty is chosen by cross-validation.

    Equal rows are one row with their number as weight. A row's fold is a hash of its values, so that equal rows share it.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    vectors = _assembled([f"__scaled_{c}" for c in features])
    rows = alike(df.dropna(subset=list(features)), [*features, label])
    penalty = 0.0

    def fit(part: DataFrame, penalties: Sequence[float]) -> list:
        scaler = _scaler(part, features)
        ready = vectors.transform(scaler.transform(part)).select("features", label, "weight")
        lr = LogisticRegression(labelCol=label, weightCol="weight", maxIter=20)
        return [PipelineModel(stages=[scaler, vectors, lr.copy({lr.regParam: p}).fit(ready)]) for p in penalties]

    if folds:
        penalties, judge = [0.0, 0.1], MulticlassClassificationEvaluator(labelCol=label, weightCol="weight", metricName="accuracy")
        dealt = rows.withColumn("__fold", F.pmod(F.xxhash64(F.lit(seed), *features, label), F.lit(folds)))

        def held_out(k: int) -> list[float]:
            test = dealt.where(F.col("__fold") == k)
            return [judge.evaluate(m.transform(test)) for m in fit(dealt.where(F.col("__fold") != k), penalties)]

        there = sorted(r[0] for r in dealt.select("__fold").distinct().collect())
        with ThreadPoolExecutor(2) as pool:
            found = list(pool.map(inheritable_thread_target(df.sparkSession)(held_out), there)) if len(there) > 1 else [[0.0]]
        penalty = penalties[int(np.argmax(np.mean(found, axis=0)))]
    return fit(rows, [penalty])[0]


def score(model, df: DataFrame) -> DataFrame:
    """Prediction and the probability of class 1 of every row."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).select(*df.columns, "prediction", F.element_at(vector_to_array("probability"), 2).alias("probability_1"))


def importances(model, features: Sequence[str]) -> DataFrame:
    """Each feature's importance in the pipeline's tree model."""
    from pyspark.sql import SparkSession

    values = model.stages[-1].featureImportances.toArray().tolist()
    return SparkSession.active().createDataFrame(list(zip(features, values)), "feature string, importance double")


def predict_batches(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keep: Sequence[str] = ()) -> DataFrame:
    """Score rows with any callable on pandas batches; ``keep`` columns pass through."""
    out = ", ".join([f"{c} {t}" for c, t in df.dtypes if c in keep] + [schema])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.concat([pdf[list(keep)].reset_index(drop=True), f(pdf).reset_index(drop=True)], axis=1)

    return df.mapInPandas(run, out)


# ---- curves for each pixel


def spline_moments(t: Column, v: Column) -> Column:
    """Second derivatives of the natural cubic spline through points of ascending ``t``: two folds over the arrays solve its equations."""
    n = F.size(t)
    at = F.when(n > 2, F.sequence(F.lit(2), n - 1)).otherwise(F.array().cast("array<int>"))
    x, y = (lambda i, c=c: F.element_at(c, i) for c in (t, v))
    slope = lambda i: (y(i + 1) - y(i)) / (x(i + 1) - x(i))

    def down(acc, i):
        before = F.element_at(acc, -1)
        left, right = x(i) - x(i - 1), x(i + 1) - x(i)
        pivot = 2 * (left + right) - left * before["c"]
        return F.concat(acc, F.array(F.struct((right / pivot).alias("c"), ((6 * (slope(i) - slope(i - 1)) - left * before["d"]) / pivot).alias("d"))))

    rows = F.aggregate(at, F.array(F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("d"))), down)
    # the first of the rows stands for the first point, whose moment is 0 as the last one's
    up = lambda acc, r: F.concat(F.array(r["d"] - r["c"] * F.element_at(acc, 1)), acc)
    return F.concat(F.array(F.lit(0.0)), F.aggregate(F.reverse(F.slice(rows, 2, F.size(rows))), F.array(F.lit(0.0)), up))


def spline_resample(series: DataFrame, key: str, time: str, value: str, step_days: int) -> DataFrame:
    """``(key, day, value)``: a natural cubic spline through each key's mean of a day, every so many days from its first.

    Days are averaged before a key's are gathered, so a key holds one value for each day. A
    key of one day has one row without a value.
    """
    day = F.datediff(F.to_date(time), F.lit("1970-01-01").cast("date"))
    days = series.select(F.col(key).cast("long").alias("key"), day.alias("t"), F.col(value).cast("double").alias("v")).dropna().groupBy("key", "t").agg(F.avg("v").alias("v"))
    known = days.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("s")).select("key", F.transform("s", lambda x: x["t"].cast("double")).alias("t"), F.transform("s", lambda x: x["v"]).alias("v"))
    solved = known.withColumn("m", spline_moments(F.col("t"), F.col("v"))).withColumn("last", F.element_at("t", -1).cast("int"))
    every = solved.withColumn("day", F.explode(F.sequence(F.element_at("t", 1).cast("int"), F.col("last"), F.lit(int(step_days)))))
    i = F.greatest(F.lit(1), F.least(F.size("t") - 1, F.size(F.filter("t", lambda x: x <= F.col("day")))))
    at = every.withColumn("i", i)
    get = lambda c, d=0: F.try_element_at(c, F.col("i") + d)
    h = get("t", 1) - get("t")
    left, right = (get("t", 1) - F.col("day")) / h, (F.col("day") - get("t")) / h
    curve = left * get("v") + right * get("v", 1) + ((left**3 - left) * get("m") + (right**3 - right) * get("m", 1)) * h * h / 6
    return at.select(F.col("key").alias(key), "day", curve.alias(value))


PARAMETERS = ["c1", "c2", "a1", "a2", "a3", "a4", "a5"]
# The bounds of the curve's parameters, needed for the same results: widths of at least 0.15, shapes of at least 1.
LEAST_WIDTH, LEAST_SHAPE = 0.15, 1.0
#: The first shapes tried: peaks, widths after and before it, shapes after and before it.
TRIED = [[k / 8 for k in range(1, 8)], [0.15, 0.3, 0.6], [2.0, 6.0], [0.15, 0.3, 0.6], [2.0, 6.0]]


def _curve(t: Column, a1: Column, a2: Column, a3: Column, a4: Column, a5: Column) -> Column:
    return F.when(t < a1, F.exp(-F.pow((a1 - t) / a4, a5))).otherwise(F.exp(-F.pow((t - a1) / a2, a3)))


def doubly_logistic_column(t: Column, p: Sequence[Column]) -> Column:
    """``c1 + c2 g(t)``: a rise to the peak at a1 with width a4 and shape a5, and a fall with a2 and a3."""
    return p[0] + p[1] * _curve(t, *p[2:])


#: Times of a key that one task fits at once, at most; a key with more is spread over tasks.
WHOLE = 65536


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All pairs of each row's values, in order: (rows, a's times b's, 2)."""
    return np.stack([np.repeat(a, b.shape[1], axis=1), np.tile(b, (1, a.shape[1]))], axis=2)


def _side_sums(own: np.ndarray, x: np.ndarray, v: np.ndarray, tried: Sequence[np.ndarray]) -> np.ndarray:
    """Sums of g, g² and g v for each key, peak tried, and pair of width and shape: those after the peak, then those before it.

    A peak parts a key's points in two. Each side's sums hang on that side's pair only, so that so many pairs are
    evaluated and not their product; all combinations are sums of two. ``own`` numbers the points' keys, ``tried`` has a row for each.
    """
    peaks, sides = tried[0], (_pairs(*tried[1:3]), _pairs(*tried[3:5]))
    after = sides[0].shape[1]
    out = np.zeros((len(peaks), peaks.shape[1], after + sides[1].shape[1], 3))
    for i in range(peaks.shape[1]):
        away = x - peaks[own, i]
        for pairs, there, first in ((sides[0], away >= 0, 0), (sides[1], away < 0, after)):
            k, y = own[there], v[there]
            with np.errstate(divide="ignore"):
                far = np.log(np.abs(away[there]))
            for j in range(pairs.shape[1]):
                g = np.exp(-np.exp(pairs[k, j, 1] * (far - np.log(pairs[:, j, 0])[k])))
                for s, w in enumerate((g, g * g, g * y)):
                    out[:, i, first + j, s] = np.bincount(k, w, len(peaks))
    return out


def _least(sums: np.ndarray, known: np.ndarray, tried: Sequence[np.ndarray]) -> np.ndarray:
    """Each key's ``PARAMETERS`` of least squares, of equal ones the least shapes; ``known`` has its number of points, sums of v and v², least and largest v."""
    n, sv, svv, low, high = (c[:, None, None, None] for c in known.T)
    sizes = [c.shape[1] for c in tried]
    after = sizes[1] * sizes[2]
    sg, sgg, sgv = (sums[:, :, :after, None, s] + sums[:, :, None, after:, s] for s in range(3))
    spread = n * sgg - sg * sg
    free = np.divide(n * sgv - sg * sv, spread, out=np.zeros_like(sg), where=spread > 1e-9)
    c1 = np.maximum(low, np.minimum(high, (sv - free * sg) / n))
    c2 = np.divide(sgv - c1 * sg, sgg, out=np.zeros_like(sg), where=sgg != 0)
    error = svv - 2 * c1 * sv - 2 * c2 * sgv + n * c1 * c1 + 2 * c1 * c2 * sg + c2 * c2 * sgg
    flat = np.round(error, 9).reshape(len(sums), -1)
    at = np.argmin(np.where(np.isnan(flat), np.inf, flat), axis=1)
    rows = np.arange(len(sums))
    shapes = [c[rows, i] for c, i in zip(tried, np.unravel_index(at, sizes))]
    return np.stack([c.reshape(len(sums), -1)[rows, at] for c in (c1, c2)] + shapes, axis=1)


def _near(a: str, own, i: int, turn: int, greatest: Callable, least: Callable):
    """The i-th of three values round a shape's best one in a round; steps shrink from round to round."""
    if a == "a1":
        return greatest(least(own + (i - 1) / 16 / 2 ** (turn - 1), 1.0), 0.0)
    return greatest(own * (1 + 1 / 2**turn) ** (i - 1), LEAST_WIDTH if a in ("a2", "a4") else LEAST_SHAPE)


def _fit_whole(rounds: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Fits all keys of rows ``(key, t, v)`` ordered by key and time, round by round; a key's rows may go over several batches."""
    shapes = PARAMETERS[2:]

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        n = rows.groupby("key")["t"].transform("size")
        rows = rows[n >= 8]
        key, first, n = np.unique(rows["key"].to_numpy(), return_index=True, return_counts=True)
        if not len(key):
            return pd.DataFrame(columns=["key", *PARAMETERS], dtype="float64").astype({"key": "int64"})
        t, v, own = rows["t"].to_numpy(), rows["v"].to_numpy(), np.repeat(np.arange(len(key)), n)
        start, span = t[first], t[first + n - 1] - t[first]
        x = (t - start[own]) / span[own]
        known = np.stack([n, np.bincount(own, v), np.bincount(own, v * v), np.minimum.reduceat(v, first), np.maximum.reduceat(v, first)], axis=1)
        tried = [np.tile(c, (len(key), 1)) for c in TRIED]
        best = _least(_side_sums(own, x, v, tried), known, tried)
        for turn in range(1, rounds + 1):
            tried = [np.stack([_near(a, c, i, turn, np.maximum, np.minimum) for i in range(3)], axis=1) for a, c in zip(shapes, best[:, 2:].T)]
            best = _least(_side_sums(own, x, v, tried), known, tried)
        return pd.DataFrame(best, columns=PARAMETERS).assign(key=key)[["key", *PARAMETERS]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if len(held):
                done = held["key"] != held["key"].iloc[-1]
                if done.any():
                    yield fit(held[done])
                    held = held[~done]
        if held is not None and len(held):
            yield fit(held)

    return run


def _best(points: DataFrame, sizes: Sequence[int], value: Callable[[str, int], Column | float]) -> DataFrame:
    """Of each key, the least squares over all combinations of so many values of each shape, of which ``value`` gives the i-th, ascending; level and scale have a closed form, the level within the values' range.

    Batches of points give sums, a key's sums are added up: a key's points lie on any number of tasks, and no table of keys times shapes is joined or broadcast.
    """
    ends = np.cumsum(sizes)[:-1]
    tried = [F.lit(value(a, i)).cast("double").alias(f"{a}_{i}") for a, n in zip(PARAMETERS[2:], sizes) for i in range(n)]
    names = [f"{a}_{i}" for a, n in zip(PARAMETERS[2:], sizes) for i in range(n)]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            key, first, own, n = np.unique(pdf["key"].to_numpy(), return_index=True, return_inverse=True, return_counts=True)
            x, v, heads = pdf["x"].to_numpy(), pdf["v"].to_numpy(), pdf.iloc[first]
            shapes = heads[names].to_numpy()
            sums = _side_sums(own, x, v, np.split(shapes, ends, axis=1)).reshape(len(key), -1)
            held = np.concatenate([np.stack([n, np.bincount(own, v), np.bincount(own, v * v)], axis=1), sums], axis=1)
            least = pdf.groupby("key")["x"].min().to_numpy()
            yield pd.DataFrame({"key": key, "low": heads["low"].to_numpy(), "high": heads["high"].to_numpy(), "x": least, "tried": list(shapes), "sums": list(held)})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        total, row = np.sum(np.stack(pdf["sums"].to_list()), axis=0), pdf.iloc[0]
        shapes = np.split(np.asarray(row["tried"])[None, :], ends, axis=1)
        sums = total[3:].reshape(1, sizes[0], sizes[1] * sizes[2] + sizes[3] * sizes[4], 3)
        best = _least(sums, np.array([[*total[:3], row["low"], row["high"]]]), shapes)
        return pd.DataFrame(best, columns=PARAMETERS).assign(key=row["key"])[["key", *PARAMETERS]]

    parts = points.select("key", "x", "v", "low", "high", *tried).mapInPandas(add, "key long, low double, high double, x double, tried array<double>, sums array<double>")
    return parts.groupBy("key").applyInPandas(merge, "key long, " + ", ".join(f"{c} double" for c in PARAMETERS))


def _fit_spread(points: DataFrame, rounds: int) -> DataFrame:
    """The same search for keys with very many points: each round is one pass over the points and a merge of their sums."""
    shapes = PARAMETERS[2:]
    best = stage(_best(points, [len(c) for c in TRIED], lambda a, i: TRIED[shapes.index(a)][i]), "fit")
    greatest, least = (lambda c, limit, f=f: f(c, F.lit(limit)) for f in (F.greatest, F.least))
    for turn in range(1, rounds + 1):
        known = best.select("key", *[F.col(a).alias(f"b_{a}") for a in shapes])
        near = lambda a, i, turn=turn: _near(a, F.col(f"b_{a}"), i, turn, greatest, least)
        best = stage(_best(points.join(known, "key"), [3] * 5, near), "fit")
    return best


def doubly_logistic_fit(series: DataFrame, key: str, time: str, value: str, rounds: int = 5, whole: int = WHOLE) -> DataFrame:
    """The seven parameters of each key's curve over time scaled to [0, 1]; null with under eight times.

    Bounded least squares by search over shapes: those of ``TRIED`` first, then all neighbours of
    the best ones by steps that shrink. Values of one time are averaged before. A key with up to ``whole`` times is fitted by
    one task, many keys at once; the points of one with more are spread over tasks.
    """
    seconds = F.unix_timestamp(F.col(time).cast("timestamp"))
    rows = series.select(F.col(key).cast("long").alias("key"), seconds.alias("t"), F.col(value).cast("double").alias("v"))
    means = stage(rows.dropna().groupBy("key", "t").agg(F.avg("v").alias("v")), "means")
    large = stage(means.groupBy("key").agg(F.count("*").alias("times")).where(F.col("times") > whole).select("key"), "large")
    parts = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = means.join(large, "key", "left_anti").repartition(parts, "key").sortWithinPartitions("key", "t")
    best = dealt.mapInPandas(_fit_whole(rounds), "key long, " + ", ".join(f"{c} double" for c in PARAMETERS))
    if not is_empty(large):
        wide = means.join(large, "key")
        limits = wide.groupBy("key").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("times")).where("times >= 8")
        scaled = wide.join(limits, "key").select("key", ((F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))).alias("x"), "v", "low", "high")
        best = best.unionByName(_fit_spread(stage(scaled.repartitionByRange(parts, "key", "x"), "points"), rounds))
    return rows.select("key").distinct().join(best, "key", "left").withColumnRenamed("key", key)
