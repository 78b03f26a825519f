"""Per-pixel algebra: functions of Columns. Missing is null; a ratio with denominator 0 is null."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def missing_nan(x) -> Column:
    """NaN as null, the library's only form of a missing value."""
    return F.when(~F.isnan(_c(x)), _c(x))


def ndi(a, b) -> Column:
    """Normalised difference (a - b) / (a + b)."""
    return F.try_divide(_c(a) - _c(b), _c(a) + _c(b))


def bare_soil_index(blue, red, nir, swir) -> Column:
    """((swir + red) - (nir + blue)) / ((swir + red) + (nir + blue))."""
    return ndi(_c(swir) + _c(red), _c(nir) + _c(blue))


def red_edge_ratio(re3, re1) -> Column:
    return F.try_divide(_c(re3), _c(re1)) - 1


def euclidean_norm(bands: Sequence) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [_c(b) * _c(b) for b in bands]))


def array_norm(bands, chosen: Sequence[int] | None = None) -> Column:
    """The norm over an array of bands, or over chosen 0-based ones."""
    picked = _c(bands) if chosen is None else F.array(*[F.element_at(_c(bands), i + 1) for i in chosen])
    return F.sqrt(F.aggregate(picked, F.lit(0.0), lambda s, x: s + x * x))


def linear(x, slope: float = 1, intercept: float = 0, dtype: str | None = None) -> Column:
    """``x * slope + intercept``; a value that the wanted type cannot hold is null."""
    out = _c(x) * F.lit(slope) + F.lit(intercept)
    return out.try_cast(dtype) if dtype else out


def all_masks(*masks) -> Column:
    return reduce(lambda a, b: a & b, map(_c, masks))


def invert(mask) -> Column:
    return (_c(mask) < 1).cast("tinyint")


def mask_values(x, mask, values: Sequence) -> Column:
    """Null where the mask has one of the values."""
    return F.when(~_c(mask).isin(*values), _c(x))


def map_labels(x, mapping: Mapping) -> Column:
    """Labels that the mapping has are replaced; others stay."""
    return reduce(lambda acc, kv: acc.when(_c(x) == kv[0], F.lit(kv[1])), list(mapping.items())[1:], F.when(_c(x) == next(iter(mapping)), F.lit(next(iter(mapping.values()))))).otherwise(_c(x))


def override(x, mask, key, value) -> Column:
    return F.when(_c(mask) == F.lit(key), F.lit(value)).otherwise(_c(x))


def without_class(x, key) -> Column:
    """0 where the label is the class, else 1."""
    return F.when(_c(x) == F.lit(key), 0).otherwise(1)


def clip(x, low, high) -> Column:
    return F.least(F.greatest(_c(x), F.lit(low)), F.lit(high))


def to_colour(x) -> Column:
    """[-1, 1] to [0, 255]."""
    return (_c(x) + 1) * 127.5


def nearest_colours(channels: Sequence, classes: Sequence[tuple[float, Sequence[float]]], within: float, otherwise: float) -> Column:
    """The value of the last class whose mean absolute colour difference is under ``within``."""
    out = F.lit(otherwise)
    for value, colour in classes:
        far = reduce(lambda a, b: a + b, [F.abs(_c(c) - F.lit(float(k))) for c, k in zip(channels, colour)]) / len(channels)
        out = F.when(far < within, F.lit(value)).otherwise(out)
    return out


def opaque(alpha, value) -> Column:
    return F.when(_c(alpha) > 0, F.lit(value)).otherwise(0)


def brightness_temperature(x, gain: float, offset: float, k1: float, k2: float) -> Column:
    """Kelvin from digital numbers by way of radiance."""
    return F.lit(k2) / F.ln(F.try_divide(F.lit(k1), F.lit(gain) * _c(x) + F.lit(offset)) + 1)


# Published coefficients of the albedo and of the three tasselled-cap components.
ALBEDO = (0.356, 0.130, 0.373, 0.085, 0.072)
ALBEDO_OFFSET = -0.0018
TASSELLED_CAP = {
    "brightness": (8.262635e-02, 1.367054e-01, 2.624542e-01, 2.979373e-01, 3.355313e-01, 3.897109e-01, 3.915202e-01, 4.774637e-01, 3.902135e-01, 1.373085e-01),
    "greenness": (-1.131535e-01, -1.685265e-01, -3.490906e-01, -3.313352e-01, 8.546702e-02, 3.312349e-01, 3.174919e-01, 3.636361e-01, -4.592348e-01, -4.076737e-01),
    "wetness": (1.366490e-01, 2.809175e-01, 3.079867e-01, 5.301541e-01, 1.382531e-01, -1.002561e-04, -8.090665e-02, -1.392557e-01, -4.074407e-01, -5.616345e-01),
}


def weighted(bands: Sequence, weights: Sequence[float]) -> Column:
    return reduce(lambda a, b: a + b, [_c(b) * w for b, w in zip(bands, weights)])


def tasselled_cap(bands: Sequence) -> dict[str, Column]:
    return {name: weighted(bands, w) for name, w in TASSELLED_CAP.items()}


def scale_to(x, low, high, out_low: float = 0, out_high: float = 1, missing: float | None = None) -> Column:
    """Linear scaling of [low, high] to [out_low, out_high]; missing and infinite values by ``missing``."""
    out = F.try_divide(_c(x) - _c(low), _c(high) - _c(low)) * (out_high - out_low) + out_low
    return out if missing is None else F.coalesce(F.when(~F.isnan(out) & (F.abs(out) < float("inf")), out), F.lit(float(missing)))


def tree(node: Mapping, features: Sequence) -> Column:
    """A decision tree in nested JSON as one Column: ``split_feature``, ``threshold``, ``decision_type``, children, ``leaf_value``."""
    if "leaf_value" in node:
        return F.lit(float(node["leaf_value"]))
    x, t = _c(features[int(node["split_feature"])]), F.lit(float(node["threshold"]))
    test = {"<=": x <= t, "<": x < t, ">": x > t, ">=": x >= t, "==": x == t}[node["decision_type"]]
    return F.when(test, tree(node["left_child"], features)).otherwise(tree(node["right_child"], features))


def tree_ensemble(trees: Sequence[Mapping], features: Sequence) -> Column:
    """The logistic of the sum of all trees' leaf values."""
    score = reduce(lambda a, b: a + b, [tree(t, features) for t in trees])
    return 1 / (1 + F.exp(-score))


def packed_index(x) -> Column:
    """An index in [-1, 1] as a non-negative integer."""
    return (_c(x) * 10000 + 10000).cast("int")


def rms(bands: Sequence) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [_c(b) * _c(b) for b in bands]) / len(bands))


def water(green, nir, threshold: float = 0.1) -> Column:
    return F.when(ndi(green, nir) > threshold, 1).otherwise(0)


def value_for_missing(x, value: float = 0) -> Column:
    return F.coalesce(missing_nan(x), F.lit(float(value)))


def change(before, after) -> Column:
    """The later class where it changed, else 0."""
    return F.when(_c(before) != _c(after), _c(after)).otherwise(0)


def anomaly_score(x, band: float = 1, no_data: float = -9) -> Column:
    """No data where null, 0 within the band, else the value."""
    return F.when(_c(x).isNull(), F.lit(float(no_data))).when(F.abs(_c(x)) <= band, F.lit(0.0)).otherwise(_c(x))


def label_bins(x, bins: Sequence[float]) -> Column:
    """How many bins lie below the value: right-closed intervals from 0."""
    return reduce(lambda a, b: a + b, [F.when(_c(x) > F.lit(b), 1).otherwise(0) for b in bins])


def zip_with(f: Callable[..., Column], *columns) -> Column:
    """A function of several Columns."""
    return f(*map(_c, columns))


def argmax_class(scores) -> Column:
    """The 0-based place of the greatest score; the first where several are."""
    return (F.array_position(_c(scores), F.array_max(_c(scores))) - 1).cast("int")
