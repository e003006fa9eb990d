"""Column functions on array<double> vectors, and the score conventions of the searchers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "inner_product", "euclidean")
#: squared: euclidean is the squared distance and cosine 1 - cos. rooted: euclidean is the distance and cosine the angular sqrt(2 (1 - cos)).
FLAVOURS = ("squared", "rooted")


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """The vector at length 1; a zero vector stays zero."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def score_of(raw: Column, metric: str, is_distance: bool, flavour: str = "squared") -> Column:
    """A reported score from the raw value: cos, the inner product, or the squared distance.

    Distances and similarities of cosine and inner product are each other's 1 - x; of euclidean, 1 / (1 + x). In the
    rooted flavour euclidean distance is rooted, and cosine distance is the angular one.
    """
    check_metric(metric, flavour)
    if metric == "euclidean":
        d = F.sqrt(raw) if flavour == "rooted" else raw
        return d if is_distance else 1 / (1 + d)
    if metric == "cosine" and flavour == "rooted":
        angular = F.sqrt(F.greatest(F.lit(0.0), 2 * (1 - raw)))
        return angular if is_distance else 1 - angular
    return 1 - raw if is_distance else raw


def check_metric(metric: str, flavour: str = "squared") -> None:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    if flavour not in FLAVOURS:
        raise ValueError(f"flavour must be one of {FLAVOURS}, not {flavour!r}")


def pooled(tokens: Column, how: str, mask: Column | None = None) -> Column:
    """An array of vectors pooled element by element: mean, min, max, or cls, the first of them; with a mask, an array as long, of those where it is 1, and null if there are none."""
    if mask is not None:
        kept = F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["t"])
        return F.when(F.size(kept) > 0, pooled(kept, how))
    if how == "cls":
        return tokens[0]
    fold = {"mean": lambda x, y: x + y, "min": lambda x, y: F.least(x, y), "max": lambda x, y: F.greatest(x, y)}
    if how not in fold:
        raise NotImplementedError(f"pooling {how!r}")
    total = F.aggregate(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), tokens[0], lambda acc, v: F.zip_with(acc, v, fold[how]))
    return F.transform(total, lambda x: x / F.size(tokens)) if how == "mean" else total


def softmax(scores: Column) -> Column:
    """Shares by exponential, shifted by the greatest score; an empty array stays empty."""
    top = F.array_max(scores)
    grown = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(grown, F.lit(0.0), lambda s, x: s + x)
    return F.transform(grown, lambda x: x / total)


def clamped(values: Column, low: float, high: float) -> Column:
    return F.transform(values, lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def rescaled(values: Column, low: float, high: float) -> Column:
    """Values brought linearly from their own range to [low, high]; equal ones to low."""
    a, b = F.array_min(values), F.array_max(values)
    return F.transform(values, lambda x: F.when(b > a, F.lit(low) + (x - a) / (b - a) * (high - low)).otherwise(F.lit(low)))


def decibels(power: Column, least: float = 1e-10) -> Column:
    """Powers on the decibel scale against 1, none under `least`."""
    return F.transform(power, lambda x: 10 * F.log10(F.greatest(x, F.lit(least))))


def frames(values: Column, size: int, hop: int) -> Column:
    """Whole frames of `size` values, one every `hop`; too few values give none."""
    n = F.floor((F.size(values) - size) / hop).cast("int")
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda k: F.slice(values, k * hop + 1, F.lit(size)))).otherwise(F.array().cast("array<array<double>>"))
