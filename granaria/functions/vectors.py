"""Vector arithmetic on array columns with higher-order functions, JVM-side."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2(v: Column, floor: float = 1e-12) -> Column:
    """Row L2 normalisation with a floor under the norm."""
    n = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.lit(floor))
    return F.transform(v, lambda x: x.cast("double") / n)


def argmax(v: Column) -> Column:
    """Zero-based position of the largest value, the first on a tie."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def argmax_last(v: Column) -> Column:
    """Zero-based position of the largest value, the last on a tie (order of a reversed sort)."""
    return (F.size(v) - F.array_position(F.reverse(v), F.array_max(v))).cast("int")


def ranked(v: Column) -> Column:
    return F.sort_array(v, asc=False)


def margin(v: Column) -> Column:
    """Largest minus second largest; the largest itself where there is one value."""
    s = ranked(v)
    return s[0] - F.coalesce(F.get(s, F.lit(1)), F.lit(0.0))


def softmax(v: Column, clip: float = 50.0) -> Column:
    top = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(F.greatest(F.lit(-clip), x - top)))
    return F.transform(e, lambda x: x / F.greatest(total(e), F.lit(1e-12)))


def certainty(v: Column, classes: int) -> Column:
    """One minus the entropy normalised by its largest value; probabilities are floored at 1e-15."""
    h = F.aggregate(v, F.lit(0.0), lambda s, p: s - p * F.log(F.greatest(p, F.lit(1e-15))))
    return 1.0 - h / math.log(classes)


def is_distribution(v: Column, width: int, tolerance: float = 1e-5) -> Column:
    """Right width, finite, not negative, sum one."""
    fine = F.forall(v, lambda x: ~F.isnan(x) & (x >= 0) & (x < float("inf")))
    return F.coalesce((F.size(v) == width) & fine & (F.abs(total(v) - 1.0) <= tolerance), F.lit(False))
