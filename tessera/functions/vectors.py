"""Vector functions over array<double> columns; arrays of floats are read as doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dbl(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """0 where a length is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    if metric == "cosine":
        return cosine(a, b)
    if metric == "euclidean":
        return 1 / (1 + euclidean(a, b))
    if metric == "dot":
        return dot(a, b)
    raise ValueError(f"no metric {metric!r}")


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    if metric == "cosine":
        return 1 - cosine(a, b)
    if metric == "euclidean":
        return euclidean(a, b)
    raise ValueError(f"no metric {metric!r}")


def truncated(v: Column, dims: int, model_dims: int) -> Column:
    """The first dims dimensions."""
    if not 0 < dims <= model_dims:
        raise ValueError(f"dims must be in 1..{model_dims}")
    return F.slice(v, 1, dims)


def finite(v: Column) -> Column:
    """v, or an error where it holds a NaN or an infinity."""
    bad = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(bad, F.raise_error(F.lit("vector is not finite"))).otherwise(v)


def softmax(scores: Column, sharpness: float = 1.0) -> Column:
    top = F.array_max(scores)
    exps = F.transform(scores, lambda s: F.exp((s - top) * sharpness))
    total = F.aggregate(exps, F.lit(0.0), lambda a, x: a + x)
    return F.transform(exps, lambda e: e / total)


def logsumexp(scores: Column) -> Column:
    top = F.array_max(scores)
    return top + F.log(F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.exp(s - top)))


def mean_vector(v: Column, dims: int) -> Column:
    """Aggregate: the mean of a vector column, as one partial average for each dimension."""
    return F.array(*[F.avg(F.get(v, F.lit(i))) for i in range(dims)])


def entropy(p: Column) -> Column:
    return -F.aggregate(p, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.log(x)).otherwise(0.0))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))
