"""Vectors as arrays of doubles: dot, norm, cosine, pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


def doubles(v) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products, first component to last, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null for null, empty or zero vectors and for unequal lengths, so that such rows rank last."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


def cosine_or_zero(a: Column, b: Column) -> Column:
    """Cosine, with 0 where :func:`cosine` has null."""
    return F.coalesce(cosine(a, b), F.lit(0.0))


def normalized(a: Column, eps: float = EPS) -> Column:
    n = norm(a) + F.lit(eps)
    return F.transform(a, lambda x: x / n)


def mean_pool(df: DataFrame, keys: list[str], vec: str, eps: float = EPS) -> DataFrame:
    """Per key: each vector scaled to length 1, averaged, scaled to length 1 again: column ``pooled``.

    Averages are taken by component, so partial sums are combined before the shuffle.
    """
    parts = df.select(*keys, F.posexplode(normalized(doubles(vec), eps)).alias("pos", "x"))
    mean = parts.groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    whole = mean.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return whole.select(*keys, normalized(F.transform("v", lambda s: s["x"]), eps).alias("pooled"))


def six_digits(v: Column) -> Column:
    """A vector rounded to six significant digits, as its text form carries."""

    def one(x):
        scale = F.pow(F.lit(10.0), F.lit(5.0) - F.floor(F.log10(F.abs(x))))
        return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x * scale) / scale)

    return F.transform(v, one)
