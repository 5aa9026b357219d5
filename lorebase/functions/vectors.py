"""Vector expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-12


def as_doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """Null if one of the vectors has no direction (all zeros)."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def directed(v: Column) -> Column:
    """Is ``v`` a vector with a direction: neither null nor zero, and without null or infinite components?"""
    return F.coalesce(F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def l2_normalize(a: Column) -> Column:
    size = F.greatest(norm(a), F.lit(FLOOR))
    # as the only item of an array it is computed once a vector; inside the inner function it would be once a component
    return F.element_at(F.transform(F.array(size), lambda n: F.transform(as_doubles(a), lambda x: x / n)), 1)


def mean_pool(df: DataFrame, owner: str, vector: str) -> DataFrame:
    """Per owner the mean of its vectors, normalised.  Partial sums meet per (owner, place)."""
    cells = df.where(F.col(owner).isNotNull() & F.col(vector).isNotNull()).select(owner, F.posexplode(as_doubles(F.col(vector))).alias("place", "x"))
    means = cells.groupBy(owner, "place").agg(F.avg("x").alias("x"))
    pooled = means.groupBy(owner).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("pooled"))
    return pooled.select(owner, l2_normalize(F.col("pooled")).alias("pooled"))
