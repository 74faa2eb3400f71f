"""Vector arithmetic on array columns, in double precision, without Python.

A missing component is NULL (NaN is made NULL): measures run over the components both sides have.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GUARD = 1e-12
STD_OFFSET = 1e-3


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def add_up(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return add_up(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def components(prefix: str, v: Column, dim: int) -> dict[str, Column]:
    """The components of a vector as columns of their own, 0 where there is none: for pairs by the million, whose
    dot products are then one generated expression instead of a loop over arrays for each pair."""
    return {f"{prefix}{i}": F.coalesce(F.get(doubles(v), F.lit(i)), F.lit(0.0)) for i in range(dim)}


def dot_of_components(a: str, b: str, dim: int) -> Column:
    out = F.col(f"{a}0") * F.col(f"{b}0")
    for i in range(1, dim):
        out = out + F.col(f"{a}{i}") * F.col(f"{b}{i}")
    return out


def norm(v: Column) -> Column:
    return F.sqrt(add_up(F.transform(doubles(v), lambda x: x * x)))


def unit(v: Column) -> Column:
    """The vector by its length; unchanged where that is no more than the guard."""
    n = norm(v)
    return F.when(n > GUARD, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def cosine_of_norms(product: Column, na: Column, nb: Column) -> Column:
    """Cosine from a dot product and precomputed lengths; 0 where a side is missing or null."""
    return F.coalesce(F.when((na > GUARD) & (nb > GUARD), product / (na * nb)), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    return cosine_of_norms(dot(a, b), norm(a), norm(b))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance; 0 where a side is missing."""
    return F.coalesce(F.sqrt(add_up(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))), F.lit(0.0))


def present(v: Column) -> Column:
    return F.filter(v, lambda x: x.isNotNull())


def mean_of(v: Column) -> Column:
    return F.try_divide(add_up(v), F.size(v))


def rms_distance(a: Column, b: Column) -> Column:
    """Root of the mean squared difference over the components both sides have; else 0."""
    squares = present(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))
    return F.coalesce(F.sqrt(mean_of(squares)), F.lit(0.0))


def zscores(v: Column, centre: Column, std: Column) -> Column:
    """Absolute differences by (std + offset), for the components that all sides have."""
    pairs = F.zip_with(centre, std, lambda c, s: F.struct(c.alias("c"), s.alias("s")))
    return present(F.zip_with(v, pairs, lambda x, p: F.abs(x - p["c"]) / (p["s"] + STD_OFFSET)))


def range_ratio(v: Column, low: Column, high: Column) -> Column:
    """Share of the components within [low, high], of those that all sides have; 0 without any."""
    pairs = F.zip_with(low, high, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    inside = present(F.zip_with(v, pairs, lambda x, p: F.when(x.between(p["a"], p["b"]), 1.0).when(x.isNotNull() & p["a"].isNotNull() & p["b"].isNotNull(), 0.0)))
    return F.coalesce(mean_of(inside), F.lit(0.0))


def joint_cosine(a: Column, b: Column) -> Column:
    """Cosine over the components both sides have; 0 without any."""
    both = F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return cosine(F.transform(both, lambda p: p["x"]), F.transform(both, lambda p: p["y"]))
