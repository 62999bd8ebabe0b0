"""Vector expressions on array columns; all arithmetic in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value worked out once, however often f names it: columns are expressions, not variables."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def is_valid(v: Column) -> Column:
    """Not null, not empty, finite throughout, with a finite positive norm; never null."""
    sound = F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(F.forall(v, _finite), F.lit(False))
    return F.when(sound, F.coalesce(bound(norm(v), lambda n: (n > 0) & (n < float("inf"))), F.lit(False))).otherwise(F.lit(False))


def _scaled(v: Column) -> Column:
    return bound(norm(v), lambda n: F.transform(v, lambda x: x.cast("double") / n))


def normalise(v: Column) -> Column:
    """Unit vector, or null where there is none."""
    return F.when(is_valid(v), _scaled(v))


def normalise_finite_norm(v: Column) -> Column:
    """Unit vector wherever the norm is finite and positive."""
    return F.when((norm(v) > 0) & (norm(v) < float("inf")), _scaled(v))


def normalise_or_keep(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    return F.when(norm(v) > 0, _scaled(v)).otherwise(v.cast("array<double>"))


def dot(a: Column, b: Column) -> Column:
    """Inner product; null where the sizes differ."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def cosine(a: Column, b: Column) -> Column:
    """Inner product of unit vectors, held to [-1, 1]."""
    return bound(dot(a, b), lambda d: F.when(d.isNotNull(), clip(d, -1.0, 1.0)))
