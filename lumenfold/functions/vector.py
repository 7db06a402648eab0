"""Column expressions over array<double> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def unit(a: Column, eps: float = 1e-12) -> Column:
    """a over its norm; a norm below eps counts as eps, so a zero vector stays zero."""
    return F.transform(F.array(F.greatest(norm(a), F.lit(eps))), lambda n: F.transform(a, lambda x: x / n))[0]


def cosine(a: Column, b: Column) -> Column:
    """Cosine, 0 where a vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def layers(a: Column, n_layers: int, width: int) -> list[Column]:
    return [F.slice(a, 1 + k * width, width) for k in range(n_layers)]


def unit_layers(a: Column, n_layers: int, width: int) -> Column:
    """Each layer's slice to unit norm, joined again."""
    return F.concat(*[unit(x) for x in layers(a, n_layers, width)])


def layernorm(a: Column, weight: Column, bias: Column) -> Column:
    """weight * (a - mean) / deviation + bias."""
    n = F.size(a)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    std = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x) / n - mean * mean)
    z = F.transform(F.array(F.struct(mean.alias("m"), std.alias("s"))), lambda t: F.transform(a, lambda x: (x - t["m"]) / t["s"]))[0]
    return F.zip_with(F.zip_with(z, weight, lambda x, w: x * w), bias, lambda x, b: x + b)
