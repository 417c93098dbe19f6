"""Vectors, shares and evenly spread positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two float arrays, summed in double."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def cosine_distance(a: Column, b: Column) -> Column:
    """Distance of unit vectors."""
    return F.lit(1.0) - dot(a, b)


def nearest_rank(count: Column, share: float) -> Column:
    """0-based position of a percentile in `count` sorted values, rounded down."""
    return F.floor(F.lit(float(share)) * (count - 1))


def even_positions(count: Column, wanted: Column) -> Column:
    """0-based positions of `wanted` of `count` rows, first and last included.

    All rows when fewer than wanted; only the first for one; ties round to even.
    """
    steps = F.sequence(F.lit(0).cast("long"), F.greatest(wanted, F.lit(1)).cast("long") - 1)
    spread = F.transform(
        steps, lambda i: F.bround((i * (count - 1)).cast("double") / (wanted - 1), 0).cast("long")
    )
    return (
        F.when(wanted >= count, F.sequence(F.lit(0).cast("long"), F.greatest(count, F.lit(1)).cast("long") - 1))
        .when(wanted <= 0, F.array().cast("array<bigint>"))
        .when(wanted == 1, F.array(F.lit(0).cast("long")))
        .otherwise(spread)
    )
