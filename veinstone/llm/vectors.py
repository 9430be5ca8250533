"""What the operators on vectors share: components as whole numbers, and squared distances that are exact."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 1 << 24


def kept_vectors(table: DataFrame, scale: int, *others: Column, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, vector, others): rows whose vector is there and has no null or non-finite component, as floor(scale * x) each.

    A component whose floor is not within LIMIT is an error: squared distances of some thousands of such might not fit a long.
    """
    vector = table[vector_column].cast("array<double>")
    whole = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    number = lambda x: F.when(F.abs(x) < LIMIT / scale, F.floor(x * scale)).otherwise(F.raise_error(F.lit(f"vector component beyond {LIMIT // scale}")).cast("long"))
    kept = table.select(table[id_column].cast("long").alias("vec_id"), vector.alias("vector"), *others).where(whole)
    return kept.withColumn("vector", F.transform("vector", number))


def largest(*arrays: np.ndarray) -> int:
    return max((max(int(a.max()), -int(a.min())) for a in arrays if a.size), default=0)


def exact(width: int, most: int) -> type:
    """The type in which squared distances of vectors with components up to ``most`` either way are exact: double, since matrix products of doubles are fast, while every sum stays below 2^53."""
    return np.float64 if width * (2 * most) ** 2 < 1 << 53 else np.int64


def squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of each point to each centre, all of a type that is exact for them."""
    return (points * points).sum(axis=1)[:, None] - 2 * (points @ centres.T) + (centres * centres).sum(axis=1)[None, :]
