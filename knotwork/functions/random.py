"""Seeded random numbers as pure functions of a key: the same whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column | str) -> Column:
    """A double in [0, 1) from the seed and the keys."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") / F.lit(float(1 << 53))


def integer(n: int | Column, seed: int, *keys: Column | str) -> Column:
    """A whole number from 0 to n - 1."""
    return F.floor(uniform(seed, *keys) * n).cast("long")


def order(seed: int, *keys: Column | str) -> list[Column]:
    """Columns to sort by for a seeded random order."""
    return [F.xxhash64(F.lit(seed), *keys), *(F.col(k) if isinstance(k, str) else k for k in keys)]


def binomial(n: Column | str, p: float, seed: int, *keys: Column | str) -> Column:
    """How many of n draws with probability p come out, by drawing them: exact, and of n steps a row."""
    n = F.col(n) if isinstance(n, str) else n
    some = F.sequence(F.lit(1).cast("long"), F.greatest(n.cast("long"), F.lit(1)))
    drawn = F.aggregate(some, F.lit(0).cast("long"), lambda total, k: total + F.when((k <= n) & (uniform(seed, k, *keys) < p), 1).otherwise(0))
    return drawn
