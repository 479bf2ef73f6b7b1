"""Unary, binary and predicate functors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SINCE = "2009-07-01 00:00:00"


def constant(value) -> Column:
    return F.lit(value)


def identity(c: Column) -> Column:
    return c


def totality(*_: Column) -> Column:
    return F.lit(True)


def safe_inverse(c: Column, largest: float = 1.7976931348623157e308) -> Column:
    """1/x, the largest value at 0."""
    return F.when(c == 0, F.lit(largest)).otherwise(F.lit(1.0) / F.when(c != 0, c))


def exponentiate(a: Column, b: Column) -> Column:
    return F.pow(a, b)


def maximum(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def minimum(a: Column, b: Column) -> Column:
    return F.least(a, b)


def bitwise_and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def bitwise_or(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def bitwise_xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def logical_xor(a: Column, b: Column) -> Column:
    return a != b


def choose(n: Column, k: int) -> Column:
    """n over k, 0 where n < k."""
    out = F.lit(1.0)
    for i in range(k):
        out = out * (n - i) / (i + 1)
    return F.when(n >= k, out).otherwise(0.0)


# What the searches decide by. A parent that is not set is null.


def keep_in_frontier(parent: Column, known: Column) -> Column:
    """An edge that brings a parent to a vertex that has none yet."""
    return parent.isNotNull() & known.isNull()


def parent_is_set(parent: Column) -> Column:
    return parent.isNotNull()


def second_is_smaller(a: Column, b: Column) -> Column:
    return b < a


def select_degree(parent: Column, degree: Column) -> Column:
    """The degree of a vertex that is reached, 0 of another."""
    return F.when(parent.isNotNull(), degree).otherwise(0)


# Typed edges: follower BOOLEAN, latest TIMESTAMP (NULL: never), count.


def is_follower(follower: Column) -> Column:
    return follower


def is_active(count: Column) -> Column:
    return count > 0


def within(count: Column, latest: Column, begin, end) -> Column:
    return (count > 0) & latest.between(F.lit(begin).cast("timestamp"), F.lit(end).cast("timestamp"))


def since(count: Column, latest: Column, begin) -> Column:
    return (count > 0) & (latest >= F.lit(begin).cast("timestamp"))


def last_by(count: Column, latest: Column, end=DEFAULT_SINCE) -> Column:
    return (count > 0) & (latest <= F.lit(end).cast("timestamp"))


def symmetric_choice(a: Column, b: Column) -> Column:
    """The lesser of two times if their sum is odd, else the greater."""
    return F.when((a + b) % 2 == 1, F.least(a, b)).otherwise(F.greatest(a, b))


def add_typed_edges(count: str = "count", follower: str = "follower", latest: str = "latest") -> list[Column]:
    """Aggregates that add typed edges: counts add, follower is OR, the latest of the active edges counts."""
    c = F.col(count)
    return [F.sum(c).alias(count), F.bool_or(follower).alias(follower), F.max(F.when(c > 0, F.col(latest))).alias(latest)]
