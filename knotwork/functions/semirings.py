"""Semirings as pairs of column expressions: an aggregate that adds and an expression that multiplies.

A product of NULL contributes nothing: that is how a multiply says that an edge does not count.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Semiring:
    name: str
    add: Callable[[Column], Column]
    multiply: Callable[[Column, Column], Column]
    identity: float | int | bool | None = None

    def filtered(self, keep: Callable[[Column], Column]) -> Semiring:
        """The same semiring over the edges whose value ``keep`` accepts."""
        return Semiring(f"{self.name}_filtered", self.add, lambda a, x: F.when(keep(a), self.multiply(a, x)), self.identity)


PLUS_TIMES = Semiring("plus_times", F.sum, lambda a, x: a * x, 0)
MIN_PLUS = Semiring("min_plus", F.min, lambda a, x: a + x)
MAX_TIMES = Semiring("max_times", F.max, lambda a, x: a * x, -1)
MAX_SECOND = Semiring("max_second", F.max, lambda a, x: x, -1)
MIN_SECOND = Semiring("min_second", F.min, lambda a, x: x)
OR_AND = Semiring("or_and", F.bool_or, lambda a, x: a & x, False)


def only(first: bool) -> Semiring:
    """For indexing: copies the first or second operand; two products for one place are an error."""

    def add(c: Column) -> Column:
        return F.when(F.count(c) <= 1, F.max(c)).otherwise(F.raise_error(F.lit("an index is not unique")))

    return Semiring("copy_first" if first else "copy_second", add, lambda a, x: a if first else x)


COPY_FIRST, COPY_SECOND = only(True), only(False)
