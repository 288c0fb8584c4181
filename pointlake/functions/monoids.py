"""Associative folds with an identity, as aggregate and merge expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Monoid:
    """``agg`` folds a group, ``merge`` joins two folds, ``identity`` is the empty fold.

    Folding folds with ``agg`` must give the fold of all, so a count is a sum of ones.
    ``inverse`` (a, b) gives the x with merge(x, b) = a, where there is one.
    """

    name: str
    agg: Callable[[Column | str], Column]
    merge: Callable[[Column, Column], Column]
    identity: object
    inverse: Callable[[Column, Column], Column] | None = None

    def folded(self, column: Column | str) -> Column:
        """The group's fold, with the identity for an empty group."""
        return self.or_identity(self.agg(column))

    def or_identity(self, value: Column) -> Column:
        return value if self.identity is None else F.coalesce(value, F.lit(self.identity))


def _either(pick: Callable) -> Callable[[Column, Column], Column]:
    """least/greatest skip nulls, so a null fold acts as the identity."""
    return lambda a, b: pick(a, b)


SUM = Monoid("sum", F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), 0, lambda a, b: a - F.coalesce(b, F.lit(0)))
MIN = Monoid("min", F.min, _either(F.least), None)
MAX = Monoid("max", F.max, _either(F.greatest), None)
PRODUCT = Monoid("product", F.product, lambda a, b: F.coalesce(a, F.lit(1)) * F.coalesce(b, F.lit(1)), 1)
BIT_AND = Monoid("bit_and", F.bit_and, lambda a, b: F.coalesce(a.bitwiseAND(b), a, b), -1)
BIT_OR = Monoid("bit_or", F.bit_or, lambda a, b: F.coalesce(a.bitwiseOR(b), a, b), 0)
BIT_XOR = Monoid("bit_xor", F.bit_xor, lambda a, b: F.coalesce(a.bitwiseXOR(b), a, b), 0, lambda a, b: F.coalesce(a.bitwiseXOR(b), a))
BOOL_AND = Monoid("bool_and", F.bool_and, lambda a, b: F.coalesce(a & b, a, b), True)
BOOL_OR = Monoid("bool_or", F.bool_or, lambda a, b: F.coalesce(a | b, a, b), False)
ALL = {m.name: m for m in (SUM, MIN, MAX, PRODUCT, BIT_AND, BIT_OR, BIT_XOR, BOOL_AND, BOOL_OR)}
