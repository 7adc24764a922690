"""The rounding rules used by the operators, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def half_up(value: Column) -> Column:
    """Nearest integer, halves upward (all geometry rules)."""
    return F.floor(value + F.lit(0.5))


def idiv(num: Column, den) -> Column:
    """Integer division; both sides non-negative wherever it is used."""
    return F.call_function("div", num, lit(den))


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` of non-negative integers, rounded half up without floating point."""
    return idiv(num * 2 + den, den * 2)


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, lit(low)), lit(high))


def one_decimal(value: Column) -> Column:
    """One decimal, ties to even, decided on the exact binary value.

    ``(16 v - (2 n + 1)) + 4 v`` has the sign of ``v`` minus the midpoint ``(2 n + 1) / 20``; both
    steps subtract numbers within a factor of two, so neither rounds. Values too large to have a
    decimal in question, infinities and NaN stay as they are.
    """
    n = F.floor(value * 10)
    side = (value * 16 - (n * 2 + 1)) + value * 4
    up = (side > 0) | ((side == 0) & (n % 2 != 0))
    return F.when(F.abs(value) < 1e6, F.when(up, n + 1).otherwise(n) / F.lit(10.0)).otherwise(value)


def byte(value: Column) -> Column:
    """Clamp to 0..255 and round half up to an int."""
    return clamp(half_up(value), F.lit(0), F.lit(255)).cast("int")
