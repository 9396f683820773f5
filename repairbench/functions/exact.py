"""Exact money arithmetic on columns: whole pence, integer division with a stated rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(20,2)"


def money(c: Column) -> Column:
    """Two digits, half up."""
    return F.round(c.cast("decimal(38,10)"), 2).cast(MONEY)


def pence(c: Column) -> Column:
    return (c.cast(MONEY) * 100).cast("long")


def pounds(c: Column) -> Column:
    return (c / F.lit(100.0)).cast("double")


def div(a: Column, b: Column) -> Column:
    """Integer quotient towards zero; null if b is zero."""
    return F.call_function("div", a.cast("long"), F.when(b != 0, b.cast("long")))


def half_up(a: Column, b: Column) -> Column:
    """a / b of whole numbers (b > 0), half away from zero."""
    return F.signum(a).cast("long") * div(2 * F.abs(a) + b, 2 * b)


def half_even(a: Column, b: Column) -> Column:
    """a / b of whole numbers (a >= 0, b > 0), ties to the even neighbour."""
    q, r = div(a, b), a % b
    return q + F.when((2 * r > b) | ((2 * r == b) & (q % 2 == 1)), 1).otherwise(0)


def at_fraction(ordered: Column, num: int, den: int) -> Column:
    """Interpolated percentile num/den of a sorted array of whole numbers, times den."""
    n = F.size(ordered)
    pos = (n - 1) * num
    low, part = div(pos, F.lit(den)).cast("int"), (pos % den).cast("long")
    left = F.get(ordered, low)
    return F.when(n > 0, left * den + (F.get(ordered, F.least(low + 1, n - 1)) - left) * part)
