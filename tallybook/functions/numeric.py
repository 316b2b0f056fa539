"""Exact money arithmetic and guarded division.

Sums of money must not depend on the order rows arrive in. Decimals guarantee
that, but turning doubles into decimals and adding wide decimals row by row costs
several times the rest of a scan. Amounts therefore travel as integers in
1/10000 of the currency (a two-digit price times a two-digit rate is exact), and
``exact_sum`` adds their high and low parts as plain integers, so that no group
can overflow; only the result of a group is a decimal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"
AMOUNT_SCALE = 10_000
LOW_BITS = 20


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def money(value: Column | str) -> Column:
    """Two-digit decimal, for text and single values."""
    return col(value).cast(MONEY)


def hundredths(value: Column | str) -> Column:
    """Two-digit number (price, rate) as an integer: 12.34 -> 1234."""
    return F.rint(col(value) * 100).cast("long")


def exact_units(amount: Column | str) -> Column:
    """Exact sum of integers of any number of rows, as a whole decimal."""
    amount = col(amount)
    high = F.sum(F.shiftright(amount, LOW_BITS)).cast("decimal(24,0)")
    low = F.sum(amount.bitwiseAND((1 << LOW_BITS) - 1)).cast("decimal(24,0)")
    return high * F.lit(1 << LOW_BITS).cast("decimal(7,0)") + low


def in_currency(units: Column) -> Column:
    """Whole decimal of 1/10000 as a decimal with four digits."""
    return units * F.lit("0.0001").cast("decimal(4,4)")


def exact_sum(amount: Column | str) -> Column:
    """Exact sum of amounts, in currency."""
    return in_currency(exact_units(amount))


def total(amount: Column | str) -> Column:
    """Exact sum of amounts, shown as a double."""
    return exact_sum(amount).cast("double")


def mean_amount(amount: Column | str) -> Column:
    """Average amount from an exact sum; NULL over no rows."""
    return ratio(exact_sum(amount), F.count(col(amount)))


def mean(value: Column | str) -> Column:
    """Average of integers or decimals from an exact sum; NULL over no rows."""
    value = col(value)
    return ratio(F.sum(value), F.count(value))


def ratio(top: Column, bottom: Column) -> Column:
    """Double division that gives NULL where the divisor is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def count_if(condition: Column) -> Column:
    """Rows that satisfy the condition; zero, never NULL."""
    return F.count(F.when(condition, F.lit(1)))


def amount_if(condition: Column, amount: Column | str) -> Column:
    """Exact sum of the amounts of rows that satisfy the condition."""
    return exact_sum(F.when(condition, col(amount)))


def sum_if(condition: Column, value: Column | str) -> Column:
    return F.sum(F.when(condition, col(value)))
