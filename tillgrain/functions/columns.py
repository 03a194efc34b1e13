"""Column expressions with the semantics that the retail tables need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def when(condition: Column, value) -> Column:
    """The value where the condition holds, else null: what an aggregate's filter leaves."""
    return F.when(condition, value)


def money(amount: Column) -> Column:
    """An exact sum of pence, as double: binary sums would depend on the order of rows."""
    return F.sum(amount.cast("decimal(18,2)")).cast("double")


def pence(x: Column) -> Column:
    """Two decimals, halves up, by the same steps in any engine."""
    return F.floor(x * 100 + 0.5) / 100


def ratio(a: Column, b: Column) -> Column:
    """Null where the divisor is zero or null."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def month_of(day: Column) -> Column:
    return F.trunc(day, "month")


def week_of(day: Column) -> Column:
    """The Monday of the day's week."""
    return F.trunc(day, "week")


def months_between(early: Column, late: Column) -> Column:
    """Month boundaries crossed."""
    return ((F.year(late) - F.year(early)) * 12 + F.month(late) - F.month(early)).cast("long")


def last_complete_monday(last_day: Column) -> Column:
    """The Monday of the last week that the data cover to its Sunday."""
    monday = F.trunc(last_day, "week")
    return F.when(F.weekday(last_day) == 6, monday).otherwise(F.date_sub(monday, 7))


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def middle(values: Column) -> Column:
    """The median of an array, null if it is empty."""
    ordered, n = F.sort_array(values), F.size(values)
    return F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)


def spread(x: Column, over=None) -> Column:
    """Sample standard deviation from sums of x and x squared: exact sums of whole numbers give equal results in any order."""
    def total(c: Column) -> Column:
        return F.sum(c).over(over) if over is not None else F.sum(c)

    def rows(c: Column) -> Column:
        return F.count(c).over(over) if over is not None else F.count(c)

    n, s, q = rows(x), total(x), total(x * x)
    return F.when(n >= 2, F.sqrt((n * q - s * s) / (n * (n - 1))))
