"""Upper-bound salary, in lakh per annum, out of a display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .base import capture, found, text


def _amount(t: Column, pattern: str, *groups: int) -> Column:
    return F.coalesce(*[capture(t, pattern, g) for g in groups]).try_cast("double")


def _whole(value: Column) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(1), F.bround(value, 0).cast("int")))


def salary_int(salary: Column) -> Column:
    """Ordered rules; the first whose pattern occurs decides, even if its number is unreadable."""
    t = F.replace(text(salary), F.lit(","), F.lit(""))
    monthly = found(t, fixed.SALARY_MONTHLY)
    amount = _amount(t, fixed.SALARY_AMOUNT_RANGE, 2)
    return (
        F.when(found(t, fixed.SALARY_UNDISCLOSED), F.lit(None).cast("int"))
        .when(found(t, fixed.SALARY_UNIT_RANGE), _whole(_amount(t, fixed.SALARY_UNIT_RANGE, 2)))
        .when(found(t, fixed.SALARY_UNIT_SINGLE), _whole(_amount(t, fixed.SALARY_UNIT_SINGLE, 1)))
        .when(found(t, fixed.SALARY_CRORE), _whole(_amount(t, fixed.SALARY_CRORE, 2, 1) * 100))
        .when(
            found(t, fixed.SALARY_THOUSANDS) & monthly,
            _whole(_amount(t, fixed.SALARY_THOUSANDS, 2, 1) * 12 / 100),
        )
        .when(
            found(t, fixed.SALARY_AMOUNT_RANGE),
            _whole(F.when(monthly, amount * 12).otherwise(amount) / 100000),
        )
    )
