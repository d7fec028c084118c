"""Date functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(d: Column) -> dict[str, Column]:
    """Year, quarter, month, day, day of year, ISO week, Monday-first week label, week of month, weekday (Monday 0) and flags."""
    day, weekday = F.dayofmonth(d), F.weekday(d)
    return {
        "year": F.year(d), "quarter": F.quarter(d), "month": F.month(d), "day": day, "day_of_year": F.dayofyear(d), "weekday": weekday,
        "iso_week": F.weekofyear(d), "plain_week": F.floor((F.dayofyear(d) + 6 - weekday) / 7).cast("int"), "week_of_month": (F.floor((day - 1) / 7) + 1).cast("int"),
        "is_weekend": (weekday >= 5).cast("int"), "is_month_start": (day == 1).cast("int"), "is_month_end": (d == F.last_day(d)).cast("int"), "is_pay_day": day.isin(10, 25).cast("int"),
    }


def weeks_back(latest: Column, d: Column) -> Column:
    """0 for the last seven days, 1 for the seven before, and so on."""
    return F.floor(F.datediff(latest, d) / 7).cast("int")


def floor_days(latest: Column, d: Column, days: int) -> Column:
    return (F.floor(F.datediff(latest, d) / days) * days).cast("int")


def cyclic(x: Column, period: float) -> tuple[Column, Column]:
    turn = 2 * F.pi() * x / period
    return F.sin(turn), F.cos(turn)


def _dates(days: list[str]) -> Column:
    return F.array(*[F.lit(x).cast("date") for x in days])


def near_any(d: Column, days: list[str], within: int) -> Column:
    return F.exists(_dates(days), lambda h: F.abs(F.datediff(d, h)) <= within)


def days_to_nearest(d: Column, days: list[str]) -> Column:
    return F.array_min(F.transform(_dates(days), lambda h: F.abs(F.datediff(d, h))))


def days_to_next(d: Column, days: list[str], otherwise: int = 365) -> Column:
    return F.coalesce(F.datediff(F.array_min(F.filter(_dates(days), lambda h: h >= d)), d), F.lit(otherwise))


def day_series(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(first, last, F.expr("interval 1 day")))
