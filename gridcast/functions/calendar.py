"""Calendar parts, seasons, cyclical encodings and holiday rules."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from gridcast.functions import as_col

# Fixed display order of day names, Monday first.
DAY_NAMES = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")

# Fixed season names, each three months, December first.
SEASONS = ("Winter", "Spring", "Summer", "Fall")

# Fixed holiday names that have their own feature column.
NAMED_HOLIDAYS = {
    "is_thanksgiving": "Thanksgiving",
    "is_christmas": "Christmas Day",
    "is_new_years": "New Year's Day",
    "is_july4": "Independence Day",
}


def calendar_parts(ts: Column | str) -> dict[str, Column]:
    """hour, Monday-first weekday, month, day, day of year, ISO week, weekend flag."""
    ts = as_col(ts)
    return {
        "hour": F.hour(ts),
        "day_of_week": F.weekday(ts),
        "month": F.month(ts),
        "day_of_month": F.dayofmonth(ts),
        "day_of_year": F.dayofyear(ts),
        "week_of_year": F.weekofyear(ts),
        "is_weekend": flag(F.weekday(ts) >= 5),
    }


def flag(condition: Column) -> Column:
    """PF11: predicate to 0/1; an unknown comparison counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def day_name(ts: Column | str) -> Column:
    """Mon..Sun."""
    return F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), F.weekday(as_col(ts)) + 1)


def dayhour_index(ts: Column | str) -> Column:
    """hour of the week, 0..167, Monday 00:00 first."""
    ts = as_col(ts)
    return F.weekday(ts) * 24 + F.hour(ts)


def cyclical_sin(x: Column | str, period: int) -> Column:
    """F10."""
    return F.sin(F.lit(2 * math.pi) * as_col(x) / F.lit(period))


def cyclical_cos(x: Column | str, period: int) -> Column:
    """F10."""
    return F.cos(F.lit(2 * math.pi) * as_col(x) / F.lit(period))


def season_of_month(month: Column | str) -> Column:
    """PF9: March to May is spring and so on; an unknown month counts as winter."""
    by_month = [SEASONS[(m % 12) // 3] for m in range(1, 13)]
    return F.coalesce(F.element_at(F.array(*[F.lit(s) for s in by_month]), as_col(month)), F.lit("Winter"))


def season_year(year: Column | str, month: Column | str) -> Column:
    """PF10: December belongs to the next year's winter."""
    return as_col(year) + (as_col(month) == 12).cast("int")


def holiday_name_flags(name: Column | str) -> dict[str, Column]:
    """one flag per named holiday, and one for every other holiday. ``name`` is null on a
    working day."""
    name = as_col(name)
    named = {k: flag(name == F.lit(v)) for k, v in NAMED_HOLIDAYS.items()}
    other = flag(name.isNotNull() & ~name.isin(*NAMED_HOLIDAYS.values()))
    return {**named, "is_other_holiday": other}


def holiday_rule(d: Column | str) -> Column:
    """Name of the US federal holiday that falls on date ``d`` itself, else null."""
    d = as_col(d)
    y, m, dom, wd = F.year(d), F.month(d), F.dayofmonth(d), F.weekday(d)

    def fixed(month: int, day: int) -> Column:
        return (m == month) & (dom == day)

    def nth(month: int, weekday: int, n: int) -> Column:
        return (m == month) & (wd == weekday) & dom.between(7 * n - 6, 7 * n)

    # Fixed rules of the federal calendar: name, date rule, first year.
    return (
        F.when(fixed(1, 1), "New Year's Day")
        .when(nth(1, 0, 3) & (y >= 1986), "Martin Luther King Jr. Day")
        .when(nth(2, 0, 3), "Washington's Birthday")
        .when((m == 5) & (wd == 0) & (dom >= 25), "Memorial Day")
        .when(fixed(6, 19) & (y >= 2021), "Juneteenth National Independence Day")
        .when(fixed(7, 4), "Independence Day")
        .when(nth(9, 0, 1), "Labor Day")
        .when(nth(10, 0, 2), "Columbus Day")
        .when(fixed(11, 11), "Veterans Day")
        .when(nth(11, 3, 4), "Thanksgiving")
        .when(fixed(12, 25), "Christmas Day")
    )


def holiday_rule_observed(d: Column | str) -> Column:
    """As :func:`holiday_rule`; a fixed-date holiday on a Saturday is also observed on the Friday
    before and one on a Sunday on the Monday after, under its own "(observed)" name."""
    d = as_col(d)
    day_before, day_after, wd = F.date_sub(d, 1), F.date_add(d, 1), F.weekday(d)
    shifted = F.when(wd == 4, holiday_rule(day_after)).when(wd == 0, holiday_rule(day_before))
    return F.coalesce(holiday_rule(d), F.concat(shifted, F.lit(" (observed)")))
