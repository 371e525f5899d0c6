"""Periods in columns: serials of dates, conversion between granularities, parts, text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.periods import EPOCH_SERIAL, FIRST_MONDAY

MONTHS = {"month": 1, "quarter": 3, "year": 12}


def _floor_div(a: Column, b: int) -> Column:
    """Whole numbers; towards minus infinity."""
    return (a - F.pmod(a, F.lit(b).cast("long"))).cast("long") / F.lit(b)


def _whole(a: Column) -> Column:
    return a.cast("long")


def serial_of(day: Column) -> Column:
    """The serial of a date or timestamp."""
    return (F.unix_date(day.cast("date")) + EPOCH_SERIAL).cast("long")


def date_of(serial: Column) -> Column:
    return F.date_from_unix_date((serial - EPOCH_SERIAL).cast("int"))


def period_of(time: Column, granularity: str) -> Column:
    """The number of the period that holds a date or timestamp."""
    if granularity == "hour":
        return serial_of(time) * 24 + F.hour(time)
    return convert(serial_of(time), "day", granularity)


def first_day(number: Column, granularity: str) -> Column:
    if granularity == "day":
        return number
    if granularity == "hour":
        return _whole(_floor_div(number, 24))
    if granularity == "week":
        return number * 7 + FIRST_MONDAY
    month = number * MONTHS[granularity]
    return serial_of(F.make_date(_whole(_floor_div(month, 12)).cast("int"), (F.pmod(month, F.lit(12).cast("long")) + 1).cast("int"), F.lit(1)))


def convert(number: Column, source: str, target: str) -> Column:
    """The period that holds the start when going coarser, the first one inside when going finer."""
    number = number.cast("long")
    if source == target:
        return number
    if target in MONTHS:
        if source in MONTHS:
            month = number * MONTHS[source]
        else:
            day = date_of(first_day(number, source))
            month = (F.year(day) * 12 + F.month(day) - 1).cast("long")
        return _whole(_floor_div(month, MONTHS[target]))
    day = first_day(number, source)
    if target == "day":
        return day
    return day * 24 if target == "hour" else _whole(_floor_div(day - FIRST_MONDAY, 7))


def format_period(number: Column, granularity: str) -> Column:
    number = number.cast("long")
    if granularity == "year":
        return number.cast("string")
    if granularity in ("quarter", "month"):
        per_year = 12 // MONTHS[granularity]
        part = F.pmod(number, F.lit(per_year).cast("long")) + 1
        text = F.concat(F.lit("Q"), part) if granularity == "quarter" else F.lpad(part.cast("string"), 2, "0")
        return F.concat_ws("-", _whole(_floor_div(number, per_year)), text)
    day = date_of(first_day(number, granularity))
    if granularity == "week":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), day), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    text = F.date_format(day, "yyyy-MM-dd")
    return text if granularity == "day" else F.concat(text, F.lit("T"), F.lpad(F.pmod(number, F.lit(24).cast("long")).cast("string"), 2, "0"))


#: Forms of a period's text, loose ones included: year, and quarter, week, or month, day and hour.
TEXT = r"^([0-9]{4})(?:-(?:[qQ]([1-4])|[wW]([0-9]{1,2})|([0-9]{1,2})(?:-([0-9]{1,2})(?:[tT]([0-9]{1,2}))?)?))?$"


def parse_period(text: Column) -> Column:
    """A struct of granularity and number of a period's text, in columns; null for what is no period.

    A week must be one that its year has, a day one of its month, an hour below 24.
    """
    trimmed = F.trim(text)
    part = lambda i: F.regexp_extract(trimmed, TEXT, i)
    given = lambda i: part(i) != ""
    number = lambda i: F.try_to_number(part(i), F.lit("9999")).cast("int")
    year = number(1)
    first_thursday = F.make_date(year, F.lit(1), F.lit(4))
    monday = F.date_sub(F.date_add(F.trunc(first_thursday, "week"), number(3) * 7), 7)
    day = F.try_to_date(F.concat_ws("-", part(1), F.lpad(part(4), 2, "0"), F.lpad(part(5), 2, "0")), "yyyy-MM-dd")
    found = lambda granularity, value: F.struct(F.lit(granularity).alias("granularity"), value.cast("long").alias("number"))
    return (
        F.when(~F.coalesce(F.regexp_like(trimmed, F.lit(TEXT)), F.lit(False)) | (year < 1000), None)
        .when(given(2), found("quarter", year * 4 + number(2) - 1))
        .when(given(3), F.when((number(3) > 0) & (F.extract(F.lit("YEAROFWEEK"), monday) == year), found("week", _whole(_floor_div(serial_of(monday) - FIRST_MONDAY, 7)))))
        .when(~given(4), found("year", year))
        .when(~number(4).between(1, 12), None)
        .when(~given(5), found("month", year * 12 + number(4) - 1))
        .when(day.isNull(), None)
        .when(~given(6), found("day", serial_of(day)))
        .when(number(6) < 24, found("hour", serial_of(day) * 24 + number(6)))
    )


def normalise_period(text: Column) -> Column:
    """The text of a period in its one form; other texts stay."""
    found = parse_period(text)
    return reduce(lambda other, g: F.when(found["granularity"] == g, format_period(found["number"], g)).otherwise(other), ("hour", "day", "week", "month", "quarter", "year"), text)
