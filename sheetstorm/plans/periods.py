"""Periods as whole numbers of a granularity; text in and out, and conversion between granularities.

year: the year; quarter: year * 4 + quarter - 1; month: year * 12 + month - 1; day: the spreadsheet
serial (1970-01-01 is 25569); hour: serial * 24 + hour; week: ISO weeks since Monday 1900-01-01.
"""

from __future__ import annotations

import math
import re
from datetime import date, timedelta

GRANULARITIES = ("hour", "day", "week", "month", "quarter", "year")
EPOCH_SERIAL = 25569
FIRST_MONDAY = 2
_EPOCH = date(1970, 1, 1)
_FORMS = re.compile(
    r"(?P<y>\d{4})(?:-(?:[qQ](?P<q>[1-4])|[wW](?P<w>\d{1,2})|(?P<m>\d{1,2})(?:-(?P<d>\d{1,2})(?:[tT](?P<h>\d{1,2}))?)?))?"
)


def serial(year: int, month: int, day: int) -> int:
    """The serial of a date, carrying months and days beyond their range."""
    years, months = divmod(month - 1, 12)
    return (date(year + years, months + 1, 1) - _EPOCH).days + day - 1 + EPOCH_SERIAL


def to_date(number: int) -> date:
    return _EPOCH + timedelta(days=number - EPOCH_SERIAL)


def parse_period(text: str) -> tuple[str, int] | None:
    """(granularity, number) of a period, loose forms included; None if the text is none."""
    m = _FORMS.fullmatch(text.strip())
    if not m:
        return None
    year = int(m["y"])
    if year < 1000:
        return None
    if m["q"]:
        return "quarter", year * 4 + int(m["q"]) - 1
    if m["w"]:
        try:
            monday = date.fromisocalendar(year, int(m["w"]), 1)
        except ValueError:
            return None
        return "week", ((monday - _EPOCH).days + EPOCH_SERIAL - FIRST_MONDAY) // 7
    if not m["m"]:
        return "year", year
    month = int(m["m"])
    if not 1 <= month <= 12:
        return None
    if not m["d"]:
        return "month", year * 12 + month - 1
    try:
        days = (date(year, month, int(m["d"])) - _EPOCH).days + EPOCH_SERIAL
    except ValueError:
        return None
    if not m["h"]:
        return "day", days
    return ("hour", days * 24 + int(m["h"])) if int(m["h"]) < 24 else None


def format_period(number: float, granularity: str) -> str:
    i = math.floor(number + 0.5)
    if granularity == "year":
        return str(i)
    if granularity == "quarter":
        return f"{i // 4}-Q{i % 4 + 1}"
    if granularity == "month":
        return f"{i // 12}-{i % 12 + 1:02d}"
    if granularity == "week":
        year, week, _ = to_date(i * 7 + FIRST_MONDAY).isocalendar()
        return f"{year}-W{week:02d}"
    if granularity == "day":
        return to_date(i).isoformat()
    return f"{to_date(i // 24).isoformat()}T{i % 24:02d}"


def normalise(text: str) -> str:
    """`2026-7` becomes `2026-07`; what is no period stays."""
    found = parse_period(text)
    return format_period(found[1], found[0]) if found else text


def first_day(number: int, granularity: str) -> int:
    if granularity == "hour":
        return number // 24
    if granularity == "week":
        return number * 7 + FIRST_MONDAY
    if granularity == "day":
        return number
    month = number * {"month": 1, "quarter": 3, "year": 12}[granularity]
    return serial(month // 12, month % 12 + 1, 1)


def convert(number: int, source: str, target: str) -> int:
    """The period that holds the start, when going coarser; the first one inside, when going finer."""
    if source == target:
        return number
    if target in ("month", "quarter", "year"):
        if source in ("month", "quarter", "year"):
            month = number * {"month": 1, "quarter": 3, "year": 12}[source]
        else:
            day = to_date(first_day(number, source))
            month = day.year * 12 + day.month - 1
        return month // {"month": 1, "quarter": 3, "year": 12}[target]
    day = first_day(number, source)
    return {"day": day, "hour": day * 24, "week": (day - FIRST_MONDAY) // 7}[target]


def containing(day: date, granularity: str, hour: int = 0) -> int:
    """The period of a granularity that holds a date."""
    number = (day - _EPOCH).days + EPOCH_SERIAL
    return number * 24 + hour if granularity == "hour" else convert(number, "day", granularity)
