"""Time literals of queries as nanoseconds since 1970."""

from __future__ import annotations

import datetime
import re

from loglens.functions.records import DAY_NS

_DATED = re.compile(r"(?:([0-9]{4})-)?([0-9]{2})-([0-9]{2}) ([0-9]{2}):([0-9]{2}):([0-9]{2})(?:[.:]([0-9]+))?")
_CLOCK = re.compile(r"([0-9]+):([0-9]+)(?::([0-9]+)(?:[.]([0-9]{0,9})|:([0-9]{0,9}))?)?")


def civil_days(year: int, month: int, day: int) -> int:
    """Days since 1970; days past a month's end run on."""
    return datetime.date(year + 400, month, 1).toordinal() - datetime.date(2370, 1, 1).toordinal() + day - 1  # the calendar repeats after 400 years


def year_of(ns: int) -> int:
    return (datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=ns // 1_000_000_000)).year


def time_value(text: str, base: int | None = None) -> int | None:
    """``[YYYY-]MM-DD HH:MM:SS[.fraction]`` or ``H:M[:S[.fraction]]``, a colon before the fraction too; None if neither.

    base: a timestamp whose year (for dates without one) and day (for times alone) are taken; 1970 without it.
    """
    text = text.strip()
    m = _DATED.fullmatch(text)
    if m:
        year = int(m[1]) if m[1] else year_of(base) if base is not None else 1970
        month, day, hour, minute, second = (int(m[i]) for i in range(2, 7))
        if not (1 <= month <= 12 and 1 <= day <= 31 and hour <= 23 and minute <= 59 and second <= 60):
            return None
        ns = (civil_days(year, month, day) * 86_400 + hour * 3600 + minute * 60 + second) * 1_000_000_000 + int((m[7] or "")[:9].ljust(9, "0"))
        return ns if -(1 << 63) <= ns < 1 << 63 else None
    m = _CLOCK.fullmatch(text)
    if not m:
        return None
    hour, minute, second = int(m[1]), int(m[2]), int(m[3] or 0)
    if hour > 23 or minute > 59 or second > 60:
        return None
    day = (base or 0) // DAY_NS * DAY_NS
    return day + (hour * 3600 + minute * 60 + second) * 1_000_000_000 + int((m[4] or m[5] or "").ljust(9, "0"))
