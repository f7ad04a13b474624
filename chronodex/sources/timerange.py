"""Time ranges given as text: ``7d``, ``2w``, ``3m``, ``1y`` before now, or a date."""

from __future__ import annotations

import datetime as dt
import re

_DAYS = {"d": 1, "w": 7, "m": 30, "y": 365}


def parse_time(text: str, now: dt.datetime) -> dt.datetime:
    """The time that a text names. Raises ValueError for anything else, and for an amount of 0."""
    s = text.strip().lower()
    if m := re.fullmatch(r"(\d+)([dwmy])", s):
        if int(m[1]) == 0:
            raise ValueError(f"an amount must be more than 0: {text!r}")
        return now - dt.timedelta(days=int(m[1]) * _DAYS[m[2]])
    try:
        return dt.datetime.strptime(s, "%Y-%m-%d").replace(tzinfo=now.tzinfo)
    except ValueError:
        raise ValueError(f"neither a date nor an age like 7d: {text!r}") from None


def time_range(now: dt.datetime, after: str | None = None, before: str | None = None, max_age: str | None = None) -> tuple[dt.datetime | None, dt.datetime | None]:
    """(after, before); ``after`` goes before ``max_age``. Raises ValueError if it is empty."""
    start = parse_time(after, now) if after else parse_time(max_age, now) if max_age else None
    end = parse_time(before, now) if before else None
    if start and end and start >= end:
        raise ValueError("the range is empty")
    return start, end
