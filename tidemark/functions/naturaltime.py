"""Moments written by people, folded to microseconds when a statement is parsed; ``now`` is always given."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta, timezone

SECOND = 1_000_000
_UNITS = {"second": SECOND, "sec": SECOND, "minute": 60 * SECOND, "min": 60 * SECOND, "hour": 3600 * SECOND, "hr": 3600 * SECOND, "day": 86400 * SECOND, "week": 7 * 86400 * SECOND, "month": 30 * 86400 * SECOND, "year": 365 * 86400 * SECOND}
_ZONES = {"utc": 0.0, "gmt": 0.0, "z": 0.0, "est": -5.0, "edt": -4.0, "cst": -6.0, "cdt": -5.0, "mst": -7.0, "mdt": -6.0, "pst": -8.0, "pdt": -7.0, "ist": 5.5, "bst": 1.0, "cet": 1.0, "cest": 2.0}
_DATES = ("%Y-%m-%d", "%B %d %Y", "%b %d %Y", "%d %B %Y", "%d %b %Y", "%m/%d/%Y", "%B %d", "%b %d", "%m/%d")
_SHORT = re.compile(r"now([+-])(\d+)([dhm])\Z")
_SPAN = re.compile(r"(?:(\d+)|an?)\s+([a-z]+?)s?\s+(?:ago|before|back)\Z")
_CLOCK = re.compile(r"(?:^|\s)(?:(\d{1,2})(?::(\d{2}))?\s*(am|pm)|(\d{1,2}):(\d{2})(?::(\d{2}))?|(noon|midnight))\Z")


def micros(t: datetime) -> int:
    delta = t.astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)
    return (delta.days * 86400 + delta.seconds) * SECOND + delta.microseconds


def _at(us: int, zone: timezone) -> datetime:
    return (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=us)).astimezone(zone)


def iso(text: str) -> int | None:
    """An ISO date or date and time; midnight and UTC where they aren't given."""
    if not re.match(r"\d{4}-\d\d-\d\d", text):
        return None
    try:
        t = datetime.fromisoformat(text.upper().replace("Z", "+00:00"))
    except ValueError:
        return None
    return micros(t if t.tzinfo else t.replace(tzinfo=UTC))


def _years(t: datetime, n: int) -> datetime:
    try:
        return t.replace(year=t.year + n)
    except ValueError:  # 29 February
        return t.replace(year=t.year + n, month=3, day=1)


def parse(text: str, now: int) -> int:
    """Microseconds of what ``text`` means at ``now``; ValueError if it means nothing."""
    s = text.strip()
    if re.fullmatch(r"\d+(\.\d+)?([eE][+-]?\d+)?", s):
        return int(float(s))
    if (got := iso(s)) is not None:
        return got
    s = s.lower()
    if m := _SHORT.match(s):
        step = int(m[2]) * {"d": 86400, "h": 3600, "m": 60}[m[3]] * SECOND
        return now + step if m[1] == "+" else now - step
    s = " ".join(w for w in s.replace(",", " ").split() if w not in ("at", "the", "on"))
    zone = UTC
    if (parts := s.rsplit(" ", 1)) and parts[-1] in _ZONES and len(parts) == 2:
        s, zone = parts[0], timezone(timedelta(hours=_ZONES[parts[1]]))
    clock = None
    if (m := _CLOCK.search(s)) and not _SPAN.match(s):
        if m[7]:
            clock = (12, 0, 0) if m[7] == "noon" else (0, 0, 0)
        elif m[3]:
            if not 1 <= int(m[1]) <= 12:
                raise ValueError(f"no such hour: {text!r}")
            clock = (int(m[1]) % 12 + (12 if m[3] == "pm" else 0), int(m[2] or 0), 0)
        else:
            clock = (int(m[4]), int(m[5]), int(m[6] or 0))
        if clock[0] > 23 or clock[1] > 59 or clock[2] > 59:
            raise ValueError(f"no such time of day: {text!r}")
        s = s[: m.start()].strip()
    here = _at(now, zone)
    keeps_clock = False
    if s in ("", "now", "today"):
        day, keeps_clock = here, True
    elif s in ("yesterday", "tomorrow"):
        day = here + timedelta(days=1 if s == "tomorrow" else -1)
    elif s == "last week":
        day = here - timedelta(days=7)
    elif s == "last month":
        y, mo = (here.year, here.month - 1) if here.month > 1 else (here.year - 1, 12)
        day = datetime(y, mo, 1, tzinfo=zone) + timedelta(days=here.day - 1)
    elif s == "last year":
        day = _years(here, -1)
    elif m := _SPAN.match(s):
        unit = m[2] if m[2] in _UNITS else m[2] + "s"
        if unit not in _UNITS:
            raise ValueError(f"no unit of time: {m[2]!r}")
        day, keeps_clock = _at(now - int(m[1] or 1) * _UNITS[unit], zone), True
    else:
        day = None
        for form in _DATES:
            try:
                # A missing year is this one; a leap year lets 29 February through the parser.
                day = datetime.strptime(s if "%Y" in form else f"{s} {here.year}", form if "%Y" in form else f"{form} %Y")
                break
            except ValueError:
                continue
        if day is None:
            raise ValueError(f"can't read the moment {text!r}")
        day = day.replace(tzinfo=zone)
    if clock:
        day = day.replace(hour=clock[0], minute=clock[1], second=clock[2], microsecond=0)
    elif not keeps_clock:
        day = day.replace(hour=0, minute=0, second=0, microsecond=0)
    return micros(day)
