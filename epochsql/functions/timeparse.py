"""Points in time as microseconds since the epoch, always read in UTC."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

LATEST = "LATEST"
_DMY = re.compile(r"(\d{1,2})/(\d{1,2})/(\d{4})(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?)?$")
_AGO = re.compile(r"(\d+)\s*(second|minute|hour|day)s?\s+ago$", re.I)


def _micros(t: datetime) -> int:
    return int((t.replace(tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))


def parse_moment(x: str | int, now: int | None = None) -> int:
    """DD/MM/YYYY [HH:MM[:SS]], ISO dates and times, 'N seconds|minutes|hours|days ago', or microseconds."""
    if isinstance(x, int):
        return x
    s = x.strip()
    now = _micros(datetime.now(UTC).replace(tzinfo=None)) if now is None else now
    if s.upper() in (LATEST, "NOW", "CURRENT"):
        return now
    if m := _DMY.match(s):
        d, mo, y, h, mi, sec = (int(v or 0) for v in m.groups())
        return _micros(datetime(y, mo, d, h, mi, sec))
    if m := _AGO.match(s):
        return now - int(m[1]) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[m[2].lower()] * 1_000_000
    if s.isdigit():
        return int(s)
    try:
        t = datetime.fromisoformat(s)
    except ValueError as e:
        raise ValueError(f"no point in time: {x!r}") from e
    return _micros(t.astimezone(UTC).replace(tzinfo=None) if t.tzinfo else t)


def format_micros(us: int) -> str:
    return (datetime(1970, 1, 1) + timedelta(microseconds=us)).strftime("%Y-%m-%d %H:%M:%S")
