"""Durations in words and cron schedules.

Both are parsed on the driver: they come from the configuration, a few lines.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta

# Seconds of each unit.
UNITS = {"s": 1, "sec": 1, "second": 1, "m": 60, "min": 60, "minute": 60, "h": 3600, "hour": 3600, "hr": 3600, "d": 86_400, "day": 86_400, "w": 604_800, "week": 604_800, "month": 2_630_016, "y": 31_557_600, "year": 31_557_600}
_ITEM = re.compile(r"(\d+)\s*([a-zA-Z]+)")


def seconds(text: str) -> int:
    """``12h``, ``7d``, ``1d 6h`` in seconds."""
    total, at = 0, 0
    text = text.strip()
    for m in _ITEM.finditer(text):
        unit = m[2] if m[2] == "M" else m[2].lower()
        size = 2_630_016 if unit == "M" else UNITS.get(unit, UNITS.get(unit.rstrip("s")))
        if size is None or text[at : m.start()].strip():
            raise ValueError(f"not a duration: {text!r}")
        total, at = total + int(m[1]) * size, m.end()
    if not at or text[at:].strip():
        raise ValueError(f"not a duration: {text!r}")
    return total


class Cron:
    """A schedule of five fields in UTC."""

    NAMES = {n: i for i, n in enumerate("sun mon tue wed thu fri sat".split())}
    MONTHS = {n: i for i, n in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}

    def __init__(self, text: str):
        fields = text.split()
        if len(fields) != 5:
            raise ValueError(f"a schedule has five fields: {text!r}")
        self.minutes = self._field(fields[0], 0, 59)
        self.hours = self._field(fields[1], 0, 23)
        self.days = self._field(fields[2], 1, 31)
        self.months = self._field(fields[3], 1, 12, self.MONTHS)
        self.weekdays = {d % 7 for d in self._field(fields[4], 0, 7, self.NAMES)}
        self.any_day, self.any_weekday = fields[2] == "*", fields[4] == "*"

    @staticmethod
    def _field(text: str, low: int, high: int, names: dict[str, int] | None = None) -> set[int]:
        number = lambda x: names[x.lower()] if names and x.lower() in names else int(x)
        out: set[int] = set()
        for part in text.split(","):
            span, _, step = part.partition("/")
            if span == "*":
                first, last = low, high
            else:
                a, _, b = span.partition("-")
                first = number(a)
                last = number(b) if b else high if step else first
            if not low <= first <= last <= high or (step and int(step) < 1):
                raise ValueError(f"not a schedule field: {text!r}")
            out.update(range(first, last + 1, int(step or 1)))
        return out

    def on(self, day: datetime) -> bool:
        if day.month not in self.months:
            return False
        by_date, by_weekday = day.day in self.days, (day.weekday() + 1) % 7 in self.weekdays
        if self.any_day or self.any_weekday:
            return by_date and by_weekday
        return by_date or by_weekday

    def previous(self, now: datetime) -> datetime | None:
        """The latest slot not after ``now``; a slot at its own minute counts."""
        day = now.replace(hour=0, minute=0, second=0, microsecond=0)
        for back in range(366 * 5):
            date = day - timedelta(days=back)
            if not self.on(date):
                continue
            for hour in sorted(self.hours, reverse=True):
                for minute in sorted(self.minutes, reverse=True):
                    slot = date.replace(hour=hour, minute=minute)
                    if slot <= now:
                        return slot
        return None

    def slots(self, start: datetime, end: datetime) -> list[datetime]:
        """All slots in [start, end]."""
        day, out = start.replace(hour=0, minute=0, second=0, microsecond=0), []
        while day <= end:
            if self.on(day):
                out += [s for h in sorted(self.hours) for m in sorted(self.minutes) if start <= (s := day.replace(hour=h, minute=m)) <= end]
            day += timedelta(days=1)
        return out
