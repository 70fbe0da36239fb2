"""Period selections of a dashboard, and how its figures are written."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, functions as F

#: What a period may be called, and its days.
PRESETS = {"24h": 1, "7d": 7, "30d": 30, "90d": 90}


@dataclass(frozen=True)
class Period:
    """First and last day, those of the equally long period before, and whether today is inside (figures may still move)."""

    name: str
    first: date
    last: date
    previous_first: date
    previous_last: date
    provisional: bool

    @property
    def days(self) -> int:
        return (self.last - self.first).days + 1


def _day(text: str | None) -> date | None:
    try:
        return date.fromisoformat(text) if text and re.fullmatch(r"\d{4}-\d{2}-\d{2}", text) else None
    except ValueError:
        return None


def resolve(name: str | None, today: date, first: str | None = None, last: str | None = None) -> Period:
    """A preset ends today; `custom` takes both days, in order; all else is 7d."""
    a, b = _day(first), _day(last)
    if name == "custom" and a and b and a <= b:
        begin, end = a, b
    else:
        name = name if name in PRESETS else "7d"
        begin, end = today - timedelta(days=PRESETS[name] - 1), today
    before = begin - timedelta(days=1)
    return Period(name, begin, end, before - (end - begin), before, begin <= today <= end)


def _known(x: Column, text: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")), "N/A").otherwise(text)


def count(x: Column) -> Column:
    """1,234 (half up)."""
    return _known(x, F.format_number(F.floor(x.cast("double") + 0.5), 0))


def compact(x: Column) -> Column:
    """45.2K, 8.4M, 999; halves go up."""
    v = x.cast("double")
    one = lambda y: F.format_string("%.1f", F.floor(y * 10 + 0.5) / 10)
    return _known(x, F.when(F.abs(v) >= 1_000_000, F.concat(one(v / 1_000_000), F.lit("M"))).when(F.abs(v) >= 1_000, F.concat(one(v / 1_000), F.lit("K"))).otherwise(F.floor(v + 0.5).cast("string")))


def money(x: Column) -> Column:
    """$1,234.50"""
    return _known(x, F.concat(F.lit("$"), F.format_number(x.cast("double"), 2)))


def percent(x: Column, places: int = 1) -> Column:
    return _known(x, F.concat(F.format_string(f"%.{places}f", x.cast("double") * 100), F.lit("%")))


def duration(ms: Column) -> Column:
    """12m 24s under an hour, else 2h 15m; negative ones are unknown."""
    s = F.floor(ms.cast("double") / 1000 + 0.5).cast("long")
    h, m = F.floor(s / 3600).cast("string"), F.floor(s % 3600 / 60).cast("string")
    text = F.when(s >= 3600, F.concat(h, F.lit("h "), m, F.lit("m"))).otherwise(F.concat(m, F.lit("m "), (s % 60).cast("string"), F.lit("s")))
    return _known(ms, F.when(ms >= 0, text).otherwise("N/A"))
