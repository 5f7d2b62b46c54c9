"""Dates, times and schedules."""

from __future__ import annotations

from datetime import datetime, timedelta
from email.utils import parsedate_to_datetime
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STRICT_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6}0*)?(Z|[+-]\d{2}:?\d{2})$"


def parse_ts(text: Column) -> Column:
    return F.try_to_timestamp(text)


def format_ts(at: Column) -> Column:
    """RFC 3339 in UTC (session zone UTC), microseconds if there are any."""
    whole, part = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(at, ".SSSSSS")
    return F.concat(whole, F.when(part == ".000000", F.lit("")).otherwise(part), F.lit("Z"))


def parse_timestamp_strict(text: Column) -> Column:
    """Needs an offset and at most six significant digits of the second's fraction."""
    return F.when(text.rlike(STRICT_TIMESTAMP), F.try_to_timestamp(F.regexp_replace(text, r"(\.\d{6})0+", "$1")))


def parse_date_strict(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def parse_clock(text: Column) -> Column:
    """HH:MM or HH:MM:SS as text; null for others."""
    return F.when(text.rlike(r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d)?$"), text)


def parse_datetime_lenient(text: Column) -> Column:
    """Partial dates, RFC 3339, RFC 822 and Unix seconds; without an offset UTC is meant."""

    @F.pandas_udf("timestamp")
    def run(values: pd.Series) -> pd.Series:
        def one(value):
            raw = (value or "").strip()
            if not raw:
                return None
            try:
                if raw.replace(".", "", 1).isdigit() and len(raw) > 8:
                    return pd.Timestamp(float(raw), unit="s", tz="UTC")
                if raw.isdigit() and len(raw) == 4:
                    return pd.Timestamp(int(raw), 1, 1, tz="UTC")
                if raw[:1].isalpha() or raw[:2].strip().isdigit() and " " in raw[:3]:
                    got = pd.Timestamp(parsedate_to_datetime(raw))
                else:
                    got = pd.Timestamp(raw if len(raw) != 7 else raw + "-01")
                return got.tz_localize("UTC") if got.tzinfo is None else got.tz_convert("UTC")
            except (ValueError, TypeError, OverflowError):
                return None

        return pd.to_datetime(pd.Series([one(v) for v in values], dtype="object"), utc=True).dt.tz_localize(None)

    return run(text)


def local_date(at: Column, zone: str = "Europe/Kyiv") -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def clamp_event_date(event: Column, published: Column, lag_days: int) -> Column:
    """The event's date if it lies within ``lag_days`` before publication, else null."""
    return F.when(F.datediff(published, event).between(0, lag_days), event)


def date_in_quote(day: Column, quote: Column) -> Column:
    """Whether a quote names the day as ISO date, dd.mm.yyyy or day and month."""
    forms = [F.date_format(day, f) for f in ("yyyy-MM-dd", "dd.MM.yyyy", "d MMMM", "MMMM d")]
    found = F.lit(False)
    for form in forms:
        found = found | F.contains(F.lower(quote), F.lower(form))
    return F.coalesce(found, F.lit(False))


_NAMES = [{}, {}, {}, {n: i for i, n in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}, {n: i for i, n in enumerate("sun mon tue wed thu fri sat".split())}]
_RANGES = [(0, 59), (0, 23), (1, 31), (1, 12), (0, 7)]


def cron_fields(expression: str) -> list[frozenset[int]]:
    """The values of the five fields; names of months and days, ranges, lists and steps."""
    parts = expression.split()
    if len(parts) != 5:
        raise ValueError(f"a schedule has five fields: {expression!r}")
    out = []
    for part, (low, high), names in zip(parts, _RANGES, _NAMES):
        values: set[int] = set()
        number = lambda t: names[t.lower()] if t.lower() in names else int(t)  # noqa: E731, B023
        for piece in part.split(","):
            span, _, step = piece.partition("/")
            if span == "*":
                first, last = low, high
            else:
                a, dash, b = span.partition("-")
                first, last = number(a), number(b) if dash else (high if step else number(a))
            if not low <= first <= last <= high or step and int(step) < 1:
                raise ValueError(f"out of range: {piece!r}")
            values.update(range(first, last + 1, int(step or 1)))
        out.append(frozenset(values))
    out[4] = frozenset(v % 7 for v in out[4])
    return out


def next_fire(expression: str, after: datetime, zone: str = "UTC") -> datetime | None:
    """First moment after ``after`` that the schedule names; day of month and day of week are alternatives if both are set."""
    minutes, hours, days, months, weekdays = cron_fields(expression)
    both = expression.split()[2] != "*" and expression.split()[4] != "*"
    local = after.astimezone(ZoneInfo(zone))
    for ahead in range(366 * 5):
        day = (local + timedelta(days=ahead)).date()
        weekday = (day.weekday() + 1) % 7
        fits = (day.day in days or weekday in weekdays) if both else (day.day in days and weekday in weekdays)
        if day.month not in months or not fits:
            continue
        for hour in sorted(hours):
            for minute in sorted(minutes):
                at = datetime(day.year, day.month, day.day, hour, minute, tzinfo=ZoneInfo(zone))
                if at.astimezone(ZoneInfo("UTC")).astimezone(ZoneInfo(zone)).hour == hour and at > local:
                    return at.astimezone(after.tzinfo)
    return None


def next_fires(expression: str, after: Column, zone: str = "UTC") -> Column:
    """:func:`next_fire` of every moment of a column (session zone UTC)."""

    @F.pandas_udf("timestamp")
    def run(values: pd.Series) -> pd.Series:
        found = [None if pd.isna(v) else next_fire(expression, v.to_pydatetime().replace(tzinfo=ZoneInfo("UTC")), zone) for v in values]
        return pd.to_datetime(pd.Series(found, dtype="object"), utc=True).dt.tz_localize(None)

    return run(after)
