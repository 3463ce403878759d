"""Time expressions on zone-free local timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_S = 86_400


def epoch_us(c: Column, ntz: bool = True) -> Column:
    """Microseconds since 1970-01-01 00:00:00 as a bigint.

    For ``timestamp_ntz`` (``ntz``) the wall-clock reading counts and no zone
    is applied, whatever the session's zone; for ``timestamp`` it is the UTC
    instant.
    """
    if not ntz:
        return F.unix_micros(c)
    day = F.unix_date(F.to_date(c)).cast("bigint") * DAY_S
    clock = F.hour(c) * 3_600 + F.minute(c) * 60
    second = F.extract(F.lit("SECOND"), c) * 1_000_000
    return (day + clock) * 1_000_000 + second.cast("bigint")


def epoch_s(c: Column, ntz: bool = True) -> Column:
    """Whole seconds since 1970-01-01 00:00:00."""
    return F.floor(epoch_us(c, ntz) / 1_000_000)


def human_period(c: Column, new_day: int = 4) -> Column:
    """0 to 20: weekday (Monday 0) times 3 plus the 8-hour shift, days beginning at ``new_day`` o'clock."""
    day = F.weekday(c)
    before = F.hour(c) < new_day
    day = F.when(before, F.pmod(day + 6, F.lit(7))).otherwise(day)
    return (day * 3 + F.floor(F.pmod(F.hour(c) - new_day, F.lit(24)) / 8)).cast("int")


def hour_chunk(c: Column, chunk: int, offset: int = 0) -> Column:
    """Number of the ``chunk``-hour slice of the day, the first beginning at hour ``offset``; cyclic."""
    if 24 % chunk:
        raise ValueError("the chunk must divide 24")
    return F.floor(F.pmod(F.hour(c) - offset, F.lit(24)) / chunk).cast("int")


def weekend(c: Column) -> Column:
    """Friday from 20:00 to Sunday before 21:00."""
    day, hour = F.weekday(c), F.hour(c)
    return ((day == 4) & (hour >= 20)) | (day == 5) | ((day == 6) & (hour <= 20))


def time_cell(c: Column, days: int = 14, origin: str = "2008-01-01") -> Column:
    """Number of the ``days``-long cell since ``origin``, the first being 1."""
    return (F.floor((epoch_s(c) - F.unix_date(F.to_date(F.lit(origin))).cast("bigint") * DAY_S) / (days * DAY_S)) + 1).cast("bigint")


def in_season(c: Column, season: str, first_year: int, last_year: int) -> Column:
    """Inside the season of one of the years: from the 15th of its first month for three months (end excluded)."""
    month = {"winter": 12, "spring": 3, "summer": 6, "fall": 9}[season]
    out = F.lit(False)
    for year in range(first_year, last_year + 1):
        end = (year + 1, month - 9) if month > 9 else (year, month + 3)
        start = F.to_timestamp_ntz(F.lit(f"{year:04d}-{month:02d}-15 00:00:00"))
        out = out | ((c >= start) & (c < F.to_timestamp_ntz(F.lit(f"{end[0]:04d}-{end[1]:02d}-15 00:00:00"))))
    return out


def period_slice(c: Column, start: str, days: float) -> Column:
    """Number of the half-open slice of ``days`` days since ``start``; null before it."""
    s = epoch_s(c) - F.unix_date(F.to_date(F.lit(start))).cast("bigint") * DAY_S
    return F.when(s >= 0, F.floor(s / (days * DAY_S)))


def to_city_time(utc: Column, zone: Column) -> Column:
    """The city's wall-clock reading of a UTC reading (both zone-free)."""
    return F.convert_timezone(F.lit("UTC"), zone, utc)


def to_utc(local: Column, zone: Column) -> Column:
    """The UTC reading of a city's wall-clock reading (both zone-free)."""
    return F.convert_timezone(zone, F.lit("UTC"), local)


# Names of the weekdays and of the 8-hour shifts.
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
SHIFTS = ["morning", "afternoon", "evening"]


def bin_labels(kind: str, chunk: int = 3, offset: int = 0) -> list[str]:
    """Labels of the bins of ``kind``: ``day`` (slices of ``chunk`` hours from ``offset``), ``week`` (weekdays) or ``mix`` (weekday and shift)."""
    if kind == "day":
        if 24 % chunk:
            raise ValueError("the chunk must divide 24")
        return [f"{h % 24}:00--{(h + chunk) % 24}:00" for h in range(offset, 24 + offset, chunk)]
    if kind == "week":
        return list(DAYS)
    if kind == "mix":
        return [f"{day} {shift}" for day in DAYS for shift in SHIFTS]
    raise ValueError(f"unknown kind {kind}")
