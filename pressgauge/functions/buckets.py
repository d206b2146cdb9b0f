"""Bucket labels, collection cycles and instants, all cut from ISO-8601 text."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("hour", "day", "week")
#: Window lengths in hours.
RANGES = {"24h": 24, "7d": 7 * 24, "30d": 30 * 24}
UNIT_HOURS = {"hour": 1, "day": 24, "week": 7 * 24}

CYCLE_PATTERN = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):00$"
INSTANT_PATTERN = (
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"
)


def week_label(day: Column) -> Column:
    """ISO week label; the year is the week's own, not always the calendar year."""
    year = F.extract(F.lit("YEAROFWEEK"), day).cast("string")
    week = F.lpad(F.weekofyear(day).cast("string"), 2, "0")
    return F.concat(F.lpad(year, 4, "0"), F.lit("-W"), week)


def bucket_label(ts: Column, unit: str) -> Column:
    if unit == "hour":
        return F.substring(ts, 1, 13)
    if unit == "day":
        return F.substring(ts, 1, 10)
    if unit == "week":
        return week_label(F.substring(ts, 1, 10).cast("date"))
    raise ValueError(f"unknown bucket unit {unit!r}; choose one of {UNITS}")


def bucket_labels(ts: Column, units: tuple[str, ...] = UNITS) -> Column:
    """Array of (bucket_unit, time_bucket), to be exploded."""
    return F.array(
        *[
            F.struct(F.lit(u).alias("bucket_unit"), bucket_label(ts, u).alias("time_bucket"))
            for u in units
        ]
    )


def bucket_start(label: Column, unit: str) -> Column:
    """The instant a bucket opens, null for a label that names none."""
    if unit == "hour":
        ok = label.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}$")
        return F.when(ok, F.try_to_timestamp(F.concat(label, F.lit(":00:00"))))
    if unit == "day":
        ok = label.rlike(r"^\d{4}-\d{2}-\d{2}$")
        return F.when(ok, F.try_to_timestamp(label))
    if unit == "week":
        year = F.regexp_extract(label, r"^(\d+)-W(\d+)$", 1)
        week = F.regexp_extract(label, r"^(\d+)-W(\d+)$", 2).try_cast("int")
        jan4 = F.concat(F.lpad(year, 4, "0"), F.lit("-01-04")).try_cast("date")
        monday = F.date_trunc("week", jan4).cast("date")
        return F.when(
            week.between(1, 53), F.date_add(monday, (week - 1) * 7).cast("timestamp")
        )
    raise ValueError(f"unknown bucket unit {unit!r}; choose one of {UNITS}")


def bucket_start_any(label: Column, unit: Column) -> Column:
    out = F.when(unit == UNITS[0], bucket_start(label, UNITS[0]))
    for u in UNITS[1:]:
        out = out.when(unit == u, bucket_start(label, u))
    return out


def unit_rank(unit: Column) -> Column:
    """0 is the finest unit. Units are ranked; their labels never compare with each other."""
    out = F.when(unit == UNITS[0], 0)
    for rank, u in enumerate(UNITS[1:], start=1):
        out = out.when(unit == u, rank)
    return out.otherwise(len(UNITS))


def unit_of_rank(rank: Column) -> Column:
    out = F.when(rank == 0, F.lit(UNITS[0]))
    for n, u in enumerate(UNITS[1:], start=1):
        out = out.when(rank == n, F.lit(u))
    return out.otherwise(F.lit(""))


def hours_between(later: Column, earlier: Column) -> Column:
    return F.floor((F.unix_seconds(later) - F.unix_seconds(earlier)) / 3600)


def hour_label(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH")


def window_bounds(end: Column, span: Column, period: Column) -> tuple[Column, Column]:
    """First and last hour label of a window of ``span`` hours, or of the one before it."""
    back = F.when(period == "current", F.lit(0)).otherwise(span)
    base = F.unix_seconds(end)
    last = F.timestamp_seconds(base - back * 3600)
    first = F.timestamp_seconds(base - (back + span - 1) * 3600)
    return hour_label(first), hour_label(last)


def valid_cycle(cycle: Column) -> Column:
    """A cycle names its partition, so only the exact ``YYYY-MM-DDTHH:00`` spelling counts."""
    return cycle.rlike(CYCLE_PATTERN) & F.substring(cycle, 1, 10).try_cast("date").isNotNull()


def cycle_parts(cycle: Column) -> dict[str, Column]:
    ok = F.when(valid_cycle(cycle), cycle)
    return {
        "year": F.substring(ok, 1, 4),
        "month": F.substring(ok, 6, 2),
        "day": F.substring(ok, 9, 2),
        "hour": F.substring(ok, 12, 2),
    }


def cycle_of_parts(year: Column, month: Column, day: Column, hour: Column) -> Column:
    label = F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit("T"), hour, F.lit(":00"))
    return F.when(valid_cycle(label), label)


def split_cycle(cycle: str) -> dict[str, str]:
    """Driver-side twin of :func:`cycle_parts` for one literal cycle."""
    at = datetime.strptime(cycle, "%Y-%m-%dT%H:00")
    if at.strftime("%Y-%m-%dT%H:00") != cycle:
        raise ValueError(f"{cycle!r} is not a YYYY-MM-DDTHH:00 cycle")
    return {"year": cycle[:4], "month": cycle[5:7], "day": cycle[8:10], "hour": cycle[11:13]}


def instant(ts: Column) -> Column:
    """Timestamp of an RFC 3339 text, null for anything else.

    The pattern comes first because the plain cast also takes words and bare dates.
    """
    return F.when(ts.rlike(INSTANT_PATTERN), F.try_to_timestamp(ts))


def at_or_after(ts: Column, since: Column) -> Column:
    """Whether ``ts`` is not before ``since``; an unreadable ``ts`` is not."""
    return F.coalesce(instant(ts) >= since, F.lit(False))
