"""Time-zone functions over unix seconds. The session time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    """Unix seconds of a timestamp with or without time zone."""
    return F.unix_seconds(ts.cast("timestamp"))


def local(unix: Column, tz) -> Column:
    return F.from_utc_timestamp(F.timestamp_seconds(unix), tz)


def local_date(unix: Column, tz) -> Column:
    """YYYY-MM-DD in the zone."""
    return F.date_format(local(unix, tz), "yyyy-MM-dd")


def local_midnight(unix: Column, tz) -> Column:
    """Unix seconds of the local day's start; the first instant of a day that has no midnight."""
    return F.unix_seconds(F.to_utc_timestamp(F.date_trunc("day", local(unix, tz)), tz))


def next_tick(unix: Column, hours: int = 4) -> Column:
    """The next boundary of ``hours`` hours, strictly later."""
    return ((F.floor(unix / (hours * 3600)) + 1) * (hours * 3600)).cast("long")


def valid_zone(tz: Column, zones: list[str]) -> Column:
    """Whether a zone is among the known ones; an unknown zone makes Spark raise, so filter by this first."""
    return F.coalesce(tz.isin(zones), F.lit(False))


def countdown(left: Column) -> Column:
    """0m, whole minutes rounded up, or hours and minutes."""
    m = F.ceil(F.greatest(left, F.lit(0)) / 60).cast("long")
    return F.when(m < 60, F.concat(m.cast("string"), F.lit("m"))).otherwise(F.concat(F.floor(m / 60).cast("string"), F.lit("h "), (m % 60).cast("string"), F.lit("m")))


def month_day(unix: Column) -> Column:
    return F.upper(F.date_format(F.timestamp_seconds(unix), "MMM d"))


def locale(tz: Column) -> Column:
    """The locale that a zone's users read dates in."""
    return F.when(F.startswith(tz, F.lit("America/")), "en-US").otherwise("en-GB")
