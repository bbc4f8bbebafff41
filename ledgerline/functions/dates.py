"""Cutoff dates and ages, without a wall clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_from_iso(c: Column) -> Column:
    """Days since 1970 of YYYY-MM-DD; a day up to 31 counts on from its month's first; anything else is null."""
    fits = F.regexp_like(c, F.lit(r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$"))
    first = F.unix_date(F.make_date(F.substring(c, 1, 4).try_cast("int"), F.substring(c, 6, 2).try_cast("int"), F.lit(1)))
    return F.when(fits, first + F.substring(c, 9, 2).try_cast("int") - 1)


def iso_from_days(c: Column) -> Column:
    return F.date_format(F.date_from_unix_date(c), "yyyy-MM-dd")


def civil_date(c: Column) -> Column:
    """c where it is a date of the calendar, else null."""
    return F.when(F.regexp_like(c, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")) & F.expr("true") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), c)


def stale(days: Column, as_of: int, window: int) -> Column:
    return F.coalesce(days < as_of - window, F.lit(False))


def queue_age(queued_at: Column, as_of: int) -> Column:
    return F.greatest(F.lit(as_of) - queued_at, F.lit(0))


def usd_micros(usd: Column) -> Column:
    """Micro-dollars, and at least one for anything above nothing."""
    return F.when(usd > 0, F.greatest(F.round(usd * 1_000_000), F.lit(1.0))).otherwise(F.lit(0.0)).cast("bigint")
