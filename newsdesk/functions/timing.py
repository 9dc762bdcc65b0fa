"""Time functions.  Everything that depends on now takes ``as_of``; Japan has one offset, nine hours, all year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hours(n: int) -> Column:
    return F.make_interval(hours=F.lit(n))


def edition_key(ts: Column) -> Column:
    """The delivery date of the edition that covers ``ts``: [day before 06:00, day 06:00) in Japan."""
    return F.date_format(ts + hours(27), "yyyy-MM-dd")


def edition_start(key: Column) -> Column:
    return F.to_timestamp(key) - hours(27)


def local_day(ts: Column) -> Column:
    return F.date_format(ts + hours(9), "yyyy-MM-dd")


def recency(*columns: Column) -> Column:
    return F.coalesce(*columns)


def clamped(published: Column, reference: Column) -> Column:
    """``published``, but not after ``reference``; nulls of either leave it as it is."""
    return F.when(reference.isNotNull() & (published > reference), reference).otherwise(published)


def in_window(published: Column, ingested: Column, start: Column, stop: Column) -> Column:
    """Published within [start, stop), or without a date and ingested within it."""
    return F.coalesce(((published >= start) & (published < stop)) | (published.isNull() & (ingested >= start) & (ingested < stop)), F.lit(False))


def strict_instant(text: Column) -> Column:
    """An ISO 8601 date-time with seconds and zone, or null; dates that don't exist are null too."""
    good = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,3})?(Z|[+-]\d{2}:\d{2})$")
    return F.when(good, F.try_to_timestamp(F.regexp_replace(text, r"Z$", "+00:00")))


def strict_date(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
