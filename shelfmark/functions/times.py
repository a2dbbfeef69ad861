"""Time-zone explicit projections. Nothing reads the machine's clock or zone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_time(ts: Column, tz: str) -> Column:
    """Wall-clock time in ``tz`` of a UTC instant held without a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts.cast("timestamp_ntz"))


def local_day(ts: Column, tz: str) -> Column:
    return local_time(ts, tz).cast("date")


def as_ntz(moment: dt.datetime | str) -> Column:
    """Literal of an as-of moment (UTC wall clock)."""
    text = moment if isinstance(moment, str) else moment.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast("timestamp_ntz")


def export_timestamp(text: Column) -> Column:
    """``dd.MM.yyyy HH:mm:ss UTC+hh:mm`` to a UTC wall clock; UTC when no offset is given."""
    trimmed = F.trim(text)
    offset = F.regexp_extract(trimmed, r"UTC([+-]\d{2}:\d{2})$", 1)
    naive = F.try_to_timestamp(
        F.regexp_extract(trimmed, r"^(\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}:\d{2})", 1),
        F.lit("dd.MM.yyyy HH:mm:ss"),
    ).cast("timestamp_ntz")
    minutes = F.when(
        offset != "",
        F.concat(F.substring(offset, 1, 1), F.lit("1")).cast("int")
        * (F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, 5, 2).cast("int")),
    ).otherwise(F.lit(0))
    return naive - F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0))


def year_prefix(text: Column) -> Column:
    """Year of a date string of which only the first four digits are trusted."""
    head = F.substring(text, 1, 4)
    return F.when(head.rlike("^[12][0-9]{3}$"), head.cast("int"))


def effective_year(year: Column, release_date: Column) -> Column:
    return F.coalesce(year, year_prefix(release_date))
