"""Dates. Tables hold zone-less UTC timestamps; ISO text appears only at the edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def utc(literal: str) -> Column:
    return F.lit(literal).cast("timestamp_ntz")


def read_iso(text: Column) -> Column:
    """UTC time of an ISO text, NULL when it cannot be read (needs the session zone to be UTC)."""
    return text.try_cast("timestamp").cast("timestamp_ntz")


def write_iso(moment: Column) -> Column:
    return F.date_format(moment, _ISO)


def days_since(moment: Column, as_of: Column) -> Column:
    """Whole elapsed 24-hour units, NULL when unknown or in the future."""
    return F.when(moment <= as_of, F.extract(F.lit("DAY"), as_of - moment).cast("bigint"))
