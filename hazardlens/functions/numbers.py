"""Lenient number and boolean reading, safe ratios, labelled ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INTEGER_HEAD = r"^\s*([+-]?\d+)"
_DECIMAL_HEAD = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def lenient_integer(text: Column) -> Column:
    """Leading digits as a number, NULL when there are none."""
    return F.regexp_extract(text, _INTEGER_HEAD, 1).try_cast("bigint")


def lenient_decimal(text: Column) -> Column:
    """Leading decimal number, NULL when there is none."""
    return F.regexp_extract(text, _DECIMAL_HEAD, 1).try_cast("double")


def number_or_zero(value: Column) -> Column:
    """Strict number, zero for anything that is not one."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def truth(value: Column) -> Column:
    """True only for a true value or the word 'true' in any case."""
    return F.coalesce(F.lower(value.cast("string")) == "true", F.lit(False))


def flag(condition: Column) -> Column:
    """0/1 with NULL read as 0."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def positive(value: Column) -> Column:
    """The value when above zero, else NULL, so that aggregates skip it."""
    return F.when(value > 0, value)


def percent(part: Column, whole: Column, digits: int | None = 2) -> Column:
    ratio = F.lit(100.0) * part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    return ratio if digits is None else F.round(ratio, digits)


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def range_ordinal(value: Column, buckets: list[tuple[str, int | None]]) -> Column:
    """1-based bucket number; NULL and zero fall in the first bucket, what no bound takes in the last."""
    choice = F.when(value.isNull() | (value == 0), F.lit(1))
    for ordinal, (_, highest) in enumerate(buckets[1:-1], start=2):
        choice = choice.when((value > 0) & (value <= highest), F.lit(ordinal))
    return choice.otherwise(F.lit(len(buckets)))


def bin_ordinal(value: Column, bins: list[tuple[str, int | None]]) -> Column:
    """1-based bin number of right-closed bins; NULL stays outside."""
    choice = F.when(value.isNull(), F.lit(None))
    for ordinal, (_, highest) in enumerate(bins[:-1], start=1):
        choice = choice.when(value <= highest, F.lit(ordinal))
    return choice.otherwise(F.lit(len(bins))).cast("int")


def label_at(ordinal: Column, labels: list[str]) -> Column:
    """The label of a 1-based ordinal; NULL needs its own branch because element_at takes it for -1."""
    return F.when(ordinal.isNotNull(), F.element_at(F.array(*[F.lit(label) for label in labels]), ordinal))


def labels_of(buckets: list[tuple[str, object]]) -> list[str]:
    return [label for label, _ in buckets]
