"""Name and text clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space at the edges of a cell.
_WHITE_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff")


def strip(text: Column) -> Column:
    """Trim white space of any kind, not only blanks, without a regular expression per row."""
    return F.btrim(text, F.lit(_WHITE_SPACE))


def normalize_name(name: Column) -> Column:
    """Lower-case, stripped; NULL becomes the empty text."""
    return strip(F.lower(F.coalesce(name, F.lit(""))))


def null_if_blank(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def or_default(text: Column, default: str) -> Column:
    """The default for NULL and for the empty text."""
    return F.coalesce(null_if_blank(text), F.lit(default))


def before_dash(line: Column) -> Column:
    """The part ahead of the first ``' - '``, stripped, lower-case."""
    return F.lower(strip(F.substring_index(line, " - ", 1)))


def not_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def has_text(text: Column) -> Column:
    """True when something other than white space is there."""
    return strip(F.coalesce(text, F.lit(""))) != ""


def equals_word(text: Column, word: str) -> Column:
    return normalize_name(text) == word


def joined(values: Column, separator: str = ";") -> Column:
    return F.array_join(values, separator)


def share_bar(percent: Column) -> Column:
    """A text bar, one mark per two percent."""
    return F.repeat(F.lit("█"), F.floor(percent / 2).cast("int"))
