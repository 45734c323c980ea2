"""Text cleaning, search predicates and display labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def given(value: object) -> bool:
    """Whether a filter argument asks for anything: None, '' and '0' do not."""
    return value is not None and str(value) not in ("", "0")


def contains_like(pattern: str, *columns: str) -> Column:
    """``%pattern%`` in any of the columns, ignoring case.

    ``%`` and ``_`` inside the pattern keep their wildcard meaning.
    """
    needle = F.lit(f"%{pattern.lower()}%")
    return reduce(lambda left, right: left | right,
                  [F.like(F.lower(F.col(name)), needle) for name in columns])


def collated(column: Column, collation: str | None) -> Column:
    """The column under a collation, or as it is (binary) when none is asked for."""
    return F.collate(column, collation) if collation else column


def full_name() -> Column:
    return F.concat(F.col("first_name"), F.lit(" "), F.col("last_name"))


def cleaned(column: str, default: str) -> Column:
    """Trimmed text; only NULL takes the default, a blank stays blank."""
    return F.coalesce(F.trim(F.col(column)), F.lit(default))


def action_label(column: Column) -> Column:
    return F.translate(column, "_", " ")


def initial(column: Column) -> Column:
    return F.upper(F.substring(column, 1, 1))


def amount_text(column: Column) -> Column:
    """Amount with thousands separators, for labels only."""
    return F.format_number(column, 2)


# Fixed value: the accepted shape of an e-mail address.
EMAIL_SHAPE = r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*@([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?$"


def is_email(column: Column) -> Column:
    return column.rlike(EMAIL_SHAPE) & (F.length(F.substring_index(column, "@", 1)) <= 64)


# Fixed value: the characters that count as white space around typed input.
INPUT_SPACE = " \t\n\r\0\x0b"


def typed(column: Column) -> Column:
    """Typed input without the white space around it: also tabs, line ends, NUL and vertical tabs."""
    return F.btrim(column, F.lit(INPUT_SPACE))


def decimal_or_zero(column: Column) -> Column:
    """The number that typed text begins with, as an amount; zero if there is none or it does not fit."""
    number = F.regexp_extract(typed(column), r"^([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    return F.coalesce(number.try_cast("decimal(12,2)"), F.lit(0).cast("decimal(12,2)"))
