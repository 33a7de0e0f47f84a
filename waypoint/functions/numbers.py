"""Small numeric and text expressions: guarded division, codes, conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, null where ``b`` is zero (ANSI mode would raise)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def trailing_number(text: str | Column) -> Column:
    """Digits at the end of ``AS_07`` → 7, null when there are none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_substr(text, F.lit(r"\d+$")).try_cast("int")


def checkpoint_label(number: Column) -> Column:
    """7 → ``AS_07``."""
    text = number.cast("string")
    return F.concat(F.lit("AS_"), F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text))


def bare_number(text: str | Column) -> Column:
    """``545*`` → 545; fails on what is not a number, since entities made null would become one."""
    text = F.col(text) if isinstance(text, str) else text
    bare = F.trim(bare_text(text))
    number = bare.try_cast("long")
    refused = F.raise_error(F.concat(F.lit("entity is not a number: "), bare)).cast("long")
    return F.when(bare.isNull() | number.isNotNull(), number).otherwise(refused)


def bare_text(text: str | Column) -> Column:
    """``A1*`` → ``A1``."""
    text = F.col(text) if isinstance(text, str) else text
    return F.replace(text.cast("string"), F.lit("*"), F.lit(""))


def gender_code(text: str | Column) -> Column:
    text = F.upper(F.col(text) if isinstance(text, str) else text)
    return F.when(text.startswith("M"), F.lit(0.0)).when(text.startswith("F"), F.lit(1.0))


def clamp(x: Column, low: Column, high: Column) -> Column:
    """Clamp with column bounds; null stays null and the lower bound wins over the upper."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, high), low))


def inverse(x: Column) -> Column:
    """Pace ratio → speed ratio, null unless positive."""
    return F.when(x > 0, F.lit(1.0) / x)


def pace_to_mph(pace: Column) -> Column:
    """Minutes per mile → miles per hour, null unless positive."""
    return F.when(pace > 0, F.lit(60.0) / pace)


def finish_block(hours: Column) -> Column:
    """Block ``h`` covers ``[h - 0.5, h + 0.5)``."""
    return F.floor(hours + 0.5).cast("long")


def rounded(x: str | Column, digits: int) -> Column:
    """Half away from zero, after dropping the noise beyond nine digits.

    Sums and interpolated quantiles of decimal readings often fall on a half; without the first step
    the last bit of the arithmetic would decide.
    """
    return F.round(F.round(as_column(x), 9), digits)


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def portable_hash(*key: str | Column) -> Column:
    """60 bits from the MD5 of the key columns as text, which other SQL engines compute alike; null counts as empty."""
    text = F.concat_ws("|", *[F.coalesce(as_column(k).cast("string"), F.lit("")) for k in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
