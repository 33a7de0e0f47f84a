"""Clock and elapsed-time expressions. All of them stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_S = 3600
DAY_S = 86400


def seconds_of_day(text: str | Column) -> Column:
    """``HH:MM`` → seconds since midnight. The parts are not range checked."""
    text = F.col(text) if isinstance(text, str) else text
    colon = F.instr(text, ":")
    rest = F.when(colon > 0, F.substr(text, colon + 1))  # no arrays of parts: this runs twice a passage
    return F.substring_index(text, ":", 1).try_cast("long") * HOUR_S + rest.try_cast("long") * 60


def minutes_of_text(text: str | Column) -> Column:
    """``HH:MM:SS`` → decimal minutes."""
    parts = F.split(F.col(text) if isinstance(text, str) else text, ":")

    def part(i: int) -> Column:
        return F.try_element_at(parts, F.lit(i)).try_cast("double")

    return part(1) * 60 + part(2) + part(3) / 60


def pad2(number: Column) -> Column:
    """At least two digits; longer text is kept whole (``lpad`` alone would cut it)."""
    text = number.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def elapsed_text(seconds: Column) -> Column:
    """Seconds → ``HH:MM:SS``; hours may exceed 24 and floor below zero."""
    seconds = seconds.cast("long")
    hours = F.floor(seconds / HOUR_S)
    rest = F.pmod(seconds, F.lit(HOUR_S))
    return F.concat(
        pad2(hours), F.lit(":"), pad2(F.floor(rest / 60)), F.lit(":"), pad2(rest % 60)
    )


def clock_label(hours: Column, start_hour: float = 5.0) -> Column:
    """Clock time of an elapsed-hours value, ``HH:MM`` with `` +1`` from the second day on.

    Minutes are rounded half to even; a minute that rounds to 60 moves the hour on, so the label
    may read ``24:00``.
    """
    total = hours + F.lit(start_hour)
    day = F.floor(total / 24)
    of_day = total - day * 24
    hour = F.floor(of_day).cast("long")
    minute = F.bround((of_day - hour) * 60, 0).cast("long")
    bumped = minute == 60
    return F.when(
        hours.isNotNull(),
        F.concat(
            pad2(F.when(bumped, hour + 1).otherwise(hour)),
            F.lit(":"),
            pad2(F.when(bumped, F.lit(0)).otherwise(minute)),
            F.when(day >= 1, F.lit(" +1")).otherwise(F.lit("")),
        ),
    )


def strict_timestamp(text: Column, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    """Text → timestamp without zone; raises on malformed text under ANSI mode."""
    return F.to_timestamp_ntz(text, F.lit(pattern))


def lenient_timestamp(text: Column, pattern: str = "M/d/yy HH:mm") -> Column:
    """Text → timestamp without zone; malformed text becomes null.

    Two-digit years from 69 on belong to the last century.
    """
    parsed = F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")
    century = F.make_ym_interval(F.lit(100))
    return F.when(F.year(parsed) >= 2069, parsed - century).otherwise(parsed)
