"""From clock readings to absolute times.

All windows run over one entity of one edition. (edition, entity, checkpoint) is a key, so such a
group never exceeds the number of checkpoints, and the windows of a chain share one exchange. They
name the entity first, see :func:`of_entity`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from waypoint.functions.clock import (
    DAY_S,
    elapsed_text,
    seconds_of_day,
    strict_timestamp,
)
from waypoint.functions.numbers import bare_number, bare_text
from waypoint.operators.joins import join_checked

CLOCK_PATTERN = r"^\d{2}:\d{2}$"
ENTITY = ["edition", "entity"]
BY_ENTITY = ["entity", "edition"]
_START = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$"


@dataclass(frozen=True)
class ClockRules:
    """Limits in seconds. Fixed values of the timing rules."""

    start_s: int = 5 * 3600
    inversion_s: int = 3600
    garbage_s: int = 6 * 3600
    half_day_slip_s: int = 18 * 3600
    limit_s: int = 36 * 3600
    half_day_s: int = 12 * 3600


def of_entity() -> WindowSpec:
    """The passages of one entity of one edition.

    A sort goes by a prefix of the first column and compares whole rows only where that is equal. So the
    entity comes first: an edition has millions of rows.
    """
    return Window.partitionBy(*BY_ENTITY)


def sanitize_times(
    df: DataFrame, corrections: DataFrame | None = None, numeric_entities: bool = True
) -> DataFrame:
    """Null readings that are not ``HH:MM``, apply corrections, keep rows with at least one time.

    ``corrections`` lists (edition, entity, checkpoint) whose two readings are both wrong. A ``*``
    in the entity is removed first, so ``545*`` and ``545`` are one entity from here on; ``_starred``
    remembers it. Entities become numbers, and one that is none fails the query; with
    ``numeric_entities=False`` they stay text, such as parcel or order codes.
    """
    own = bare_number if numeric_entities else bare_text

    def well_formed(c: str) -> Column:
        return F.when(F.col(c).rlike(CLOCK_PATTERN), F.col(c))

    out = df.withColumns(
        {
            "_starred": F.col("entity").cast("string").contains("*"),
            "entity": own("entity"),
            "edition": F.col("edition").cast("long"),
            "arrive_text": well_formed("arrive_text"),
            "depart_text": well_formed("depart_text"),
        }
    )
    if corrections is not None:
        keys = [*ENTITY, "checkpoint"]
        listed = bare_text("entity")  # a correction of what is no entity matches nothing
        wrong = corrections.select(
            F.col("edition").cast("long").alias("edition"),
            (listed.try_cast("long") if numeric_entities else listed).alias("entity"),
            "checkpoint",
        ).distinct()
        out = join_checked(out, wrong.withColumn("_wrong", F.lit(True)), keys)
        keep = F.col("_wrong").isNull()
        out = out.withColumns(
            {c: F.when(keep, F.col(c)) for c in ("arrive_text", "depart_text")}
        ).drop("_wrong")
    return out.where(F.col("arrive_text").isNotNull() | F.col("depart_text").isNotNull())


def attach_edition_station(df: DataFrame, editions: DataFrame, stations: DataFrame) -> DataFrame:
    """Start time of the edition, and name, position and finish flag of the checkpoint.

    Start texts are read once per edition. One that is malformed fails the query when a row has it.
    """
    start = F.concat_ws(" ", "start_date", "start_clock")
    text = F.col("start_text")
    starts = editions.select(
        F.col("edition").cast("long").alias("edition"),
        F.when(F.col("start_date").isNotNull() & F.col("start_clock").isNotNull(), start).alias(
            "start_text"
        ),
    ).withColumn("_start", F.when(text.rlike(_START), text.try_cast("timestamp_ntz")))
    places = stations.select(
        F.col("edition").cast("long").alias("edition"),
        "checkpoint",
        "place",
        "position",
        "position_step",
        F.col("is_finish").cast("boolean").alias("is_finish"),
    ).where(F.col("edition").isNotNull())
    return (
        join_checked(join_checked(df, starts, ["edition"]), places, ["edition", "checkpoint"])
        .withColumn("start_at", F.coalesce(F.col("_start"), strict_timestamp(text)))
        .drop("_start")
    )


def _at(midnight: Column, seconds: Column, days: Column) -> Column:
    return F.timestamp_add("SECOND", seconds + days * DAY_S, midnight)


def _elapsed(name: str, seconds: Column, days: Column) -> dict[str, Column]:
    """Elapsed hours and text from seconds since midnight; no time zone is involved."""
    since_start = seconds + days * DAY_S - F.col("_start_s")
    return {f"{name}_hrs": since_start / 3600, f"{name}_elapsed": elapsed_text(since_start)}


def _one_per_checkpoint(df: DataFrame) -> DataFrame:
    ties = [F.asc_nulls_last("arrive_text"), F.asc_nulls_last("depart_text")]
    if "_starred" in df.columns:
        ties.insert(0, F.asc("_starred"))
    seen = F.lag("cp").over(of_entity().orderBy("cp", *ties))
    return df.withColumn("_seen", seen).where(F.col("_seen").isNull() | (F.col("_seen") != F.col("cp"))).drop("_seen", "_starred")


def rebuild_clock(df: DataFrame, rules: ClockRules = ClockRules()) -> DataFrame:
    """Absolute arrival times from bare clock readings.

    The reading of a row is its arrival, or its departure when there is none. A step back by more
    than the tolerance is a passed midnight; only one can happen, so a second one marks a half-day
    slip of that row, repaired when the result stays within the time limit. Working columns start
    with ``_`` and are consumed by :func:`rebuild_departures`.

    Of several records of one checkpoint the first counts: one whose entity had no ``*``, then the
    earlier arrival reading, then the earlier departure reading, missing ones last.
    """
    df = _one_per_checkpoint(df)
    order = of_entity().orderBy("cp")
    read = F.col("_read_s")
    stepped_back = (F.lag("_read_s", 1, rules.start_s).over(order) - read) > rules.inversion_s
    slip = (
        F.col("_back")
        & (F.col("_backs") >= 2)
        & (DAY_S + read + rules.half_day_s - rules.start_s <= rules.limit_s)
    )
    return (
        df.withColumns(
            {"_arrive_s": seconds_of_day("arrive_text"), "_depart_s": seconds_of_day("depart_text")}
        )
        .withColumn("_read_s", F.coalesce("_arrive_s", "_depart_s"))
        .withColumn("_back", stepped_back)
        .withColumn(
            "_backs",
            F.sum(F.col("_back").cast("int")).over(
                order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
        .withColumns(
            {
                "_day": F.least(F.col("_backs"), F.lit(1)),
                "_read_s": F.when(slip, read + rules.half_day_s).otherwise(read),
                "_midnight": F.to_date("start_at").cast("timestamp_ntz"),
                "_start_s": (
                    F.hour("start_at") * 3600 + F.minute("start_at") * 60 + F.second("start_at")
                ).cast("long"),
            }
        )
        .withColumn("_arrive_s", F.when(F.col("_arrive_s").isNotNull(), F.col("_read_s")))
        .withColumn("arrive_at", _at(F.col("_midnight"), F.col("_arrive_s"), F.col("_day")))
        .withColumns(_elapsed("arrive", F.col("_arrive_s"), F.col("_day")))
        .drop("_back", "_backs")
    )


def rebuild_departures(df: DataFrame, rules: ClockRules = ClockRules()) -> DataFrame:
    """Absolute departure times, judged by how far the reading lies before its arrival.

    Up to the tolerance it stands, up to the garbage limit it is dropped, up to the slip limit (or
    beyond it once midnight has passed) it is moved by half a day, and otherwise the departure is
    taken to lie after midnight.
    """
    depart, day = F.col("_depart_s"), F.col("_day")
    back = F.col("_arrive_s") - depart
    has_arrival = F.col("_arrive_s").isNotNull()
    repaired = (
        F.when(depart.isNull(), F.lit(None))
        .when(~has_arrival, F.col("_read_s"))
        .when(back <= rules.inversion_s, depart)
        .when(back <= rules.garbage_s, F.lit(None))
        .when((back <= rules.half_day_slip_s) | (day >= 1), depart + rules.half_day_s)
        .otherwise(depart)
    )
    next_day = has_arrival & (back > rules.half_day_slip_s) & (day < 1)
    days = day + F.coalesce(next_day, F.lit(False)).cast("int")
    return (
        df.withColumn("depart_at", _at(F.col("_midnight"), repaired, days))
        .withColumns(_elapsed("depart", repaired, days))
        .drop("_arrive_s", "_depart_s", "_read_s", "_day", "_midnight", "_start_s")
    )
