"""Legs between checkpoints and their pace."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waypoint.functions.numbers import finish_block, ratio
from waypoint.operators.clock import of_entity
from waypoint.operators.joins import join_checked
from waypoint.operators.runners import NOT_FINISHED


@dataclass(frozen=True)
class Course:
    """Full length, and the position from which a row is the finish. Fixed default values."""

    length_mi: float = 103.1
    finish_cutoff_mi: float = 103.0


def interval_features(df: DataFrame, course: Course = Course()) -> DataFrame:
    """Distance, time and pace of the leg into each checkpoint, overall pace and their ratio.

    The leg starts at the previous recorded departure (arrival if that is all there is); a missing
    previous value counts as 0, also in the middle of a row sequence.
    """
    order = of_entity().orderBy("cp")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one pass with the rest

    def previous(c):
        return F.coalesce(F.lag(c).over(order), F.lit(0))

    finished = F.max(F.col("is_finisher").cast("int")).over(whole) == 1
    finish_hrs = F.max("finish_hrs").over(whole)
    covered = ratio(
        F.max(F.greatest("arrive_hrs", "depart_hrs")).over(whole) * 60,
        F.max("position").over(whole),
    )
    out = df.withColumns(
        {
            "leg_mi": F.col("position") - previous(F.col("position")),
            "leg_min": (
                F.col("arrive_hrs") - previous(F.coalesce("depart_hrs", "arrive_hrs"))
            )
            * 60,
            "spans_missing": (F.col("cp") - previous(F.col("cp"))) > 1,
            "overall_pace": F.when(finished, finish_hrs * 60 / F.lit(course.length_mi)).otherwise(
                covered
            ),
        }
    )
    return (
        out.withColumn(
            "leg_pace",
            F.when(
                (F.col("leg_mi") > 0) & (F.col("leg_min") > 0), F.col("leg_min") / F.col("leg_mi")
            ),
        )
        .withColumn("leg_ratio", ratio(F.col("leg_pace"), F.col("overall_pace")))
        .withColumn("is_finisher", F.col("is_finisher").cast("boolean"))
    )


def interval_ratio(features: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Legs of finishers with their finish-hour block and reference station."""
    legs = features.where(
        (F.col("finish_rank") != NOT_FINISHED)
        & F.col("leg_ratio").isNotNull()
        & F.col("finish_hrs").isNotNull()
        & (F.col("position") > 0)
    )
    stations = crosswalk.select("edition", "checkpoint", "station_id", "station_mi")
    return join_checked(legs, stations, ["edition", "checkpoint"]).select(
        "edition",
        "entity",
        "checkpoint",
        "place",
        "position",
        F.col("arrive_hrs").alias("elapsed_hrs"),
        "leg_pace",
        "overall_pace",
        "leg_ratio",
        "finish_hrs",
        finish_block(F.col("finish_hrs")).alias("finish_block"),
        "station_id",
        "station_mi",
    )
