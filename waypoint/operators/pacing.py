"""Arrival fractions per finish block, and plans re-projected from actual times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waypoint.functions.clock import clock_label
from waypoint.functions.numbers import ratio, rounded
from waypoint.operators.joins import join_checked
from waypoint.operators.report import BLOCKS

QUANTILES = ("p25", "p50", "p75")


def nearest_blocks(
    stations: DataFrame, windows: DataFrame, blocks: tuple[int, int] = BLOCKS
) -> DataFrame:
    """Every (station, block) with the window of the nearest block the station has; ties go low."""
    every_block = F.sequence(F.lit(blocks[0]).cast("long"), F.lit(blocks[1]).cast("long"))
    grid = stations.select(
        "station_id", rounded("scaled_mi", 1).alias("mile"), F.explode(every_block).alias("block")
    )
    # At most one window per block on either side of this join.
    near = grid.join(windows, "station_id", "left").groupBy("station_id", "mile", "block").agg(
        F.min_by(
            F.struct(*QUANTILES),
            F.when(
                F.col("finish_block").isNotNull(),
                F.struct(F.abs(F.col("finish_block") - F.col("block")), F.col("finish_block")),
            ),
        ).alias("_w")
    )
    return near.select("station_id", "mile", "block", *[f"_w.{q}" for q in QUANTILES])


def _filled(name: str, along: Window, back: Window) -> Column:
    """Gap filling along the mile axis: linear inside, proportional to the mile outside."""
    known = F.when(F.col(name).isNotNull(), F.struct(F.col("mile").alias("m"), F.col(name).alias("v")))
    before = F.last(known, ignorenulls=True).over(along)
    after = F.last(known, ignorenulls=True).over(back)
    mile = F.col("mile")

    def scaled(anchor: Column) -> Column:
        return F.when(anchor["m"] == 0, anchor["v"]).otherwise(
            anchor["v"] * ratio(mile, anchor["m"])
        )

    share = F.coalesce(ratio(mile - before["m"], after["m"] - before["m"]), F.lit(0.0))
    return (
        F.when(F.col(name).isNotNull(), F.col(name))
        .when(before.isNotNull() & after.isNotNull(), before["v"] + share * (after["v"] - before["v"]))
        .when(after.isNotNull(), scaled(after))
        .when(before.isNotNull(), scaled(before))
        .otherwise(F.coalesce(mile, F.lit(0.0)))
    )


def eta_table(
    stations: DataFrame, windows: DataFrame, blocks: tuple[int, int] = BLOCKS
) -> DataFrame:
    """Arrival at each station as a fraction of the finish, per finish block.

    ``stations``: ``station_id``, ``scaled_mi``; ``windows``: ``station_id``, ``finish_block``,
    ``p25``, ``p50``, ``p75``. The median never falls along the course and ends at 1; the quartiles
    lie on their side of it. Windows run over the stations of one block.
    """
    order = Window.partitionBy("block").orderBy("mile", "station_id")
    reverse = Window.partitionBy("block").orderBy(F.col("mile").desc(), F.col("station_id").desc())
    whole = Window.partitionBy("block")
    filled = nearest_blocks(stations, windows, blocks).withColumns(
        {f"_{q}": _filled(q, order, reverse) for q in QUANTILES}
    )
    last = F.max_by("_p50", F.struct("mile", "station_id")).over(whole)
    finish = F.when(last == 0, F.lit(1.0)).otherwise(last)
    p50 = F.max(F.least(F.col("_p50") / F.col("_finish"), F.lit(1.0))).over(order)
    return (
        filled.withColumn("_finish", finish)
        .withColumn("f50", p50)
        .select(
            "block",
            "station_id",
            "mile",
            rounded(F.least(F.col("_p25") / F.col("_finish"), F.col("f50")), 4).alias("f25"),
            rounded("f50", 4).alias("f50"),
            rounded(F.greatest(F.col("_p75") / F.col("_finish"), F.col("f50")), 4).alias("f75"),
        )
    )


def reproject_plan(
    plans: DataFrame,
    eta: DataFrame,
    actuals: DataFrame,
    blocks: tuple[int, int] = BLOCKS,
    start_hour: float = 5.0,
) -> DataFrame:
    """Predicted and revised arrivals for many plans at once.

    ``plans``: ``plan_id``, ``goal_hrs``; ``actuals``: ``plan_id``, ``station_id``, ``actual_hrs``.
    The plan is the fraction of its block times the goal. The furthest actual is the anchor; the
    rest of the course is stretched by actual over predicted there. Windows run over one plan, that
    is over the stations of the course.
    """
    total = eta.agg(F.max("mile").alias("total_mi")).scalar()
    block = F.greatest(
        F.least(rounded("goal_hrs", 0).cast("long"), F.lit(blocks[1])), F.lit(blocks[0])
    )
    goal = F.col("goal_hrs")
    # The actuals of a plan, at most the stations of the course, meet the plan before it gets its stations,
    # so the long table of plans and stations is never exchanged.
    own = actuals.groupBy("plan_id").agg(F.collect_list(F.struct("station_id", "actual_hrs")).alias("_own"))
    here = F.filter("_own", lambda a: a["station_id"] == F.col("station_id"))
    placed = plans.withColumn("block", block.cast("long")).join(own, "plan_id", "left")
    rows = (
        join_checked(placed, eta, ["block"], "inner")
        .withColumn("_at", F.explode_outer(here))
        .withColumn("actual_hrs", F.col("_at.actual_hrs"))
        .drop("_own", "_at")
        .withColumn(
            "predicted_hrs", F.coalesce(F.col("f50") * goal, goal * ratio(F.col("mile"), total))
        )
    )
    known = F.when(F.col("actual_hrs").isNotNull(), F.struct("mile", "station_id"))
    whole = Window.partitionBy("plan_id")
    anchored = rows.withColumn(
        "_a", F.max_by(F.struct("actual_hrs", "predicted_hrs", "mile"), known).over(whole)
    )
    has_anchor = F.col("_a.mile") > 0
    factor = F.col("_a.actual_hrs") / F.greatest(F.lit(0.1), F.col("_a.predicted_hrs"))

    def projected(hours: Column) -> Column:
        return F.when(
            has_anchor, F.col("_a.actual_hrs") + (hours - F.col("_a.predicted_hrs")) * factor
        ).otherwise(hours)

    finish = projected(goal)
    low, high = F.col("f25") * goal, F.col("f75") * goal
    revised = F.coalesce("actual_hrs", projected(F.col("predicted_hrs")))

    def clock(hours: Column, name: str) -> Column:
        return clock_label(hours, start_hour).alias(name)

    return anchored.select(
        "plan_id",
        "goal_hrs",
        "block",
        "station_id",
        "mile",
        "predicted_hrs",
        clock(F.col("predicted_hrs"), "predicted_clock"),
        low.alias("typical_from_hrs"),
        high.alias("typical_to_hrs"),
        clock(low, "typical_from_clock"),
        clock(high, "typical_to_clock"),
        "actual_hrs",
        revised.alias("revised_hrs"),
        clock(revised, "revised_clock"),
        finish.alias("projected_finish_hrs"),
        clock(finish, "projected_finish_clock"),
        ((finish - goal) * 60).alias("minutes_to_goal"),
    )
