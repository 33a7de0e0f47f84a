"""Flags, diagnostics and expectation tables.

Every check is an aggregate over the whole table; checks on one table share a single pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waypoint.operators.quantiles import grouped_quantiles, pick
from waypoint.functions.numbers import ratio, rounded
from waypoint.operators.clock import ENTITY
from waypoint.operators.reshape import require_columns
from waypoint.operators.runners import NOT_FINISHED

# Names of the quality flags a timing table may carry.
FLAGS = [
    "pace_flag",
    "rank_outlier_flag",
    "exceeds_cutoff",
    "arrive_interpolated",
    "depart_interpolated",
]


def any_flag(flags: Sequence[str]) -> Column:
    """True if one of the flags is set; null counts as not set."""
    return reduce(
        lambda a, b: a | b, [F.coalesce(F.col(f), F.lit(False)) for f in flags], F.lit(False)
    )


def plotted(df: DataFrame, hours: str, editions: Sequence[int]) -> DataFrame:
    """Rows of the editions that have a checkpoint, a position and the chosen time."""
    require_columns(df, ["edition", "entity", "checkpoint", "position", hours])
    present = [F.col(c).isNotNull() for c in ("checkpoint", "position", hours)]
    return df.where(
        reduce(lambda a, b: a & b, present, F.col("edition").isin([int(e) for e in editions]))
    )


def flagged_entities(df: DataFrame, flags: Sequence[str] = FLAGS) -> DataFrame:
    found = [f for f in flags if f in df.columns]
    return df.where(any_flag(found)).select(*ENTITY).distinct()


def diagnose_timing(df: DataFrame, flags: Sequence[str] = FLAGS) -> DataFrame:
    """One row: entities, checkpoints, entities with a flag, and rows per flag."""
    found = [f for f in flags if f in df.columns]
    per_entity = df.groupBy(*ENTITY).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.max(any_flag(found)).alias("_flagged"),
        *[F.count_if(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in found],
    )
    return per_entity.agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("n_checkpoints"),
        F.count_if("_flagged").alias("n_flagged"),
        *[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in found],
    )


def _long(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """One-row table of counts → rows (check_name, violations)."""
    cells = [
        F.struct(F.lit(n).alias("check_name"), F.col(n).cast("long").alias("violations"))
        for n in names
    ]
    return counts.select(F.inline(F.array(*cells)))


def check_splits(df: DataFrame, limit_hrs: float = 36.0) -> DataFrame:
    """Violations of the rules every timing table has to meet."""
    arrive, depart = F.col("arrive_hrs"), F.col("depart_hrs")
    order = Window.partitionBy(*ENTITY).orderBy("cp")
    stop = (depart - arrive) * 60
    both = arrive.isNotNull() & depart.isNotNull()
    # The latest arrival before this row: rows without an arrival are skipped over.
    before = F.last("arrive_hrs", ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, -1)
    )
    rules: Mapping[str, Column] = {
        "finisher_marked_dnf": F.col("official_rank").isNotNull()
        & (F.col("finish_rank") == NOT_FINISHED),
        "finisher_without_finish": F.col("official_rank").isNotNull()
        & (F.col("furthest") != "FINISH"),
        "negative_arrival": arrive < 0,
        "arrival_past_limit": arrive > limit_hrs,
        "departure_out_of_range": (depart < 0) | (depart > limit_hrs),
        "no_time": arrive.isNull() & depart.isNull(),
        "departs_before_arrival": both & (stop < 0),
        "departs_an_hour_before_arrival": both & (stop < -60),
        "arrives_before_previous": arrive < F.col("_before"),
    }
    counts = df.withColumn("_before", before).agg(
        *[F.count_if(c).alias(n) for n, c in rules.items()]
    )
    return _long(counts, list(rules))


def check_legs(legs: DataFrame, max_stop_min: float = 180.0) -> DataFrame:
    """Violations after imputation, and the share of leg paces between 6 and 60 minutes per mile."""
    arrive, depart, pace = F.col("arrive_hrs"), F.col("depart_hrs"), F.col("leg_pace")
    rules: Mapping[str, Column] = {
        "arrival_missing_after_imputation": arrive.isNull(),
        "imputed_arrival_after_departure": F.col("arrive_imputed") & (arrive > depart + 1e-9),
        "stop_too_long": F.col("stop_min") > max_stop_min,
        "imputed_stop_negative": F.col("stop_imputed") & (F.col("stop_min") < 0),
        "leg_without_pace": (F.col("leg_min") <= 0) | (F.col("leg_mi") <= 0),
        "pace_out_of_band": (pace < 6) | (pace > 60),
    }
    counts = legs.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    return _long(counts, list(rules))


def share_in_band(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """One row: share of non-null values strictly inside the band."""
    inside = F.count_if((F.col(value) > low) & (F.col(value) < high))
    return df.agg(rounded(ratio(inside, F.count(value)), 4).alias("share"), F.count(value).alias("n"))


def unmatched_keys(rows: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """(edition, checkpoint) of the rows that the crosswalk does not list."""
    keys = ["edition", "checkpoint"]
    return rows.select(*keys).distinct().join(crosswalk.select(*keys), keys, "left_anti")


def rows_with_time(df: DataFrame, time: str = "depart_hrs") -> DataFrame:
    """Recorded times per edition."""
    return df.where(F.col(time).isNotNull()).groupBy("edition").agg(F.count(F.lit(1)).alias("n"))


def worst(df: DataFrame, by: str, keep: Sequence[str], rows: int = 5) -> DataFrame:
    """The largest values, for a report; ties by the kept columns."""
    return df.orderBy(F.col(by).desc_nulls_last(), *keep).select(*keep, by).limit(rows)


def check_ratios(legs: DataFrame, ratios: DataFrame) -> DataFrame:
    """Figures that a slip of units or definitions would move far off, and whether they are in range.

    The median over entities of the median pace ratio of each, the medians of ratio and overall pace
    over all legs of finishers, and the share of ratios between 0.3 and 3.
    """
    per_entity = legs.groupBy(*ENTITY).agg(F.median("leg_ratio").alias("m"))  # as many values as checkpoints
    middle = grouped_quantiles(per_entity, [], {"m": "m"}, [0.5])
    whole = grouped_quantiles(ratios, [], {"ratio": "leg_ratio", "pace": "overall_pace"}, [0.5])
    inside = share_in_band(ratios, "leg_ratio", 0.3, 3.0)
    parts = [
        _figure(middle, "median_ratio_of_entities", pick("m"), 0.8, 1.05),
        _figure(whole, "median_ratio", pick("ratio"), 0.75, 1.05),
        _figure(whole, "median_pace", pick("pace"), 10.0, 24.0),
        _figure(inside, "share_in_band", F.col("share"), 0.99, 1.0),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _figure(table: DataFrame, name: str, value: Column, low: float, high: float) -> DataFrame:
    return table.select(
        F.lit(name).alias("check_name"), rounded(value, 4).alias("value"), value.between(low, high).alias("in_range")
    )


def check_crosswalk(rows: DataFrame, crosswalk: DataFrame, max_mi: float) -> DataFrame:
    """Violations of a crosswalk: keys it does not list or place, matches too far off, names at two stations."""
    keys = rows.select("edition", "checkpoint").distinct()
    listed = crosswalk.select("edition", "checkpoint", "station_id", F.lit(True).alias("_listed"))
    found = keys.join(listed, ["edition", "checkpoint"], "left").agg(
        F.count_if(F.col("_listed").isNull()).alias("key_not_listed"),
        F.count_if(F.col("_listed") & F.col("station_id").isNull()).alias("key_without_station"),
    )
    far = crosswalk.agg(F.count_if(F.col("delta_mi") > max_mi).alias("match_too_far"))
    moved = crosswalk.groupBy("place").agg(F.count_distinct("station_id").alias("_n"))
    moved = moved.agg(F.count_if(F.col("_n") > 1).alias("place_at_two_stations"))
    return (
        _long(found, ["key_not_listed", "key_without_station"])
        .unionByName(_long(far, ["match_too_far"]))
        .unionByName(_long(moved, ["place_at_two_stations"]))
    )


def check_eta(eta: DataFrame) -> DataFrame:
    """Violations of an arrival table: blocks that do not end at 1, steps back, bounds that cross."""
    order = Window.partitionBy("block").orderBy("mile", "station_id")  # the stations of the course
    steps = eta.withColumns({"_before": F.lag("f50").over(order), "_next": F.lead("f50").over(order)})
    rules: Mapping[str, Column] = {
        "block_not_ending_at_one": F.col("_next").isNull() & (F.abs(F.col("f50") - 1) > 1e-3),
        "step_back": F.col("f50") < F.col("_before"),
        "bounds_crossed": (F.col("f25") > F.col("f50")) | (F.col("f50") > F.col("f75")),
    }
    return _long(steps.agg(*[F.count_if(c).alias(n) for n, c in rules.items()]), list(rules))
