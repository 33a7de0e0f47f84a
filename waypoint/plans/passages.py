"""Binding of the order tables to the checkpoint model, and the chain from sheets to legs.

An order is an entity, its year the edition, and its line numbers are the checkpoints 1 to 7,
14.5 miles apart. Clock readings are derived from the keys, so midnight is really crossed, some
readings slip by half a day, and arrivals, departures or both are missing or malformed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypoint.operators import clock, impute, intervals, reshape, runners
from waypoint.operators.course import station_crosswalk
from waypoint.operators.clock import BY_ENTITY
from waypoint.operators.model import by_station_median, station_medians
from waypoint.session import scratch_path, written
from waypoint.sources.buckets import Buckets
from waypoint.sources.tables import write_table

SPACING_MI = 14.5
CHECKPOINTS = 7
COURSE = intervals.Course(length_mi=101.5, finish_cutoff_mi=101.0)
CROSSWALK_MAX_MI = 1.6


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _clock_text(minutes: str) -> str:
    return (
        f"concat(lpad(string(({minutes}) div 60), 2, '0'), ':',"
        f" lpad(string(({minutes}) % 60), 2, '0'))"
    )


def raw_passages(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order and line number with its two clock texts."""
    # Line items repeat per (order, line), but seldom in one file: combining them before the exchange would
    # hold millions of keys a task for nothing. Laid out by the order, they also meet the orders as they lie.
    lines = (
        table(spark, sf, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        .repartition("l_orderkey")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"))
        .selectExpr("l_orderkey AS k", "int(l_linenumber) AS cp", "pk", "sk")
    )
    orders = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS k", "bigint(year(o_orderdate)) AS edition"
    )
    true_min, stop = "300 + 270 * cp + (37 * k) % 60 + pk % 30", "2 + sk % 40"
    arrive_slip = "CASE WHEN k % 11 = 0 AND cp = 7 THEN 720 ELSE 0 END"
    depart_slip = (
        "CASE WHEN k % 13 = 0 AND cp = 3 THEN 720"
        f" WHEN k % 17 = 0 AND cp = 2 THEN {stop} + 150 ELSE 0 END"
    )
    arrive = _clock_text(f"({true_min} - {arrive_slip}) % 1440")
    depart = _clock_text(f"(1440 + {true_min} + {stop} - {depart_slip}) % 1440")
    return lines.join(orders, "k").selectExpr(
        "edition",
        "concat(string(k), CASE WHEN k % 29 = 0 THEN '*' ELSE '' END) AS entity",
        "concat('AS_0', string(cp)) AS checkpoint",
        "cp",
        "CASE WHEN pk % 97 = 0 THEN 'DNF' WHEN pk % 7 = 0 AND pk % 5 <> 0 THEN NULL"
        f" ELSE {arrive} END AS arrive_text",
        f"CASE WHEN pk % 5 <> 0 THEN {depart} END AS depart_text",
        "string(pk % 50) AS recorded_rank",
    )


def wide_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """The passages as recorded: one row per entity, columns ``as01_arr_tod`` and so on."""
    cells = [
        F.expr(f"max({c}) FILTER (WHERE cp = {i})").alias(f"as0{i}_{suffix}")
        for i in range(1, CHECKPOINTS + 1)
        for suffix, c in reshape.WIDE_SUFFIXES.items()
        if not (suffix == "dep_tod" and i == CHECKPOINTS)
    ]
    cells.append(F.max("recorded_rank").alias("as01_arr_rank2"))
    return raw_passages(spark, sf).groupBy("edition", "entity").agg(*cells)


def editions(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "orders")
        .selectExpr("bigint(year(o_orderdate)) AS edition")
        .distinct()
        .selectExpr(
            "edition", "concat(string(edition), '-08-10') AS start_date", "'05:00' AS start_clock"
        )
    )


def stations(spark: SparkSession, sf: str, years: DataFrame | None = None) -> DataFrame:
    known = editions(spark, sf) if years is None else years
    return reshape.lay_out_stations(known, CHECKPOINTS, SPACING_MI)


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Official results: orders with status ``F``."""
    hours = "20 + o_totalprice / 31250"
    return (
        table(spark, sf, "orders")
        .where("o_orderstatus = 'F'")
        .selectExpr(
            "bigint(year(o_orderdate)) AS edition",
            "o_orderkey AS entity",
            "concat('Runner ', string(o_custkey)) AS name",
            "CASE WHEN o_custkey % 3 = 0 THEN 'F' WHEN o_custkey % 3 = 1 THEN 'male' END AS gender",
            "CASE WHEN o_custkey % 23 = 0 THEN 'n/a' ELSE string(20 + o_custkey % 50) END AS age",
            "CAST(NULL AS STRING) AS city",
            "o_orderkey % 1000 + 1 AS official_rank",
            f"{hours} AS finish_hrs",
            f"({hours}) * 60 AS finish_min",
        )
    )


def corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Passages known to be wrong: checkpoint 6 of every order divisible by 101."""
    return (
        table(spark, sf, "orders")
        .where("o_orderkey % 101 = 0")
        .selectExpr(
            "bigint(year(o_orderdate)) AS edition",
            "string(o_orderkey) AS entity",
            "'AS_06' AS checkpoint",
        )
    )


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return clock.sanitize_times(raw_passages(spark, sf), corrections(spark, sf))


def _place(rows: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    years = written(editions(spark, sf), "editions")  # from all orders, read for both sides
    return clock.attach_edition_station(rows, years, stations(spark, sf, years))


def placed(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned passages with start and station, which they get after the exchange by entity, not before."""
    return _place(clean(spark, sf).repartition(*BY_ENTITY), spark, sf)


def rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    return clock.rebuild_departures(clock.rebuild_clock(placed(spark, sf)))


def splits(spark: SparkSession, sf: str) -> DataFrame:
    """Rebuilt passages with results and per-entity summary, without ranks."""
    return runners.with_summary(runners.attach_results(rebuilt(spark, sf), results(spark, sf)))


def ranked_splits(spark: SparkSession, sf: str) -> DataFrame:
    columns = [
        "edition", "entity", "checkpoint", "cp", "position", "arrive_hrs", "depart_hrs", "gender", "age",
        "finish_rank", "furthest", "max_hrs", "max_position",
    ]
    rows = stored(splits(spark, sf).select(*columns), "splits")  # read for the ranks and for the join with them
    return runners.attach_overall_rank(rows, runners.runner_summary(rows))


def _features(rows: DataFrame) -> DataFrame:
    columns = [
        "edition", "entity", "checkpoint", "cp", "place", "position", "arrive_hrs", "depart_hrs",
        "stop_min", "is_finisher", "finish_rank", "finish_hrs", "furthest",
    ]
    return impute.stop_features(rows, COURSE, ranked=False).select(*columns)


def _filled(features: DataFrame) -> DataFrame:
    medians = written(station_medians(features, COURSE), "medians")  # read for each checkpoint and for all
    return impute.impute_times(features, by_station_median(medians), COURSE)


def stored_features(spark: SparkSession, sf: str) -> DataFrame:
    """The rebuilt passages, one row each, with what filling and legs need."""
    return stored(_features(splits(spark, sf)), "features")


def imputed(spark: SparkSession, sf: str, features: DataFrame | None = None) -> DataFrame:
    """One-sided times filled from the median stop of the checkpoint.

    The features are read twice, for the medians and for the filling, so they are written once.
    """
    return _filled(stored_features(spark, sf) if features is None else features)


def bucketed_splits(spark: SparkSession, sf: str, store: Buckets) -> DataFrame:
    """``splits`` from cleaned passages and results in buckets of the entity: one exchange each, none after."""
    rows = store.keep(clean(spark, sf), BY_ENTITY, ["cp"])
    found = store.keep(results(spark, sf), BY_ENTITY)
    timed = clock.rebuild_departures(clock.rebuild_clock(_place(rows, spark, sf)))
    return runners.with_summary(runners.attach_results(timed, found))


def bucketed_legs(spark: SparkSession, sf: str, store: Buckets) -> DataFrame:
    """``legs`` with the features in buckets too: their windows read them as they lie."""
    features = store.keep(_features(bucketed_splits(spark, sf, store)), BY_ENTITY, ["cp"])
    return intervals.interval_features(_filled(features), COURSE)


def legs(spark: SparkSession, sf: str, features: DataFrame | None = None) -> DataFrame:
    return intervals.interval_features(imputed(spark, sf, features), COURSE)


def reference_stations(spark: SparkSession, sf: str) -> DataFrame:
    """The layout every edition is matched to: one station per nation, 4.2 miles apart."""
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("long").alias("station_id"),
        F.col("n_name").alias("name"),
        F.round(F.col("n_nationkey") * F.lit(4.2), 2).alias("scaled_mi"),
    )


def crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    return station_crosswalk(
        reference_stations(spark, sf), stations(spark, sf), None, CROSSWALK_MAX_MI
    )


def leg_ratios(spark: SparkSession, sf: str, features: DataFrame | None = None) -> DataFrame:
    return intervals.interval_ratio(legs(spark, sf, features), crosswalk(spark, sf))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as it is partitioned, and read back.

    For tables that are passed over several times. The written table is read with column pruning
    and has known sizes, and a lost executor does not bring back the whole chain.
    """
    path = scratch_path(df.sparkSession, name)
    write_table(df, path, partition_by=())
    return df.sparkSession.read.schema(df.schema).parquet(path)


LEG_COLUMNS = [
    "edition", "entity", "checkpoint", "cp", "place", "position", "arrive_hrs", "is_finisher",
    "furthest", "stop_min", "stop_imputed", "spans_missing", "leg_mi", "leg_pace", "overall_pace",
]


def stored_legs(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """The legs, written once. The features lie in buckets meanwhile, so filling and legs need no exchange."""
    with Buckets(spark) as store:
        features = store.keep(_features(splits(spark, sf)), BY_ENTITY, None)  # they come in order of the entity
        return stored(legs(spark, sf, features).select(*LEG_COLUMNS, *more), "legs")


def stored_legs_and_ratios(
    spark: SparkSession, sf: str, features: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both tables, the ratios from the written legs: the chain before them runs once."""
    columns = [*LEG_COLUMNS, "leg_ratio", "finish_rank", "finish_hrs"]
    rows = stored(legs(spark, sf, features).select(*columns), "legs")
    return rows, stored(intervals.interval_ratio(rows, crosswalk(spark, sf)), "ratios")


def stored_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return stored(leg_ratios(spark, sf), "ratios")
