"""Results, per-entity summary and ranks, and the path of already elapsed history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waypoint.functions.clock import lenient_timestamp
from waypoint.functions.numbers import as_column, bare_number, bare_text, checkpoint_label, trailing_number
from waypoint.operators.clock import BY_ENTITY, ENTITY, of_entity
from waypoint.operators.joins import join_checked, match_null_safe
from waypoint.operators.ordered import ordinal_rank
from waypoint.operators.reshape import null_column
from waypoint.session import written

NOT_FINISHED = "DNF"
RESULT_COLUMNS = [
    "name",
    "gender",
    "age",
    "city",
    "official_rank",
    "finish_text",
    "finish_hrs",
    "finish_min",
]
SUMMARY_COLUMNS = ["finish_rank", "furthest", "max_hrs", "overall_rank"]


def attach_results(
    df: DataFrame, results: DataFrame, numeric_entities: bool = True
) -> DataFrame:
    """Official result and demographics of the entity, one result row per (edition, entity).

    A result key that occurs twice fails the query that reads its result, naming the key; rows are never
    multiplied. Results without a key match nothing. With ``numeric_entities=False`` entities are joined as text, a ``*`` aside.
    """
    if not numeric_entities:
        found = [c for c in RESULT_COLUMNS if c in results.columns]
        edition = F.col("edition").cast("long").alias("edition")
        keyed = results.select(edition, bare_text("entity").alias("entity"), *found)
        return df.join(_one_per_key(keyed, found), ENTITY, "left")
    found = [c for c in RESULT_COLUMNS if c in results.columns]
    numeric = dict(results.dtypes)["entity"] in ("bigint", "int")
    entity = F.col("entity").cast("long") if numeric else bare_number("entity")
    keyed = results.select(
        F.col("edition").cast("long").alias("edition"),
        entity.alias("entity"),
        *found,
    )
    if dict(df.dtypes)["entity"] != "bigint":  # a recast would lose the partitioning by entity
        df = df.withColumn("entity", bare_number("entity"))
    return df.join(_one_per_key(keyed, found), ENTITY, "left")


def _one_per_key(results: DataFrame, values: Sequence[str]) -> DataFrame:
    """The results by key; the values of a key that occurs more than once raise an error."""
    known = results.where(F.col("edition").isNotNull() & F.col("entity").isNotNull())
    counted = known.groupBy(*BY_ENTITY).agg(  # partitioned as the passages are
        F.count(F.lit(1)).alias("_times"), *[F.first(c).alias(c) for c in values]
    )
    key = F.concat_ws(" ", *[F.col(c).cast("string") for c in ENTITY])
    repeated = F.raise_error(F.concat(F.lit("repeated result: "), key))
    return counted.select(
        *ENTITY, *[F.when(F.col("_times") > 1, repeated).otherwise(F.col(c)).alias(c) for c in values]
    )


def repeated_results(results: DataFrame) -> DataFrame:
    """Keys that occur more than once; must be empty, or :func:`attach_results` fails."""
    return results.groupBy("edition", "entity").count().where("count > 1")


def with_summary(df: DataFrame, use_departures: bool = True) -> DataFrame:
    """Adds ``finish_rank``, ``furthest`` and ``max_hrs`` of the entity, and its furthest position.

    Finished means that an official rank exists. A window over the entity instead of an aggregate
    joined back: the rows are already together after the clock operators.
    """
    whole = of_entity()
    latest = F.greatest("arrive_hrs", "depart_hrs") if use_departures else F.col("arrive_hrs")
    rank = F.max("official_rank").over(whole)
    finished = rank.isNotNull()
    return df.withColumns(
        {
            "finish_rank": F.when(finished, rank.cast("string")).otherwise(F.lit(NOT_FINISHED)),
            "furthest": F.when(finished, F.lit("FINISH")).otherwise(
                checkpoint_label(F.max("cp").over(whole))
            ),
            "max_hrs": F.when(finished, F.max("finish_hrs").over(whole)).otherwise(
                F.max(latest).over(whole)
            ),
            "max_position": F.max("position").over(whole),
        }
    )


def runner_summary(df: DataFrame) -> DataFrame:
    """One row per entity with its rank in the edition.

    Ranked by furthest position (descending) and time, nulls last, ties by entity. An edition is
    ranked across the cluster; ``edition_size`` is its number of entities.
    """
    per_entity = df.groupBy(*ENTITY).agg(
        *[
            F.max(c).alias(c)
            for c in ("finish_rank", "furthest", "max_hrs", "max_position")
        ]
    )
    return ordinal_rank(
        written(per_entity, "entities"),  # a sort reads its input twice, first for the ranges
        ["edition"],
        [
            F.col("max_position").desc_nulls_last(),
            F.col("max_hrs").asc_nulls_last(),
            F.col("entity"),
        ],
        "overall_rank",
        size="edition_size",
    )


def attach_overall_rank(df: DataFrame, summary: DataFrame) -> DataFrame:
    return df.join(summary.select(*ENTITY, "overall_rank", "edition_size"), ENTITY, "left")


def station_ranks(df: DataFrame, by: str | Column = "arrive_at", nulls_first: bool = False) -> DataFrame:
    """Edition, entity, checkpoint and the order of arrival there; null arrivals come last by default.

    Only these columns and the arrival enter the sort across the cluster.
    """
    narrow = df.select(*ENTITY, "checkpoint", as_column(by).alias("_at"))
    at = F.col("_at").asc_nulls_first() if nulls_first else F.col("_at").asc_nulls_last()
    ranked = ordinal_rank(narrow, ["edition", "checkpoint"], [at, F.col("entity")], "station_rank")
    return ranked.select(*ENTITY, "checkpoint", "station_rank")


def station_rank(df: DataFrame, by: str | Column = "arrive_at", nulls_first: bool = False) -> DataFrame:
    """The rows with their order of arrival; (edition, entity, checkpoint) is their key."""
    return match_null_safe(df, station_ranks(df, by, nulls_first), [*ENTITY, "checkpoint"])


def clean_long_history(raw: DataFrame, stations: DataFrame, results: DataFrame) -> DataFrame:
    """History recorded in long form with elapsed times, brought to the common columns.

    Names and demographics come from the results, the file's own are dropped; ``M/d/yy HH:mm`` text
    becomes ISO text, malformed text null. For ranks see :func:`with_history_ranks`.
    """
    flags = stations.where(F.col("edition").isNotNull()).select(
        F.col("edition").cast("long").alias("edition"), "checkpoint", "is_finish"
    )
    start = F.date_format(lenient_timestamp(F.col("start_text")), "yyyy-MM-dd HH:mm")
    typed = (
        raw.where(F.col("edition").isNotNull())
        .drop("time_check", "time_adjustment", "name", "gender", "age", "")
        .withColumns(
            {
                "edition": F.col("edition").cast("long"),
                "arrive_hrs": F.col("arrive_hrs").cast("double"),
                "position": F.col("position").cast("double"),
                "position_step": F.col("position_step").cast("double"),
                "cp": trailing_number("checkpoint"),
                "arrive_at": lenient_timestamp(F.col("arrive_at")),
                "start_text": start,
                "original_order": null_column("long"),
            }
        )
    )
    joined = attach_results(join_checked(typed, flags, ["edition", "checkpoint"]), results)
    return with_summary(joined, use_departures=False).drop("is_finish")


def with_history_ranks(history: DataFrame) -> DataFrame:
    """Cleaned history with ``overall_rank``, ``edition_size`` and ``station_rank``.

    Arrivals are ordered by elapsed time, missing ones first. The rows are read three times, so write
    them first if they are dear to compute.
    """
    ranked = attach_overall_rank(history, runner_summary(history))
    return match_null_safe(ranked, station_ranks(history, "arrive_hrs", True), [*ENTITY, "checkpoint"])
