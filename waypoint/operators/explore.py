"""Browsing: filtered views and the series of a chart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waypoint.operators.clock import ENTITY
from waypoint.operators.reshape import select_existing
from waypoint.operators.runners import NOT_FINISHED


def trace_series(df: DataFrame) -> DataFrame:
    """One point per passage: arrival, else departure; ``point`` orders the points of an entity."""
    order = Window.partitionBy(*ENTITY).orderBy("position", "cp")
    first_name = F.max("name").over(Window.partitionBy(*ENTITY))
    number = F.col("entity").cast("string")
    return df.select(
        *ENTITY,
        F.when(first_name.isNull(), number)
        .otherwise(F.concat(number, F.lit(" – "), first_name))
        .alias("label"),
        F.row_number().over(order).alias("point"),
        "checkpoint",
        "place",
        "position",
        F.coalesce("arrive_hrs", "depart_hrs").alias("elapsed_hrs"),
        F.coalesce("arrive_text", "depart_text").alias("clock_text"),
        F.coalesce("arrive_elapsed", "depart_elapsed").alias("elapsed_text"),
        F.coalesce("arrive_at", "depart_at").alias("passed_at"),
    )


def matches(
    editions: Sequence[int], status: str | None = None, name_pattern: str | None = None
) -> Column:
    """Predicate of the explorer: editions, ``finish`` or ``dnf``, and a regular expression."""
    keep = F.col("edition").isin([int(e) for e in editions])
    if status == "finish":
        keep = keep & (F.col("finish_rank") != NOT_FINISHED)
    elif status == "dnf":
        keep = keep & (F.col("finish_rank") == NOT_FINISHED)
    if name_pattern and name_pattern.strip():
        keep = keep & F.lower("name").rlike(name_pattern.strip().lower())
    return keep


def explore(
    df: DataFrame,
    editions: Sequence[int],
    status: str | None = None,
    name_pattern: str | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The matching rows with the chosen columns that exist."""
    rows = df.where(matches(editions, status, name_pattern))
    return select_existing(rows, columns) if columns else rows


def explore_counts(
    df: DataFrame,
    editions: Sequence[int],
    status: str | None = None,
    name_pattern: str | None = None,
) -> DataFrame:
    """One row: matching rows, entities among them, and all entities of the editions."""
    hit = matches(editions, status, name_pattern)
    per_entity = (
        df.where(matches(editions))
        .groupBy(*ENTITY)
        .agg(F.count_if(hit).alias("rows"))
    )
    per_number = per_entity.groupBy("entity").agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("in_editions")
    )
    return per_number.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"),
        F.count_if(F.col("rows") > 0).alias("n_entities"),
        F.coalesce(F.sum("in_editions"), F.lit(0)).alias("n_entities_total"),
    )


def preview(df: DataFrame, rows: int = 50) -> DataFrame:
    """The first rows of a table, for display."""
    return df.limit(rows)
