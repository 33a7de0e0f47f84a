"""Summaries of a finisher list: ranks, shares, yearly means, histograms, boxes and bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waypoint.functions.numbers import as_column, ratio, rounded
from waypoint.operators.ordered import ordinal_rank
from waypoint.operators.quantiles import grouped_quantiles, pick
from waypoint.operators.reshape import spread


def finish_order(
    df: DataFrame, time: str, tie_break: Sequence[str | Column], name: str = "finish_order"
) -> DataFrame:
    """Rank by time in each edition; ties in the order given, for example a hash of the key."""
    return ordinal_rank(df, ["edition"], [time, *tie_break], name)


def share_table(df: DataFrame, part: str) -> DataFrame:
    """Rows per (edition, part), share of everything and of the edition, running bar centres.

    ``centre`` runs over all cells ordered by edition and part. The windows see one row per cell.
    """
    cells = df.groupBy("edition", part).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(0))
    running = everything.orderBy("edition", part)
    total = F.sum("n").over(everything)
    return cells.select(
        "edition",
        part,
        "n",
        rounded(F.col("n") / total, 6).alias("share"),
        rounded(F.col("n") / F.sum("n").over(Window.partitionBy("edition")), 6).alias(
            "share_of_edition"
        ),
        F.sum(F.col("n") - 0.5 * F.col("n")).over(running).alias("centre"),
    )


def share_spread(df: DataFrame, part: str, parts: Sequence[str]) -> DataFrame:
    """One row per edition, one column with the count of every part and one with its share."""
    counts = df.groupBy("edition", part).agg(F.count(F.lit(1)).alias("n"))
    wide = spread(counts, ["edition"], part, parts, F.sum("n"))
    total = sum((F.coalesce(F.col(f"`{p}`"), F.lit(0)) for p in parts), F.lit(0))
    return wide.select(
        "edition",
        *[F.col(f"`{p}`").alias(f"n_{p}") for p in parts],
        *[rounded(ratio(F.col(f"`{p}`"), total), 6).alias(f"share_{p}") for p in parts],
    )


def listed(df: DataFrame, column: str, most: int = 200) -> list:
    """The values of a column that becomes a row of columns; more than ``most`` is an error."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has over {most} values, too many for columns")
    return sorted(found)


def rank_by_edition(
    ranked: DataFrame, rank: str, time: str, editions: Sequence[int]
) -> DataFrame:
    """One row per rank, one column per edition with the time at that rank, 0 where there is none."""
    return spread(ranked, [rank], "edition", editions, F.max(time), fill=0.0)


def edition_means(df: DataFrame, time: str | Column) -> DataFrame:
    """Mean time per edition and the edition's place among them. One row per edition."""
    means = df.groupBy("edition").agg(F.avg(as_column(time)).alias("_mean"))
    order = Window.partitionBy(F.lit(0)).orderBy(rounded("_mean", 9))
    return means.select(
        "edition", rounded("_mean", 4).alias("mean"), F.rank().over(order).alias("place")
    )


def mean_quintiles(means: DataFrame) -> DataFrame:
    """One row: minimum, the four inner quintiles and maximum of the yearly means."""
    levels = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
    found = grouped_quantiles(means, [], {"m": "mean"}, levels)
    return found.select(
        *[pick("m", i, digits=4).alias(f"q{int(p * 100)}") for i, p in enumerate(levels)]
    )


def fixed_histogram(df: DataFrame, value: str | Column, width: float, by: Sequence[str]) -> DataFrame:
    """Counts per group and bin; a bin is named by its left edge."""
    edge = F.floor(as_column(value) / width) * F.lit(width)
    return df.groupBy(*by, edge.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_summary(df: DataFrame, value: str | Column, by: Sequence[str], digits: int = 4) -> DataFrame:
    """Minimum, quartiles and maximum per group."""
    names = ("low", "q1", "median", "q3", "high")
    found = grouped_quantiles(df, by, {"v": value}, [0.0, 0.25, 0.5, 0.75, 1.0])
    return found.select(
        *by, *[pick("v", i, digits=digits).alias(n) for i, n in enumerate(names)], F.col("v_n").alias("n")
    )


def band(value: Column, start: int = 10, step: int = 10, last: int = 100) -> Column:
    """Left-closed band number: 0 below ``start``, 1 from ``start``, ... up to the last break."""
    bands = (last - start) // step + 1
    number = F.floor((value - start) / step).cast("int") + 1
    return F.when(value.isNotNull(), F.greatest(F.least(number, F.lit(bands)), F.lit(0)))


def band_counts(df: DataFrame, value: Column, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by, band(value).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def median_frames(df: DataFrame, time: str | Column) -> DataFrame:
    """For every frame of a growing series: editions shown so far and the newest one's median."""
    found = grouped_quantiles(df, ["edition"], {"t": time}, [0.5])
    order = Window.partitionBy(F.lit(0)).orderBy("edition")  # one row per edition
    return found.select(
        "edition",
        F.row_number().over(order).alias("n_editions"),
        pick("t", digits=4).alias("median"),
    )
