"""Order-dependent operators that stay distributed when one group holds most of the rows.

``row_number().over(Window.partitionBy(edition)...)`` puts a whole edition into one task. Here the
table is sorted once (range partitioned by group **and** order columns, so a large group spans many
slices), materialised in the shared checkpoint folder, and every slice is numbered on its own. Only
the per-slice totals, at most one row per group and slice, are combined in a window.

Rows that agree in every order column share a slice; give a unique last order column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waypoint.functions.numbers import as_column
from waypoint.operators.joins import match_null_safe
from waypoint.session import written

ROW = "_row"
SLICE = "_slice"
_ROW_BITS = 33  # layout of monotonically_increasing_id: partition above, row number below


def ordered_slices(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column]
) -> DataFrame:
    """``df`` sorted by group and order and written, with a row id and a slice id."""
    keys = [F.col(g) for g in group] + [as_column(o) for o in order]
    placed = df.orderBy(*keys).withColumn(ROW, F.monotonically_increasing_id())
    return written(placed, "ordered").withColumn(SLICE, F.shiftright(ROW, _ROW_BITS))


def slice_offsets(
    slices: DataFrame, group: Sequence[str], amount: Column, extra: Sequence[Column] = ()
) -> DataFrame:
    """Per group and slice: the amount in earlier slices of the group and in the whole group."""
    totals = slices.groupBy(*group, SLICE).agg(amount.alias("_in_slice"), *extra)
    earlier = Window.partitionBy(*group).orderBy(SLICE)
    return totals.withColumns(
        {
            "_before": F.coalesce(
                F.sum("_in_slice").over(earlier.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
            "_in_group": F.sum("_in_slice").over(Window.partitionBy(*group)),
        }
    )


def ordinal_rank(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    name: str,
    size: str | None = None,
) -> DataFrame:
    """1-based rank inside ``group`` by ``order``, as ``row_number`` would give it.

    ``size`` names a column for the number of rows of the group, which is known on the way.
    """
    columns = df.columns
    slices = ordered_slices(df, group, order)
    starts = slice_offsets(slices, group, F.count(F.lit(1)), [F.min(ROW).alias("_first")])
    ranked = match_null_safe(slices, starts.drop("_in_slice"), [*group, SLICE])
    rank = (F.col(ROW) - F.col("_first") + F.col("_before") + 1).cast("long")
    sizes = [F.col("_in_group").alias(size)] if size else []
    return ranked.select(*columns, rank.alias(name), *sizes)


def running_sum(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], value: Column, name: str
) -> DataFrame:
    """Sum of ``value`` from the first row of the group to this one."""
    columns = df.columns
    slices = ordered_slices(df.withColumn("_value", value), group, order)
    starts = slice_offsets(slices, group, F.sum("_value"))
    in_slice = Window.partitionBy(*group, SLICE).orderBy(ROW)
    summed = slices.withColumn("_running", F.sum("_value").over(in_slice))
    joined = match_null_safe(summed, starts.drop("_in_slice", "_in_group"), [*group, SLICE])
    return joined.select(*columns, (F.col("_running") + F.col("_before")).alias(name))


def with_previous(
    slices: DataFrame, group: Sequence[str], columns: Sequence[str], prefix: str = "prev_"
) -> DataFrame:
    """Value of the preceding row of the group, across slice borders; needs ``ordered_slices``."""
    in_slice = Window.partitionBy(*group, SLICE).orderBy(ROW)
    last = slices.groupBy(*group, SLICE).agg(
        F.max_by(F.struct(*columns), ROW).alias("_last"), F.min(ROW).alias("_first")
    )
    carry = last.select(
        *group,
        SLICE,
        "_first",
        F.lag("_last").over(Window.partitionBy(*group).orderBy(SLICE)).alias("_carry"),
    )
    joined = match_null_safe(
        slices.withColumn("_prev", F.lag(F.struct(*columns)).over(in_slice)), carry, [*group, SLICE]
    )
    at_border = F.col(ROW) == F.col("_first")
    return joined.withColumns(
        {
            f"{prefix}{c}": F.when(at_border, F.col(f"_carry.{c}")).otherwise(F.col(f"_prev.{c}"))
            for c in columns
        }
    ).drop("_prev", "_carry", "_first")


def nearest_on_axis(
    keys: DataFrame,
    candidates: DataFrame,
    *,
    key_at: str,
    candidate_at: str,
    candidate_id: str,
) -> DataFrame:
    """For each distinct key position the nearest candidate; on equal distance the lower id.

    Keys and candidates are reduced to distinct positions and laid out on one sorted axis. The
    nearest candidate is the last one at or below the key or the first one above it, so each row
    looks at two neighbours and no pairs are formed. Returns ``key_at``, ``candidate_id``,
    ``candidate_at``; keys without any candidate are absent.
    """
    at_key = keys.select(F.col(key_at).cast("double").alias("_at")).where("_at is not null")
    at_candidate = candidates.where(F.col(candidate_at).isNotNull()).select(
        F.col(candidate_at).cast("double").alias("_at"), F.col(candidate_id).alias("_id")
    )
    axis = (
        at_key.select("_at", F.lit(True).alias("_is_key"), F.lit(None).alias("_id"))
        .unionByName(at_candidate.select("_at", F.lit(False).alias("_is_key"), "_id"))
        .groupBy("_at")
        .agg(F.max("_is_key").alias("_is_key"), F.min("_id").alias("_id"))
    )
    slices = ordered_slices(axis, [], ["_at"]).withColumn(
        "_hit", F.when(F.col("_id").isNotNull(), F.struct("_at", "_id"))
    )
    per_slice = slices.groupBy(SLICE).agg(
        F.max_by("_hit", F.when(F.col("_hit").isNotNull(), F.col(ROW))).alias("_last_hit"),
        F.min_by("_hit", F.when(F.col("_hit").isNotNull(), F.col(ROW))).alias("_first_hit"),
    )
    # One row per slice of the sort, so these two windows see as many rows as the sort had tasks.
    up = Window.partitionBy(F.lit(0)).orderBy(SLICE)
    down = Window.partitionBy(F.lit(0)).orderBy(F.col(SLICE).desc())
    borders = per_slice.select(
        SLICE,
        F.last("_last_hit", True).over(up.rowsBetween(Window.unboundedPreceding, -1)).alias("_lo0"),
        F.last("_first_hit", True)
        .over(down.rowsBetween(Window.unboundedPreceding, -1))
        .alias("_hi0"),
    )
    # ``last`` over a descending window instead of ``first`` over the rows that follow: Spark
    # evaluates frames that end at UNBOUNDED FOLLOWING anew for every row.
    in_slice_up = Window.partitionBy(SLICE).orderBy(ROW)
    in_slice_down = Window.partitionBy(SLICE).orderBy(F.col(ROW).desc())
    neighbours = (
        slices.withColumn("_lo", F.last("_hit", True).over(in_slice_up))
        .withColumn("_hi", F.last("_hit", True).over(in_slice_down))
        .where("_is_key")
        .join(borders, SLICE)
        .select(
            "_at",
            F.coalesce("_lo", "_lo0").alias("_lo"),
            F.coalesce("_hi", "_hi0").alias("_hi"),
        )
    )
    gap_lo = F.col("_at") - F.col("_lo._at")
    gap_hi = F.col("_hi._at") - F.col("_at")
    take_lo = (
        F.col("_hi").isNull()
        | (gap_lo < gap_hi)
        | ((gap_lo == gap_hi) & (F.col("_lo._id") <= F.col("_hi._id")))
    )
    best = F.when(F.col("_lo").isNotNull() & take_lo, F.col("_lo")).otherwise(F.col("_hi"))
    return (
        neighbours.withColumn("_best", best)
        .where(F.col("_best").isNotNull())
        .select(
            F.col("_at").alias(key_at),
            F.col("_best._id").alias(candidate_id),
            F.col("_best._at").alias(candidate_at),
        )
    )
