"""Exact, linearly interpolated quantiles of groups of any size, by bracketed selection.

The first pass counts values by bins whose width is a fixed share of the value, at most some thousand
per group and metric, and combines these counts map-side. The counts say exactly which bin holds each
order statistic wanted and how many values lie below it, so a bin always encloses its rank. The second
pass keeps only the values inside these bins. A bin that still holds many values is cut into finer
ones first, by passes that keep its values alone. Neither a group nor a metric is ever sorted, buffered
or written as a whole, and all metrics of one call share the passes.

The two neighbours of a quantile are weighted as ``percentile`` does, so results agree with it in every
bit.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waypoint.functions.numbers import as_column, rounded
from waypoint.operators.joins import match_null_safe
from waypoint.session import written

#: Bins per doubling of the value in the first pass, and parts of a bin in each further one.
PER_DOUBLING, PARTS = 256, 1024
#: Values that a bin may hold when its values are looked at one by one.
MAX_INSIDE = 50_000
_LEAST, _MOST = -1074, 1023  # powers of two of a double
_ENDS = ["_lo", "_hi", "_n", "_below", "_total"]


def grouped_quantiles(
    df: DataFrame,
    group: Sequence[str],
    metrics: Mapping[str, Column | str],
    probabilities: Sequence[float] | Mapping[str, Sequence[float]],
    *,
    max_inside: int = MAX_INSIDE,
) -> DataFrame:
    """One row per group: ``<metric>_q`` (array of quantiles) and ``<metric>_n`` (non-null count).

    Nulls of a metric are left out. A group none of whose metrics has a value is absent; a metric
    without values in a present group has a null array and a count of 0. ``df`` is passed over twice
    or more, so a table that is dear to compute should be written first.
    """
    wanted = {
        m: [float(p) for p in (probabilities[m] if isinstance(probabilities, Mapping) else probabilities)]
        for m in metrics
    }
    values = [as_column(c).cast("double") for c in metrics.values()]
    rows = df.select(*group, F.array(*values).alias("_values"))
    bins = _brackets(rows, group, lambda: _ranks(wanted), max_inside)
    return _picked(rows, group, wanted, bins)


def order_statistics(df: DataFrame, metrics: Sequence[str], levels: Sequence[float]) -> dict[str, list[float]]:
    """Per column the values at ranks ``ceil(level * n)`` of its ``n`` values that are not null, uninterpolated.

    The distinct ones, at most one per level, come to the driver. ``df`` is passed over twice or more.
    """
    listed = F.array(*[F.lit(float(p)) for p in levels])

    def ranks() -> Column:
        return F.transform(listed, lambda p: F.greatest(F.ceil(p * F.col("_total")), F.lit(1)) - 1)

    rows = df.select(F.array(*[F.col(c).cast("double") for c in metrics]).alias("_values"))
    counted = _counted(rows, [], _brackets(rows, [], ranks, MAX_INSIDE))
    wanted = F.exists(ranks(), lambda r: _holds(r, F.col("_start"), F.col("_n")))
    found: dict[str, list[float]] = {c: [] for c in metrics}
    for r in counted.where(wanted).select("_m", "_v").collect():
        found[metrics[r["_m"]]].append(r["_v"])
    return found


def smallest(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    share: float,
    *,
    max_inside: int = MAX_INSIDE,
) -> DataFrame:
    """The first ``share`` of each group's rows by ``order``, rounded up, as ranks would give them.

    The cut-off is the value of the first order column at the last rank wanted, found by bracketed
    selection; rows below it are kept by one filter. Only rows that hold the cut-off value itself are
    ordered by the other columns, so the first one should be a number that few rows share, such as a
    hash. No row is sorted or written otherwise. Rows without a first value go.
    """
    first = as_column(order[0]).cast("double")
    rows = df.select(*group, F.array(first).alias("_values"))
    last = F.ceil(F.col("_total") * F.lit(float(share)))
    bins = _brackets(rows, group, lambda: F.array(last - 1), max_inside)
    found = _counted(rows, group, bins).where(_holds(last - 1, F.col("_start"), F.col("_n")))
    cut = found.select(*group, F.col("_v").alias("_cut"), (last - F.col("_start")).alias("_ties"))
    near = match_null_safe(df.withColumn("_first", first), written(cut, "cut-off"), group)
    below = near.where("_first < _cut").select(*df.columns)
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*[as_column(c) for c in order[1:]] or ["_first"]))
    ties = near.where("_first = _cut").withColumn("_place", place).where("_place <= _ties")
    return below.unionByName(ties.select(*df.columns))


def _brackets(
    rows: DataFrame, group: Sequence[str], ranks: Callable[[], Column], max_inside: int
) -> DataFrame:
    """Bins that hold the ranks wanted, none with more than ``max_inside`` values unless they are equal."""
    bins = written(_first_bins(rows, group, ranks), "brackets")
    while _fullest(bins) > max_inside:
        bins = written(_finer_bins(rows, group, ranks, bins), "brackets")
    return bins


def _fullest(bins: DataFrame) -> int:
    return bins.where("_lo < _hi").agg(F.max("_n")).first()[0] or 0


def _bin(v: Column) -> Column:
    """Number of the bin of a value; never falls where values rise, whatever ``log2`` rounds to."""
    size = F.abs(v)
    power = F.least(F.greatest(F.floor(F.log2(size)), F.lit(_LEAST)), F.lit(_MOST))
    part = F.floor((size / F.pow(F.lit(2.0), power) - 1) * PER_DOUBLING)
    number = (power - _LEAST + 1) * PER_DOUBLING + part
    infinite = size == F.lit(float("inf"))
    far = F.lit((_MOST - _LEAST + 3) * PER_DOUBLING).cast("long")
    number = F.when(F.isnan(v), far + 1).when(infinite, far).when(size == 0, 0).otherwise(number)
    return F.when(v < 0, -number).otherwise(number)


def _ranks(wanted: Mapping[str, list[float]]) -> Column:
    """Ranks from 0 that the quantiles of metric ``_m`` lie between, of ``_total`` values."""
    spots = F.transform(_levels(wanted), lambda p: p * (F.col("_total") - 1))
    return F.concat(F.transform(spots, lambda s: F.floor(s)), F.transform(spots, lambda s: F.ceil(s)))


def _levels(wanted: Mapping[str, list[float]]) -> Column:
    listed = F.array(*[F.array(*[F.lit(p) for p in ps]) for ps in wanted.values()])
    return F.element_at(listed, F.col("_m") + 1)


def _holding(bins: DataFrame, ranks: Callable[[], Column]) -> DataFrame:
    inside = F.exists(ranks(), lambda r: _holds(r, F.col("_below"), F.col("_n")))
    return bins.where(inside)


def _holds(rank: Column, start: Column, size: Column) -> Column:
    return (rank >= start) & (rank < start + size)


def _counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]


def _first_bins(rows: DataFrame, group: Sequence[str], ranks: Callable[[], Column]) -> DataFrame:
    counted = _cells(rows, group).groupBy(*group, "_m", "_bin").agg(*_counts())
    own = Window.partitionBy(*group, "_m")
    below = own.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumns(
        {"_below": F.coalesce(F.sum("_n").over(below), F.lit(0)), "_total": F.sum("_n").over(own)}
    )
    return _holding(placed, ranks).select(*group, "_m", "_bin", *_ENDS)


def _cells(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """One row per value that is not null, with its metric and the number of its first bin."""
    cells = rows.select(*group, F.posexplode("_values").alias("_m", "_v")).where("_v is not null")
    return cells.withColumn("_bin", _bin(F.col("_v")))


def _values_inside(rows: DataFrame, group: Sequence[str], bins: DataFrame) -> DataFrame:
    """Values that lie in one of the bins, with the ends of that bin.

    A value looks up the bins cut from its first one, instead of going through all bins of its group.
    """
    keys = [*group, "_m", "_bin"]
    known = bins.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *_ENDS)
    same = (F.col("_m") == F.col("_r__m")) & (F.col("_bin") == F.col("_r__bin"))
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_r_{g}"))
    inside = F.col("_v").between(F.col("_lo"), F.col("_hi"))
    return _cells(rows, group).join(known, same & inside).select(*keys, "_v", *_ENDS)


def _finer_bins(
    rows: DataFrame, group: Sequence[str], ranks: Callable[[], Column], bins: DataFrame
) -> DataFrame:
    done = bins.where("_lo = _hi")
    open_bins = bins.where("_lo < _hi")
    part = F.floor((F.col("_v") - F.col("_from")) / (F.col("_to") - F.col("_from")) * PARTS)
    cells = _values_inside(rows, group, open_bins).withColumnsRenamed(
        {"_lo": "_from", "_hi": "_to", "_n": "_all", "_below": "_base"}
    )
    counted = cells.groupBy(*group, "_m", "_bin", "_from", "_base", "_total", part.alias("_part")).agg(*_counts())
    below = (
        Window.partitionBy(*group, "_m", "_from")
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = counted.withColumn("_below", F.col("_base") + F.coalesce(F.sum("_n").over(below), F.lit(0)))
    return _holding(placed, ranks).select(*group, "_m", "_bin", *_ENDS).unionByName(done)


def _counted(rows: DataFrame, group: Sequence[str], bins: DataFrame) -> DataFrame:
    """Values in the bins with their count ``_n`` and ``_start``, the number of smaller ones in the group."""
    keys = [*group, "_m"]
    inside = _values_inside(rows, group, bins.where("_lo < _hi"))
    single = bins.where("_lo = _hi").select(*keys, F.col("_lo").alias("_v"), "_lo", "_below", "_total", "_n")
    counted = inside.groupBy(*keys, "_v", "_lo", "_below", "_total").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys, "_lo").orderBy("_v")
    start = F.sum("_n").over(upto) + F.col("_below") - F.col("_n")
    return counted.unionByName(single).withColumn("_start", start)


def _picked(
    rows: DataFrame, group: Sequence[str], wanted: Mapping[str, list[float]], bins: DataFrame
) -> DataFrame:
    keys = [*group, "_m"]
    start, size = F.col("_start"), F.col("_n")
    low, high = F.floor("_spot"), F.ceil("_spot")

    def at(rank: Column) -> Column:
        return F.max(F.when(_holds(rank, start, size), F.col("_v")))

    stats = (
        _counted(rows, group, bins)
        .select(*keys, "_v", "_n", "_start", "_total", F.posexplode(_levels(wanted)).alias("_qi", "_p"))
        .withColumn("_spot", F.col("_p") * (F.col("_total") - 1))
        .where(_holds(low, start, size) | _holds(high, start, size))
        .groupBy(*keys, "_qi", "_spot", "_total")
        .agg(at(low).alias("_under"), at(high).alias("_over"))
        .withColumn(
            "_q",
            F.when((low == high) | (F.col("_under") == F.col("_over")), F.col("_under")).otherwise(
                (high - F.col("_spot")) * F.col("_under") + (F.col("_spot") - low) * F.col("_over")
            ),
        )
    )
    outputs: list[Column] = []
    for i, (m, ps) in enumerate(wanted.items()):
        mine = F.col("_m") == i
        qs = [F.max(F.when(mine & (F.col("_qi") == k), F.col("_q"))) for k in range(len(ps))]
        n = F.coalesce(F.max(F.when(mine, F.col("_total"))), F.lit(0)).cast("long")
        outputs += [F.when(n > 0, F.array(*qs)).alias(f"{m}_q"), n.alias(f"{m}_n")]
    return stats.groupBy(*group).agg(*outputs)


def pick(metric: str, index: int = 0, *, floor: int = 1, digits: int | None = None) -> Column:
    """Quantile number ``index`` of a metric, null in groups smaller than ``floor``."""
    value = F.when(F.col(f"{metric}_n") >= floor, F.try_element_at(f"{metric}_q", F.lit(index + 1)))
    return value if digits is None else rounded(value, digits)
