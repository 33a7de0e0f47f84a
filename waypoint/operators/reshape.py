"""Wide sheets to one row per entity and checkpoint, and stacking of layouts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waypoint.functions.numbers import checkpoint_label

# Suffixes of the wide sheet and what they hold.
WIDE_SUFFIXES: dict[str, str] = {
    "arr_tod": "arrive_text",
    "dep_tod": "depart_text",
    "arr_rank": "recorded_rank",
}


def wide_to_long(
    df: DataFrame, suffixes: Mapping[str, str] = WIDE_SUFFIXES, keep_empty: bool = False
) -> DataFrame:
    """Columns ``as07_arr_tod``, ``as07_dep_tod``, ... become rows with ``checkpoint = AS_07``.

    One pass: each input row is exploded into an array of checkpoint structs, so there is neither a
    join nor a shuffle. A checkpoint lacking one of the columns gets nulls there; columns with any
    other suffix (``as01_arr_rank2``) are dropped. Rows with neither time are dropped.
    """
    pattern = re.compile(r"^as(\d+)_(" + "|".join(map(re.escape, suffixes)) + r")$")
    found: dict[str, dict[str, str]] = {}
    for column in df.columns:
        hit = pattern.match(column)
        if hit:
            found.setdefault(hit.group(1), {})[hit.group(2)] = column
    carried = [c for c in df.columns if not re.match(r"^as\d+_", c)]

    def cell(columns: Mapping[str, str], suffix: str) -> Column:
        if suffix in columns:
            return F.col(columns[suffix]).cast("string")
        return F.lit(None).cast("string")

    stations = [
        F.struct(
            F.lit(f"AS_{number}").alias("checkpoint"),
            F.lit(int(number)).alias("cp"),
            *[cell(columns, s).alias(name) for s, name in suffixes.items()],
        )
        for number, columns in sorted(found.items())
    ]
    long = df.select(*carried, F.inline(F.array(*stations)))
    if keep_empty:
        return long
    return long.where(F.col("arrive_text").isNotNull() | F.col("depart_text").isNotNull())


def spread(
    df: DataFrame, keys: Sequence[str], label: str, labels: Sequence, value: Column, fill=None
) -> DataFrame:
    """Long to wide: one column per entry of ``labels``; ``fill`` replaces missing cells."""
    wide = df.groupBy(*keys).pivot(label, list(labels)).agg(value)
    return wide if fill is None else wide.na.fill(fill, [str(x) for x in labels])


def select_existing(df: DataFrame, ordered: Sequence[str]) -> DataFrame:
    """The columns of ``ordered`` that ``df`` has, in that order."""
    return df.select(*[c for c in ordered if c in df.columns])


def require_columns(df: DataFrame, needed: Sequence[str]) -> DataFrame:
    """``df`` itself, or an error naming the missing columns."""
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


# Types two differently typed layouts are brought to before they are stacked.
STACK_TYPES: dict[str, str] = {
    **dict.fromkeys(
        ["arrive_hrs", "depart_hrs", "position", "position_step", "finish_hrs", "finish_min", "age"],
        "double",
    ),
    **dict.fromkeys(["edition", "entity", "overall_rank", "station_rank", "official_rank"], "long"),
}


def combine_editions(
    *parts: DataFrame, types: Mapping[str, str] = STACK_TYPES
) -> DataFrame:
    """Stack by name; missing columns become null and values that do not fit a type become null."""

    def typed(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns}
        )

    result = typed(parts[0])
    for part in parts[1:]:
        result = result.unionByName(typed(part), allowMissingColumns=True)
    return result


def lay_out_stations(editions: DataFrame, count: int, spacing: float) -> DataFrame:
    """A regular station table: ``count`` checkpoints ``spacing`` miles apart in every edition."""
    numbers = F.sequence(F.lit(1), F.lit(count))
    return editions.select("edition", F.explode(numbers).alias("cp")).select(
        "edition",
        checkpoint_label(F.col("cp")).alias("checkpoint"),
        "cp",
        F.concat(F.lit("Stop "), F.col("cp").cast("string")).alias("place"),
        (F.col("cp") * F.lit(spacing)).alias("position"),
        F.lit(float(spacing)).alias("position_step"),
        (F.col("cp") == count).alias("is_finish"),
    )


def null_column(kind: str | T.DataType) -> Column:
    return F.lit(None).cast(kind)
