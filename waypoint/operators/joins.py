"""Join helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypoint.session import written


def match_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner equi-join on keys that may be null; keeps one copy of the keys."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, condition, "inner").drop(*[f"_r_{k}" for k in keys])


def join_checked(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join with a side expected to be small; Spark broadcasts it if its size in bytes allows.

    Keys such as the edition or the checkpoint take few values, so shuffling the large side by them
    would leave most tasks idle, and Spark cannot know the size of a derived table beforehand. The
    small side is computed once and written, which gives it a known size: up to
    ``spark.sql.autoBroadcastJoinThreshold`` it is broadcast, beyond that the join is a sort-merge one
    whose skewed partitions adaptive execution splits. Nothing is counted.
    """
    return left.join(written(right, "side"), list(keys), how)
