"""Schemas of the recorded files, checked on read instead of inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"s": T.StringType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType()}


def _schema(**fields: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[k]) for n, k in fields.items()])


# Column names of the recorded files.
EDITIONS = _schema(
    race_name="s", race_year="l", race_distance="d", race_date="s", race_time_start="s"
)
STATIONS = _schema(
    year="l",
    as_name="s",
    dist_from_start="d",
    as_dist="d",
    year_as_index="s",
    race_name="s",
    as_index="s",
    flag_finish="b",
)
RESULTS = _schema(
    race_year="l",
    bib="l",
    name="s",
    gender="s",
    age="l",
    city="s",
    official_rank="l",
    finish_time="s",
    finish_elapsed_hrs="d",
    finish_elapsed_mins="d",
)
LONG_HISTORY = _schema(
    year="l",
    bib="l",
    as_index="s",
    as_name="s",
    as_check_in__tod="s",
    as_check_out__tod="s",
    as_check_in__elapsed="s",
    as_check_out__elapsed="s",
    as_check_in__tod__datetime="s",
    race_datetime="s",
    as_check_in__elapsed__min="d",
    as_dist_from_start="d",
    as_dist_incr="d",
)

# Columns of a wide sheet that are not text.
WIDE_TYPED = {"year": "l", "OriginalOrder": "l", "MaxTime": "d", "OverallRank": "l"}


def wide_sheet(stations: int = 17) -> T.StructType:
    """Wide sheet: all text but :data:`WIDE_TYPED`. The last station has no departure."""
    fields = dict(
        year="l", bib_number="s", OriginalOrder="l", MaxTime="d", OverallRank="l",
        MaxAS="s", FinishRank="s",
    )
    for i in range(1, stations + 1):
        fields[f"as{i:02d}_arr_tod"] = "s"
        if i < stations:
            fields[f"as{i:02d}_dep_tod"] = "s"
        fields[f"as{i:02d}_arr_rank"] = "s"
    fields["as01_arr_rank2"] = "s"
    return _schema(**fields)
