"""Column names.

Operators use one set of names. A table of another layout is bound with :func:`bind`, which only
renames columns and therefore costs nothing in the plan.

======================  ==========================================================
edition                 one running of the event (a year)
entity                  who passes the checkpoints (bib, order, parcel)
checkpoint, cp          label ``AS_01`` and its number
place                   display name of the checkpoint
position                distance from the start, miles
arrive_text             clock reading ``HH:MM`` as recorded, likewise ``depart_text``
arrive_at               rebuilt absolute time (no zone), likewise ``depart_at``
arrive_hrs              elapsed **decimal hours** since the start, likewise ``depart_hrs``
arrive_elapsed          the same as ``HH:MM:SS`` text, likewise ``depart_elapsed``
stop_min, leg_min       minutes
======================  ==========================================================
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

# Names of the recorded race sheets. The columns ending in ``elapsed__min`` hold
# decimal hours in spite of their name.
RACE_SHEET: dict[str, str] = {
    "year": "edition",
    "bib": "entity",
    "as_index": "checkpoint",
    "as_num": "cp",
    "as_name": "place",
    "as_dist_from_start": "position",
    "as_dist_incr": "position_step",
    "as_check_in__tod": "arrive_text",
    "as_check_out__tod": "depart_text",
    "as_check_in__elapsed": "arrive_elapsed",
    "as_check_out__elapsed": "depart_elapsed",
    "as_check_in__tod__datetime": "arrive_at",
    "as_check_out__tod__datetime": "depart_at",
    "as_check_in__elapsed__min": "arrive_hrs",
    "as_check_out__elapsed__min": "depart_hrs",
    "race_datetime": "start_text",
    "MaxAS": "furthest",
    "FinishRank": "finish_rank",
    "OverallRank": "overall_rank",
    "MaxTime": "max_hrs",
    "as_rank": "station_rank",
    "finish_time": "finish_text",
    "finish_elapsed_hrs": "finish_hrs",
    "finish_elapsed_mins": "finish_min",
    "OriginalOrder": "original_order",
    "as_stoppage_time_min": "stop_min",
    "check_in_imputed": "arrive_imputed",
    "check_out_imputed": "depart_imputed",
    "stoppage_imputed": "stop_imputed",
    "interval_dist_mi": "leg_mi",
    "interval_time_min": "leg_min",
    "as_interval_pace": "leg_pace",
    "as_interval_pace_ratio": "leg_ratio",
    "overall_pace_min_per_mi": "overall_pace",
    "spans_missing_as": "spans_missing",
}

RACE_WIDE: dict[str, str] = {
    "year": "edition",
    "bib_number": "entity",
    "OriginalOrder": "original_order",
    "MaxTime": "max_hrs",
    "OverallRank": "overall_rank",
    "MaxAS": "furthest",
    "FinishRank": "finish_rank",
}

RACE_META: dict[str, str] = {
    "race_year": "edition",
    "race_date": "start_date",
    "race_time_start": "start_clock",
}

RACE_STATIONS: dict[str, str] = {
    "year": "edition",
    "as_index": "checkpoint",
    "as_name": "place",
    "dist_from_start": "position",
    "as_dist": "position_step",
    "flag_finish": "is_finish",
}

RACE_RESULTS: dict[str, str] = {
    "race_year": "edition",
    "bib": "entity",
    "finish_time": "finish_text",
    "finish_elapsed_hrs": "finish_hrs",
    "finish_elapsed_mins": "finish_min",
}


def bind(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename the columns of ``df`` that occur in ``names``; others are kept."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def unbind(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Undo :func:`bind`."""
    return df.withColumnsRenamed({b: a for a, b in names.items() if b in df.columns})
