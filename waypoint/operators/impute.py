"""Model features and filling of one-sided times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypoint.functions.numbers import clamp, gender_code, ratio
from waypoint.operators.clock import of_entity
from waypoint.operators.intervals import Course
from waypoint.operators.joins import join_checked
from waypoint.operators.runners import NOT_FINISHED

PREDICTED = "predicted_stop_min"
MIN_STOP_MIN, MAX_STOP_MIN = 0.0, 120.0  # fixed values


def stop_features(df: DataFrame, course: Course = Course(), ranked: bool = True) -> DataFrame:
    """Feature columns of the stop and arrival models, and the observed stop in minutes.

    ``ranked=False`` leaves out ``overall_rank_pct`` for inputs without an overall rank.
    """
    out = df.withColumns(
        {
            "is_finisher": (F.col("finish_rank") != NOT_FINISHED).cast("int"),
            "age": F.col("age").try_cast("double"),
            "gender_code": gender_code("gender"),
            "elapsed_hrs": F.coalesce("arrive_hrs", "depart_hrs"),
            "stop_min": (F.col("depart_hrs") - F.col("arrive_hrs")) * 60,
        }
    )
    furthest = F.max("position").over(of_entity())
    out = out.withColumn(
        "overall_pace",
        F.when(
            F.col("is_finisher") == 1, F.col("max_hrs") * 60 / F.lit(course.length_mi)
        ).otherwise(ratio(F.col("max_hrs") * 60, furthest)),
    )
    if not ranked:
        return out
    if "edition_size" not in out.columns:
        # An edition has no bound on its rows: aggregate and join instead of a window over it.
        last = df.groupBy("edition").agg(F.max("overall_rank").alias("edition_size"))
        out = join_checked(out, last, ["edition"])
    return out.withColumn(
        "overall_rank_pct", ratio(F.col("overall_rank"), F.col("edition_size"))
    )


def impute_times(
    features: DataFrame,
    predict: Callable[[DataFrame], DataFrame],
    course: Course = Course(),
    *,
    flag_ends_course: bool = False,
) -> DataFrame:
    """Fill a missing arrival or departure from the predicted stop.

    ``predict`` adds ``predicted_stop_min`` to a table of features. Rows before the finish cutoff
    get a departure; with ``flag_ends_course`` a row flagged ``is_finish`` gets none either.
    """
    arrive, depart, stop = F.col("arrive_hrs"), F.col("depart_hrs"), F.col("_stop")
    order = of_entity().orderBy("cp")
    wants_departure = depart.isNull() & arrive.isNotNull() & (
        F.col("position") < course.finish_cutoff_mi
    )
    if flag_ends_course:
        wants_departure = wants_departure & ~F.coalesce(F.col("is_finish"), F.lit(False))
    flagged = predict(features).withColumns(
        {
            "arrive_imputed": F.coalesce(arrive.isNull() & depart.isNotNull(), F.lit(False)),
            "depart_imputed": F.coalesce(wants_departure, F.lit(False)),
            "_previous": F.coalesce(F.lag(F.coalesce(arrive, depart)).over(order), F.lit(0.0)),
            "_stop": clamp(F.col(PREDICTED), F.lit(MIN_STOP_MIN), F.lit(MAX_STOP_MIN)),
        }
    )
    in_filled, out_filled = F.col("arrive_imputed"), F.col("depart_imputed")
    return flagged.withColumns(
        {
            "arrive_hrs": F.when(
                in_filled, clamp(depart - stop / 60, F.col("_previous"), depart)
            ).otherwise(arrive),
            "depart_hrs": F.when(out_filled, arrive + stop / 60).otherwise(depart),
            "stop_min": F.when(in_filled | out_filled, stop).otherwise(F.col("stop_min")),
            "stop_imputed": in_filled | out_filled,
        }
    ).drop("_previous", "_stop", PREDICTED)
