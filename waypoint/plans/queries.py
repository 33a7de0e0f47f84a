"""The operators applied to the given tables, one query each.

Every query runs over whole tables. Real numbers are rounded at the very end only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waypoint.functions.clock import clock_label, lenient_timestamp, minutes_of_text
from waypoint.functions.numbers import rounded
from waypoint import schemas
from waypoint.naming import RACE_META, RACE_RESULTS, bind, unbind
from waypoint.operators import (
    boosting,
    clock,
    course,
    explore,
    finishers,
    impute,
    model,
    pacing,
    quality,
    report,
    reshape,
    runners,
)
from waypoint.plans import passages as p
from waypoint.plans import runs
from waypoint.session import scratch_path, scratch_scope
from waypoint.sources import gpx, tables
from waypoint.sources.buckets import Buckets

HISTORY_UNTIL = 1997
HOLDOUT = 1998
TRIAL = model.Training(holdout_edition=HOLDOUT)
ARRIVAL_TRIAL = model.Training(
    features=list(model.ARRIVAL_FEATURES),
    target="elapsed_hrs",
    holdout_edition=HOLDOUT,
)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _out(df: DataFrame, columns: Sequence[str], **digits: int) -> DataFrame:
    """Chosen columns; the named ones rounded, times as text."""
    kinds = dict(df.dtypes)
    return df.select(
        *[
            rounded(c, digits[c]).alias(c)
            if c in digits
            else F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
            if kinds[c].startswith("timestamp")
            else F.col(c)
            for c in columns
        ]
    )


KEY = ["edition", "entity", "checkpoint"]


# ---- shaping and clock -------------------------------------------------------------------------


@query
def wide_to_long(spark, sf):
    long = reshape.wide_to_long(p.wide_sheet(spark, sf))
    return long.select(*KEY, "cp", "arrive_text", "depart_text", "recorded_rank")


@query
def sanitize_times(spark, sf):
    return p.clean(spark, sf).select(*KEY, "cp", "arrive_text", "depart_text")


@query
def attach_edition_station(spark, sf):
    columns = [*KEY, "start_text", "start_at", "place", "position", "position_step", "is_finish"]
    return _out(p.placed(spark, sf), columns)


@query
def rebuild_clock(spark, sf):
    df = clock.rebuild_clock(p.placed(spark, sf))
    return _out(df, [*KEY, "arrive_at", "arrive_hrs", "arrive_elapsed"], arrive_hrs=6)


@query
def rebuild_departures(spark, sf):
    columns = [*KEY, "depart_at", "depart_hrs", "depart_elapsed"]
    return _out(p.rebuilt(spark, sf), columns, depart_hrs=6)


@query
def attach_results(spark, sf):
    df = runners.attach_results(p.rebuilt(spark, sf), p.results(spark, sf))
    columns = [*KEY, "name", "gender", "age", "official_rank", "finish_hrs", "finish_min"]
    return _out(df, columns, finish_hrs=6, finish_min=4)


@query
def repeated_results(spark, sf):
    """Line items as a result list: keys that occur more than once."""
    orders = p.table(spark, sf, "lineitem").select(
        F.year("l_shipdate").cast("long").alias("edition"), F.col("l_orderkey").alias("entity")
    )
    return runners.repeated_results(orders)


@query
def runner_summary(spark, sf):
    columns = ["edition", "entity", "finish_rank", "furthest", "max_hrs", "overall_rank", "edition_size"]
    return _out(runners.runner_summary(p.splits(spark, sf)), columns, max_hrs=6)


@query
def station_rank(spark, sf):
    return runners.station_ranks(p.rebuilt(spark, sf))


def _history(spark: SparkSession, sf: str) -> DataFrame:
    """Early editions as a long file with elapsed times: slashed dates, no departures."""
    rows = p.rebuilt(spark, sf).where(F.col("edition") <= HISTORY_UNTIL)
    late = F.when(F.col("cp") == 5, F.lit("unknown"))
    return rows.select(
        "edition",
        "entity",
        "checkpoint",
        "place",
        "arrive_text",
        "arrive_elapsed",
        F.coalesce(late, F.date_format("arrive_at", "M/d/yy HH:mm")).alias("arrive_at"),
        F.date_format("start_at", "M/d/yy HH:mm").alias("start_text"),
        "arrive_hrs",
        "position",
        "position_step",
        F.lit("as recorded").alias("name"),
        F.lit(None).cast("string").alias("time_check"),
    )


@query
def clean_long_history(spark, sf):
    df = runners.clean_long_history(
        tables.drop_blank_records(_history(spark, sf), "edition"),
        p.stations(spark, sf),
        p.results(spark, sf),
    )
    columns = [*KEY, "cp", "name", "start_text", "arrive_at", "arrive_hrs", "finish_rank", "furthest", "max_hrs"]
    df = runners.with_history_ranks(p.stored(df.select(*columns, "max_position"), "history"))
    return _out(df, [*columns, "overall_rank", "edition_size", "station_rank"], arrive_hrs=6, max_hrs=6)


@query
def history_station_rank(spark, sf):
    """Arrival order of the early editions, by elapsed time with missing arrivals first."""
    return runners.station_ranks(_history(spark, sf), by="arrive_hrs", nulls_first=True)


@query
def combine_editions(spark, sf):
    early = runners.clean_long_history(
        _history(spark, sf), p.stations(spark, sf), p.results(spark, sf)
    )
    late = p.splits(spark, sf).where(F.col("edition") > HISTORY_UNTIL)
    df = reshape.combine_editions(early.drop("depart_hrs"), late.drop("original_order"))
    columns = [*KEY, "age", "arrive_hrs", "depart_hrs", "finish_rank", "max_hrs", "original_order"]
    return _out(df, columns, arrive_hrs=6, depart_hrs=6, max_hrs=6)


@query
def trace_series(spark, sf):
    df = explore.trace_series(p.splits(spark, sf))
    columns = ["edition", "entity", "label", "point", "checkpoint", "place", "position"]
    return _out(
        df, [*columns, "elapsed_hrs", "clock_text", "elapsed_text", "passed_at"], elapsed_hrs=6
    )


# ---- course ------------------------------------------------------------------------------------


def _vertices(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    return p.table(spark, sf, "part").select(
        F.col("p_size").cast("long").alias("route"),
        key.alias("seq"),
        (41 + (key % 997) / 2000).alias("lat"),
        (-77 + (key * 7 % 991) / 2000).alias("lon"),
    )


def _waypoints(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    numbered = F.concat(F.lit("AS"), key.cast("string"), F.lit(" - "), F.col("s_name"))
    return p.table(spark, sf, "supplier").select(
        (1 + key % 50).alias("route"),
        key.alias("station_id"),
        F.when(key % 9 == 0, F.col("s_name")).otherwise(numbered).alias("gpx_name"),
        (41 + (key * 37 % 499) / 1000).alias("lat"),
        (-77 + (key * 53 % 497) / 1000).alias("lon"),
    )


@query
def parse_route(spark, sf):
    df = course.parse_route(_vertices(spark, sf))
    return _out(df, ["route", "seq", "lat", "lon", "cum_mi"], lat=6, lon=6)


def _snapped(spark: SparkSession, sf: str) -> DataFrame:
    return course.snap_waypoints(_waypoints(spark, sf), _vertices(spark, sf))


@query
def snap_waypoints(spark, sf):
    columns = ["route", "station_id", "name", "gpx_name", "route_seq", "cum_mi", "scaled_mi"]
    return _snapped(spark, sf).select(*columns)


@query
def route_quality(spark, sf):
    return course.route_quality(course.parse_route(_vertices(spark, sf)), _snapped(spark, sf))


def _thinned_route(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    at = p.stored(course.nearest_vertex(_waypoints(spark, sf), _vertices(spark, sf)), "nearest")
    return course.route_downsample(_vertices(spark, sf), at, cap=8, decimals=3), at


@query
def route_downsample(spark, sf):
    return _thinned_route(spark, sf)[0]


@query
def station_indexes(spark, sf):
    return course.station_indexes(*_thinned_route(spark, sf))


@query
def station_crosswalk(spark, sf):
    """Parts as checkpoints placed by their price, nations as reference stations."""
    keys = p.table(spark, sf, "part").select(
        F.col("p_size").cast("long").alias("edition"),
        F.col("p_partkey").cast("string").alias("checkpoint"),
        F.col("p_name").alias("place"),
        F.col("p_retailprice").alias("position"),
        (F.col("p_partkey") % 2 == 0).alias("_listed"),
    )
    reference = p.table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("long").alias("station_id"),
        F.col("n_name").alias("name"),
        (900.0 + 4 * F.col("n_nationkey")).alias("scaled_mi"),
    )
    listed = keys.where("_listed").drop("_listed")
    return course.station_crosswalk(reference, listed, keys.drop("_listed"), max_mi=1.5)


# ---- model and imputation ----------------------------------------------------------------------


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return impute.stop_features(p.ranked_splits(spark, sf), p.COURSE)


def _stored_features(spark: SparkSession, sf: str) -> DataFrame:
    """Training passes over its rows many times, so they are written once."""
    columns = dict.fromkeys([*KEY, "arrive_hrs", "depart_hrs", *model.STOP_FEATURES, "stop_min"])
    return p.stored(_features(spark, sf).select(*columns), "features")


def _unranked(spark: SparkSession, sf: str) -> DataFrame:
    features = impute.stop_features(p.splits(spark, sf), p.COURSE, ranked=False)
    return p.stored(features.select(*KEY, "cp", "position", "elapsed_hrs", "stop_min"), "features")


@query
def stop_features(spark, sf):
    names = [*model.STOP_FEATURES, "stop_min"]
    digits = dict.fromkeys(
        ["elapsed_hrs", "overall_pace", "overall_rank_pct", "stop_min"], 8
    )
    return _out(_features(spark, sf), [*KEY, *names], **digits)


@query
def stop_baseline_report(spark, sf):
    fit_rows, validated, medians = model.stop_baseline(_unranked(spark, sf), TRIAL, p.COURSE)
    median = medians.where("cp is null").select("median_stop_min")
    df = model.holdout_report(fit_rows, validated, "stop_min", median)
    return _out(df, df.columns, mae_naive=4, median_stop_min=4)


@query
def arrival_baseline_report(spark, sf):
    fit_rows, validated, pace = model.arrival_baseline(_unranked(spark, sf), ARRIVAL_TRIAL)
    df = model.holdout_report(fit_rows, validated, "elapsed_hrs", pace)
    return _out(df, df.columns, mae_naive=4, median_pace=6)


@query
def baseline_residuals(spark, sf):
    _, validated, _ = model.stop_baseline(_unranked(spark, sf), TRIAL, p.COURSE)
    df = model.residuals_by_station(validated)
    return _out(df, df.columns, mae_naive=4)


@query
def metrics_rows(spark, sf):
    """The baseline report as metric rows, written as JSON lines and read back."""
    path = scratch_path(spark, "metrics")
    rows = model.metrics_long(stop_baseline_report(spark, sf))
    tables.write_json(rows, path)
    return spark.read.schema("name STRING, value DOUBLE, step INT").json(path)


RANDOM_SPLIT = model.Training(holdout_edition=None)


@query
def random_split_report(spark, sf):
    """The baseline on a fifth of the rows, chosen by a hash of their key."""
    features = _unranked(spark, sf)
    fit_rows, validated, medians = model.stop_baseline(features, RANDOM_SPLIT, p.COURSE)
    median = medians.where("cp is null").select("median_stop_min")
    df = model.holdout_report(fit_rows, validated, "stop_min", median)
    return _out(df, df.columns, mae_naive=4, median_stop_min=4)


def _stop_trial(spark: SparkSession, sf: str) -> model.Trained:
    return model.train_stop_model(_stored_features(spark, sf), TRIAL, p.COURSE)


@query
def stop_model_report(spark, sf):
    return _stop_trial(spark, sf).report


@query
def arrival_model_report(spark, sf):
    return model.train_arrival_model(_stored_features(spark, sf), ARRIVAL_TRIAL).report


@query
def arrival_model_beats_baseline(spark, sf):
    """Whether the arrival model errs less than the pace of the field, with the baseline's figures."""
    df = model.train_arrival_model(_stored_features(spark, sf), ARRIVAL_TRIAL).report
    better = (F.col("mae_model") < F.col("mae_naive")).alias("model_is_better")
    return _out(df.select("*", better), ["n_fit", "n_val", "mae_naive", "median_pace", "model_is_better"], mae_naive=4, median_pace=6)


@query
def model_residuals(spark, sf):
    """Error of model and baseline per checkpoint; the model's as whether it is there and no outlier."""
    df = model.residuals_by_station(_stop_trial(spark, sf).validated)
    return df.select("cp", "n", rounded("mae_naive", 4).alias("mae_naive"), F.col("mae_model").between(0, 120).alias("has_model_error"))


@query
def residual_rows(spark, sf):
    """Actual and predicted stops of the held-out rows."""
    df = model.prediction_rows(_stop_trial(spark, sf).validated, [*KEY, "cp"])
    return df.select(
        *KEY,
        *[rounded(c, 4).alias(c) for c in ("actual", "naive", "error_naive")],
        (F.abs(F.col("model") - F.col("actual") - F.col("error_model")) < 1e-9).alias("has_model_error"),
    )


@query
def model_nodes(spark, sf):
    """The fitted model as a table: rows at the root of each tree, and whether its nodes fit together."""
    df = model.node_checks(model.fit(model.observed_stops(_stored_features(spark, sf), p.COURSE), TRIAL))
    return df.select("tree", "n_rows", "leaves_hold_values", (F.col("depth") <= TRIAL.depth).alias("within_depth"), "children_add_up")


@query
def impute_with_model(spark, sf):
    """Stops of the boosted trees, saved and loaded before use, fill the one-sided times.

    The filled values depend on the model, so what is returned of them is whether they lie where they
    must: arrivals from the previous time to the departure, stops from 0 to 120 minutes.
    """
    before = Window.partitionBy("edition", "entity").orderBy("cp")
    features = _stored_features(spark, sf)
    path = scratch_path(spark, "stop-model")
    model.fit(model.observed_stops(features, p.COURSE), TRIAL).save(path)
    predict = model.predict_stops(boosting.Trees.load(spark, path))
    given = features.withColumns(
        {
            "arrive_given": F.col("arrive_hrs"),
            "depart_given": F.col("depart_hrs"),
            "previous": F.coalesce(F.lag(F.coalesce("arrive_hrs", "depart_hrs")).over(before), F.lit(0.0)),
        }
    )
    df = impute.impute_times(given, predict, p.COURSE)
    arrive, depart = F.col("arrive_hrs"), F.col("depart_hrs")
    late = F.greatest("previous", "depart_given")
    return df.select(
        *KEY,
        "arrive_imputed",
        "depart_imputed",
        "stop_imputed",
        rounded("arrive_given", 6).alias("arrive_given"),
        rounded("depart_given", 6).alias("depart_given"),
        F.when(F.col("arrive_imputed"), arrive.between(F.col("previous"), late)).alias("arrive_within"),
        F.when(F.col("depart_imputed"), depart.between(F.col("arrive_given"), F.col("arrive_given") + 2)).alias("depart_within"),
        F.when(F.col("stop_imputed"), F.col("stop_min").between(0, 120)).alias("stop_within"),
        (arrive.eqNullSafe(F.col("arrive_given")) | F.col("arrive_imputed")).alias("arrive_kept"),
    )


_HOURS = dict(arrive_hrs=6, depart_hrs=6, stop_min=4)


@query
def impute_times(spark, sf):
    flags = ["arrive_imputed", "depart_imputed", "stop_imputed"]
    return _out(p.imputed(spark, sf), [*KEY, "arrive_hrs", "depart_hrs", "stop_min", *flags], **_HOURS)


@query
def interval_features(spark, sf):
    values = ["leg_mi", "leg_min", "leg_pace", "overall_pace", "leg_ratio"]
    digits = dict.fromkeys(values, 8)
    return _out(p.legs(spark, sf), [*KEY, "is_finisher", "spans_missing", *values], **digits)


@query
def bucketed_legs(spark, sf):
    """The same legs through tables in buckets, which are gone when the result is handed back."""
    values = ["leg_mi", "leg_min", "leg_pace", "overall_pace", "leg_ratio"]
    path = scratch_path(spark, "bucketed-legs")
    with scratch_scope(spark), Buckets(spark) as store:
        df = p.bucketed_legs(spark, sf, store).select(*KEY, "is_finisher", "spans_missing", *values)
        df.write.parquet(path)
    df = spark.read.schema(df.schema).parquet(path)
    return _out(df, df.columns, **dict.fromkeys(values, 8))


@query
def interval_ratio(spark, sf):
    values = ["elapsed_hrs", "leg_pace", "overall_pace", "leg_ratio"]
    columns = [*KEY, "place", "position", *values, "finish_block", "station_id", "station_mi"]
    return _out(p.leg_ratios(spark, sf), columns, **dict.fromkeys(values, 8))


# ---- reports -----------------------------------------------------------------------------------


@query
def edition_kpis(spark, sf):
    return report.edition_kpis(p.stored_legs(spark, sf), p.COURSE)


@query
def arrival_windows(spark, sf):
    return report.arrival_windows(p.stored_legs(spark, sf))


@query
def stop_medians(spark, sf):
    return report.stop_medians(p.stored_legs(spark, sf))


@query
def leg_speeds(spark, sf):
    return report.leg_speeds(p.stored_legs(spark, sf))


@query
def attrition(spark, sf):
    return report.attrition(p.stored_legs(spark, sf))


@query
def flow_heatmap(spark, sf):
    return report.flow_heatmap(p.stored_legs(spark, sf))


@query
def report_run(spark, sf):
    """A whole run: how many rows each written report table holds for each edition."""
    path = scratch_path(spark, "report-run")
    out = None
    for name in runs.write_reports(spark, sf, path):
        rows = spark.read.parquet(f"{path}/{name}").groupBy("edition").agg(F.count("*").alias("n"))
        rows = rows.select(F.lit(name).alias("section"), "edition", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def heat_cap(spark, sf):
    return report.heat_cap(report.flow_heatmap(p.stored_legs(spark, sf)))


@query
def scatter_sample(spark, sf):
    order = [(F.col("entity") * 7919 + F.col("position") * 2) % 10007, "entity", "position"]
    return report.scatter_sample(p.stored_ratios(spark, sf), cap=2000, order=order)


@query
def station_speed_means(spark, sf):
    return report.station_speed_means(p.leg_ratios(spark, sf))


@query
def cohort_trend(spark, sf):
    return report.cohort_trend(p.leg_ratios(spark, sf))


@query
def arrival_histogram(spark, sf):
    return report.arrival_histogram(p.rebuilt(spark, sf), p.crosswalk(spark, sf))


@query
def cohort_arrival_windows(spark, sf):
    return report.cohort_arrival_windows(p.stored_ratios(spark, sf))


def _eta(spark: SparkSession, sf: str) -> DataFrame:
    stations = p.reference_stations(spark, sf).where("station_id > 0")
    return pacing.eta_table(stations, report.cohort_arrival_windows(p.stored_ratios(spark, sf)))


@query
def eta_table(spark, sf):
    return _eta(spark, sf)


@query
def reproject_plan(spark, sf):
    """One plan per customer; how many miles of passages are known differs between customers."""
    goal = rounded(18 + (F.col("c_acctbal") + 1000) / 550, 2)
    plans = p.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("plan_id"), goal.alias("goal_hrs")
    )
    buyers = p.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("entity"), F.col("o_custkey").alias("plan_id")
    )
    features = p.stored_features(spark, sf)  # the rebuilt passages, read here and for the ratios
    known = p.crosswalk(spark, sf).where("station_id is not null")
    actuals = (
        features
        .where("arrive_hrs is not null")
        .join(known.select("edition", "checkpoint", "station_id"), ["edition", "checkpoint"])
        .join(buyers, "entity")
        .where(F.col("position") <= 15 * (1 + F.col("plan_id") % p.CHECKPOINTS))
        .groupBy("plan_id", "station_id")
        .agg(F.min("arrive_hrs").alias("actual_hrs"))
    )
    ratios = p.stored(p.leg_ratios(spark, sf, features), "ratios")
    df = pacing.reproject_plan(plans, _eta_of(spark, sf, ratios), actuals)
    real = [c for c, t in df.dtypes if t == "double" and c not in ("goal_hrs", "mile")]
    return _out(df, df.columns, **dict.fromkeys(real, 4))


@query
def cohort_medians(spark, sf):
    return report.cohort_medians(p.stored_ratios(spark, sf))


@query
def axis_bounds(spark, sf):
    return report.axis_bounds(p.stored_ratios(spark, sf))


def _eta_of(spark: SparkSession, sf: str, ratios: DataFrame) -> DataFrame:
    stations = p.reference_stations(spark, sf).where("station_id > 0")
    return pacing.eta_table(stations, report.cohort_arrival_windows(ratios))


def _payload_fields(lines: DataFrame) -> DataFrame:
    """Lines written as text, read back and taken apart; numbers are compared as such, text is left out."""
    path = scratch_path(lines.sparkSession, "payload")
    tables.write_payload(lines, path)
    fields = report.read_payload(lines.sparkSession.read.text(path))
    number = F.col("value").try_cast("double")
    return fields.select("edition", "section", "id", "field", number.alias("number")).where("number is not null")


@query
def report_payload(spark, sf):
    """All sections of the report in JSON lines, written, read back and taken apart."""
    features = p.stored_features(spark, sf)
    rows, ratios = p.stored_legs_and_ratios(spark, sf, features)
    heat = p.stored(report.flow_heatmap(rows), "heat")
    section = report.section
    years = rows.select("edition").distinct().withColumn("year", F.col("edition"))
    stations = p.reference_stations(spark, sf).where("station_id > 0")
    order = [(F.col("entity") * 7919 + F.col("position") * 2) % 10007, "entity", "position"]
    lines = report.payload_lines(
        [
            section(years, "years", ["year"], "edition", None),
            section(stations.drop("name"), "stations", ["station_id"], "station_id", None),
            section(report.edition_kpis(rows, p.COURSE), "kpis", ["edition"]),
            section(report.arrival_windows(rows).drop("place"), "arrivals", ["checkpoint"], "position"),
            section(report.stop_medians(rows).drop("place"), "stops", ["checkpoint"]),
            section(report.leg_speeds(rows).drop("place"), "legs", ["checkpoint"], "position"),
            section(report.attrition(rows).drop("place"), "attrition", ["checkpoint"]),
            section(heat, "heat", ["checkpoint", "hour"], "hour"),
            section(report.heat_cap(heat), "heat_cap", ["edition"]),
            section(
                report.scatter_sample(ratios, cap=2000, order=order).select(
                    "edition", "entity", "checkpoint", "position", "speed", "station_id", "finish_block"
                ),
                "points", ["entity", "checkpoint"], "position",
            ),
            section(report.station_speed_means(ratios), "means", ["station_id"], "station_id", None),
            section(report.cohort_trend(ratios), "trend", ["station_id", "finish_block"], "station_id", None),
            section(report.arrival_histogram(features, p.crosswalk(spark, sf)), "bins", ["station_id", "bin"], "station_id", None),
            section(report.cohort_arrival_windows(ratios), "cohort_windows", ["station_id", "finish_block"], "station_id", None),
            section(report.cohort_medians(ratios), "cohorts", ["cohort", "station_id"], "station_id", None),
            section(report.axis_bounds(ratios).withColumn("axis", F.lit("speed")), "axis", ["axis"], None, None),
            section(_eta_of(spark, sf, ratios), "planner", ["block", "station_id"], "block", None),
        ]
    )
    return _payload_fields(lines)


@query
def course_payload(spark, sf):
    """Thinned vertices, stations with their vertex and scaled miles, and total miles of every route."""
    kept, at = _thinned_route(spark, sf)
    kept = p.stored(kept, "kept")
    places = course.snap_waypoints(_waypoints(spark, sf), _vertices(spark, sf), nearest=at)
    stations = course.station_indexes(kept, at).join(places.select("route", "station_id", "scaled_mi"), ["route", "station_id"])
    total = course.parse_route(_vertices(spark, sf)).groupBy("route").agg(F.max("cum_mi").alias("total_mi"))
    lines = report.payload_lines(
        [
            report.section(kept.drop("is_station"), "points", ["seq"], "kept_index", "route"),
            report.section(stations, "stations", ["station_id"], "kept_index", "route"),
            report.section(total.withColumn("unit", F.lit("mi")), "total", ["unit"], None, "route"),
        ]
    )
    return _payload_fields(lines).withColumnRenamed("edition", "route")


@query
def payload_roundtrip(spark, sf):
    """Attrition as JSON payload text, written, read back and taken apart again."""
    ends = report.attrition(p.stored_legs(spark, sf))
    nested = ends.groupBy("edition").agg(
        F.sort_array(F.collect_list(F.struct("checkpoint", "place", "n"))).alias("stations")
    )
    path = scratch_path(spark, "payload")
    tables.write_payload(report.payload_json(nested), path)
    schema = "edition BIGINT, stations ARRAY<STRUCT<checkpoint: STRING, place: STRING, n: BIGINT>>"
    parsed = spark.read.text(path).select(
        F.from_json(F.replace("value", F.lit("<\\/"), F.lit("</")), schema).alias("j")
    )
    return parsed.select("j.edition", F.inline("j.stations"))


# ---- browsing and quality ----------------------------------------------------------------------

_EDITIONS = (1996, 1997, 1999)
_NAME = "runner 1[0-9]*5$"


@query
def explore_rows(spark, sf):
    columns = ["edition", "entity", "name", "checkpoint", "finish_rank", "furthest", "no_such"]
    return explore.explore(p.splits(spark, sf), _EDITIONS, "finish", _NAME, columns)


@query
def explore_counts(spark, sf):
    return explore.explore_counts(p.splits(spark, sf), _EDITIONS, "finish", _NAME)


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    hours = F.coalesce("arrive_hrs", "depart_hrs")
    return p.rebuilt(spark, sf).withColumns(
        {
            "pace_flag": hours / F.col("position") > 0.4,
            "exceeds_cutoff": F.col("depart_hrs") > 33,
            "arrive_interpolated": F.col("arrive_text").isNull(),
        }
    )


@query
def diagnose_timing(spark, sf):
    rows = quality.plotted(_flagged(spark, sf), "depart_hrs", _EDITIONS)
    return quality.diagnose_timing(rows)


@query
def flagged_entities(spark, sf):
    return quality.flagged_entities(_flagged(spark, sf))


@query
def check_splits(spark, sf):
    return quality.check_splits(p.splits(spark, sf))


@query
def check_legs(spark, sf):
    return quality.check_legs(p.legs(spark, sf))


@query
def check_ratios(spark, sf):
    return quality.check_ratios(*p.stored_legs_and_ratios(spark, sf))


@query
def check_crosswalk(spark, sf):
    return quality.check_crosswalk(p.clean(spark, sf), p.crosswalk(spark, sf), p.CROSSWALK_MAX_MI)


@query
def check_eta(spark, sf):
    return quality.check_eta(_eta(spark, sf))


@query
def ratio_share_in_band(spark, sf):
    return quality.share_in_band(p.leg_ratios(spark, sf), "leg_ratio", 0.3, 3.0)


@query
def unmatched_keys(spark, sf):
    """Checkpoints of the passages that a crosswalk lacking the unmapped ones does not list."""
    known = p.crosswalk(spark, sf).where("station_id is not null")
    return quality.unmatched_keys(p.clean(spark, sf), known)


@query
def rows_with_time(spark, sf):
    return quality.rows_with_time(p.rebuilt(spark, sf))


@query
def worst_departures(spark, sf):
    df = quality.worst(p.rebuilt(spark, sf), "depart_hrs", KEY)
    return _out(df, df.columns, depart_hrs=6)


# ---- finisher lists ----------------------------------------------------------------------------


def _finishers(spark: SparkSession, sf: str) -> DataFrame:
    return p.table(spark, sf, "orders").select(
        F.year("o_orderdate").cast("long").alias("edition"),
        F.col("o_orderkey").alias("entity"),
        F.col("o_orderstatus").alias("status"),
        rounded(F.col("o_totalprice") / 1000, 0).alias("minutes"),
        (F.col("o_custkey") % 120).alias("age"),
    )


@query
def finish_order(spark, sf):
    tie = [(F.col("entity") * 7919) % 10007, "entity"]
    df = finishers.finish_order(_finishers(spark, sf), "minutes", tie)
    return df.select("edition", "entity", "minutes", "finish_order")


@query
def share_table(spark, sf):
    return finishers.share_table(_finishers(spark, sf), "status")


@query
def share_spread(spark, sf):
    df = _finishers(spark, sf)
    return finishers.share_spread(df, "status", finishers.listed(df, "status"))


@query
def rank_by_edition(spark, sf):
    df = finish_order(spark, sf)
    years = finishers.listed(_finishers(spark, sf), "edition")
    wide = finishers.rank_by_edition(df, "finish_order", "minutes", years)
    return wide.withColumnsRenamed({str(y): f"y{y}" for y in years})


@query
def edition_means(spark, sf):
    return finishers.edition_means(_finishers(spark, sf), "minutes")


@query
def mean_quintiles(spark, sf):
    return finishers.mean_quintiles(edition_means(spark, sf))


@query
def fixed_histogram(spark, sf):
    return finishers.fixed_histogram(_finishers(spark, sf), "minutes", 25.0, ["status"])


@query
def box_summary(spark, sf):
    hours = F.col("o_totalprice")
    df = p.table(spark, sf, "orders").select(
        F.year("o_orderdate").cast("long").alias("edition"), hours.alias("price")
    )
    return finishers.box_summary(df, "price", ["edition"], digits=3)


@query
def band_counts(spark, sf):
    return finishers.band_counts(_finishers(spark, sf), F.col("age"), ["status"])


@query
def median_frames(spark, sf):
    return finishers.median_frames(_finishers(spark, sf), F.col("minutes") / 60)


# ---- sources, sinks and small expressions ------------------------------------------------------


@query
def csv_typed_scan(spark, sf):
    """Orders written as CSV and read with a declared schema."""
    path = scratch_path(spark, "orders-csv")
    orders = p.table(spark, sf, "orders")
    tables.write_csv(orders, path)
    return _out(tables.read_csv(spark, path, orders.schema), orders.columns)


@query
def csv_text_scan(spark, sf):
    """Orders written as CSV and read as text with two typed columns; priorities do not fit."""
    path = scratch_path(spark, "orders-csv")
    tables.write_csv(p.table(spark, sf, "orders"), path)
    casts = {
        "o_orderkey": "long",
        "o_totalprice": "double",
        "o_orderpriority": "long",
        "o_orderdate": "timestamp_ntz",
    }
    df = tables.read_csv_text(spark, path, casts)
    return _out(df, df.columns)


@query
def edition_rows_roundtrip(spark, sf):
    """Edition starts in the layout of the recorded sheets, written and read back, renamed twice."""
    path = scratch_path(spark, "editions")
    tables.write_csv(unbind(p.editions(spark, sf), RACE_META), path)
    return bind(
        tables.read_csv_text(spark, path, {"race_year": "long"}), RACE_META
    ).select("edition", "start_date", "start_clock")


@query
def sparse_results_scan(spark, sf):
    """Results as recorded, columns all or nearly all empty: their types come from the schema, not from the rows."""
    path = scratch_path(spark, "results-csv")
    late = F.when(F.col("entity") % 4999 == 0, F.lit("29:59:59"))
    sheet = p.results(spark, sf).withColumns({"finish_text": late, "age": F.col("age").try_cast("long")})
    tables.write_csv(unbind(sheet, RACE_RESULTS).select(*schemas.RESULTS.names), path)
    df = bind(tables.read_csv(spark, path, schemas.RESULTS), RACE_RESULTS)
    return _out(df, df.columns, finish_hrs=6, finish_min=4)


@query
def blank_edition_records(spark, sf):
    """Edition starts followed by records of nulls, as some exports end; the blank ones are dropped."""
    path = scratch_path(spark, "editions-csv")
    sheet = unbind(p.editions(spark, sf), RACE_META).withColumns(
        {"race_name": F.concat(F.lit("Race, "), F.col("race_year").cast("string")), "race_distance": F.lit(p.COURSE.length_mi)}
    ).select(*schemas.EDITIONS.names)
    blank = sheet.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.EDITIONS])
    tables.write_csv(sheet.unionByName(blank), path)
    read = bind(tables.read_csv(spark, path, schemas.EDITIONS), RACE_META)
    return tables.drop_blank_records(read, "edition")


@query
def partitioned_parquet(spark, sf):
    """Passages written by edition and read back; one folder per edition."""
    path = scratch_path(spark, "passages")
    tables.write_table(p.clean(spark, sf), path)
    df = tables.read_parquet(spark, path, ["edition", "entity", "cp"], "*.parquet")
    return df.select(F.col("edition").cast("long").alias("edition"), "entity", "cp", "arrive_text")


def _gpx_files(spark: SparkSession, sf: str) -> DataFrame:
    """One course file per 500 consecutive parts; large parts are waypoints, some without name."""
    key = F.col("p_partkey")
    at = F.concat(
        F.lit(' lat="'), (41 + (key % 997) / 2000).cast("string"),
        F.lit('" lon="'), (-77 + (key * 7 % 991) / 2000).cast("string"), F.lit('">'),
    )
    height = F.concat(F.lit("<ele>"), (key % 700).cast("string"), F.lit("</ele>"))
    name = F.concat(F.lit("<name>AS"), key.cast("string"), F.lit(" - "), F.col("p_name"), F.lit("</name>"))
    point = F.concat(
        F.lit("<rtept"), at, F.when(key % 10 == 0, "").otherwise(height), F.lit("</rtept>")
    )
    station = F.when(
        F.col("p_size") > 45,
        F.concat(F.lit("<wpt"), at, F.when(F.col("p_size") == 46, "").otherwise(name), F.lit("</wpt>")),
    )

    def joined(c: str):
        return F.array_join(F.transform(F.filter("_all", lambda s: s[c].isNotNull()), lambda s: s[c]), "")

    return (
        p.table(spark, sf, "part")
        .select(F.floor(key / 500).cast("string").alias("route"), key.alias("k"), point.alias("r"), station.alias("w"))
        .groupBy("route")
        .agg(F.sort_array(F.collect_list(F.struct("k", "r", "w"))).alias("_all"))
        .select(
            "route",
            F.concat(
                F.lit('<gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1"><rte>'),
                joined("r"), F.lit("</rte>"), joined("w"), F.lit("</gpx>"),
            ).alias("text"),
        )
    )


@query
def gpx_route_points(spark, sf):
    df = gpx.route_points(gpx.parse_gpx(_gpx_files(spark, sf)))
    return _out(df, df.columns, lat=6, lon=6)


@query
def gpx_waypoints(spark, sf):
    df = gpx.waypoints(gpx.parse_gpx(_gpx_files(spark, sf)))
    return _out(
        df.withColumn("name", course.display_name("gpx_name")), [*df.columns, "name"], lat=6, lon=6
    )


@query
def preview(spark, sf):
    return explore.preview(p.table(spark, sf, "orders").orderBy("o_orderkey").select("o_orderkey", "o_custkey"))


@query
def elapsed_minutes(spark, sf):
    """Elapsed text split into hours, minutes and seconds, as minutes."""
    df = p.rebuilt(spark, sf)
    return df.select(*KEY, rounded(minutes_of_text("depart_elapsed"), 4).alias("minutes"))


@query
def clock_labels(spark, sf):
    df = p.rebuilt(spark, sf)
    half_on = F.col("arrive_hrs") + F.lit(1.0) / 120
    return df.select(*KEY, clock_label(F.col("arrive_hrs")).alias("label"), clock_label(half_on).alias("label_half_on"))


@query
def lenient_dates(spark, sf):
    """Order dates as slashed text, some malformed, parsed leniently."""
    text = F.when(F.col("o_orderkey") % 7 == 0, F.lit("n/a")).otherwise(
        F.date_format("o_orderdate", "M/d/yy HH:mm")
    )
    df = p.table(spark, sf, "orders").select("o_orderkey", lenient_timestamp(text).alias("parsed"))
    return _out(df, ["o_orderkey", "parsed"])


@query
def slowest_leg(spark, sf):
    """From bare clock readings to the slowest leg of every edition."""
    speeds = report.leg_speeds(p.stored_legs(spark, sf))
    slowest = F.min_by(F.struct("checkpoint", "place", "mph", "n"), F.struct("mph", "checkpoint"))
    best = speeds.where("mph is not null").groupBy("edition").agg(slowest.alias("s"))
    return best.select("edition", "s.checkpoint", "s.place", "s.mph", "s.n")
