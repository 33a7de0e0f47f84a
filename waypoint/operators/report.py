"""Report tables per edition and checkpoint, and over all editions per reference station.

Input is the output of ``interval_features`` (legs) or ``interval_ratio`` (ratios). Every table is
one aggregation by (edition, checkpoint) or (block, station), never a loop over them; quantiles go
through :func:`grouped_quantiles`, so a checkpoint may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypoint.functions.clock import clock_label
from waypoint.functions.numbers import inverse, pace_to_mph, ratio, portable_hash, rounded
from waypoint.operators.intervals import Course
from waypoint.operators.joins import join_checked, match_null_safe
from waypoint.session import written
from waypoint.operators.quantiles import grouped_quantiles, pick, smallest
from waypoint.operators.reshape import null_column

# Fixed values of the report.
MIN_GROUP = 5
STOP_COVERAGE_MIN = 0.3
HOURS = 36
HALF_HOURS = 72
MAX_SCATTER = 4000
BLOCKS = (20, 36)
COHORTS = [("under 26 h", 0, 26), ("26-30 h", 26, 30), ("30-34 h", 30, 34), ("34 h and over", 34, 99)]

STATION = ["edition", "checkpoint"]


def station_list(legs: DataFrame) -> DataFrame:
    """Checkpoints met in an edition with their name, number and position."""
    # A greatest text is found by sorting the rows, so those that differ are told apart by hashing first. They
    # are counted, as Spark would leave out a bare ``distinct`` before a maximum.
    known = legs.groupBy(*STATION, "place", "cp", "position").agg(F.count(F.lit(1)).alias("_n")).where("_n > 0")
    return known.groupBy(*STATION).agg(
        F.max("place").alias("place"), F.max("cp").alias("cp"), F.max("position").alias("position")
    )


def per_entity(legs: DataFrame) -> DataFrame:
    return legs.groupBy("edition", "entity").agg(
        F.max("is_finisher").alias("is_finisher"),
        F.max("overall_pace").alias("overall_pace"),
        F.max("furthest").alias("furthest"),
    )


def _with_quantiles(base: DataFrame, quantiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of two tables that have one row per group."""
    return base.join(quantiles, list(keys), "left")


def edition_kpis(legs: DataFrame, course: Course = Course()) -> DataFrame:
    """Starters, finishers, finish rate, median finish hours and median observed stop."""
    entities = per_entity(legs)
    counts = entities.groupBy("edition").agg(
        F.count(F.lit(1)).alias("starters"), F.count_if("is_finisher").alias("finishers")
    )
    hours = grouped_quantiles(
        entities.where("is_finisher"),
        ["edition"],
        {"hours": F.col("overall_pace") * F.lit(course.length_mi) / 60},
        [0.5],
    )
    stops = grouped_quantiles(legs.where(~F.col("stop_imputed")), ["edition"], {"stop": "stop_min"}, [0.5])
    return (
        counts.join(hours, "edition", "left")
        .join(stops, "edition", "left")
        .select(
            "edition",
            "starters",
            "finishers",
            rounded(ratio(F.col("finishers"), F.col("starters")), 3).alias("finish_rate"),
            pick("hours", digits=2).alias("median_finish_hrs"),
            pick("stop", digits=1).alias("median_stop_min"),
        )
    )


def arrival_windows(legs: DataFrame, start_hour: float = 5.0) -> DataFrame:
    """Five quantiles of the arrival per checkpoint, as hours and clock labels, and the count."""
    found = grouped_quantiles(legs, STATION, {"a": "arrive_hrs"}, [0.1, 0.25, 0.5, 0.75, 0.9])
    hours = {f"q{p}": pick("a", i, floor=MIN_GROUP, digits=3) for i, p in enumerate((10, 25, 50, 75, 90))}
    return (
        _with_quantiles(station_list(legs), found, STATION)
        .select(*STATION, "place", "position", *[c.alias(n) for n, c in hours.items()], "a_n")
        .select(
            *STATION,
            "place",
            "position",
            *hours,
            *[
                clock_label(F.col(f"q{p}"), start_hour).alias(f"clock{p}")
                for p in (10, 50, 90)
            ],
            F.coalesce("a_n", F.lit(0)).alias("n"),
        )
    )


def stop_medians(legs: DataFrame) -> DataFrame:
    """Median observed stop of finishers and others, shown if enough visits were observed."""
    observed = ~F.col("stop_imputed")
    coverage = legs.groupBy(*STATION).agg(
        F.max("place").alias("place"),
        F.max("position").alias("position"),
        ratio(F.count_if(observed), F.count(F.lit(1))).alias("coverage"),
    )
    found = grouped_quantiles(
        legs,
        STATION,
        {
            "finisher": F.when(observed & F.col("is_finisher"), F.col("stop_min")),
            "other": F.when(observed & ~F.col("is_finisher"), F.col("stop_min")),
        },
        [0.5],
    )
    shown = F.col("coverage") >= STOP_COVERAGE_MIN
    return _with_quantiles(coverage, found, STATION).select(
        *STATION,
        "place",
        "position",
        rounded("coverage", 4).alias("coverage"),
        *[
            F.when(shown, pick(m, floor=MIN_GROUP, digits=3)).alias(f"median_{m}")
            for m in ("finisher", "other")
        ],
        *[F.coalesce(f"{m}_n", F.lit(0)).alias(f"n_{m}") for m in ("finisher", "other")],
    )


def leg_speeds(legs: DataFrame) -> DataFrame:
    """Median speed, pace and length of clean legs into each checkpoint, and the edition's median."""
    clean = legs.where(~F.col("spans_missing"))
    metrics = {"mph": pace_to_mph(F.col("leg_pace")), "pace": "leg_pace", "miles": "leg_mi"}
    found = grouped_quantiles(clean, STATION, metrics, [0.5])
    whole = grouped_quantiles(clean, ["edition"], {"year": pace_to_mph(F.col("leg_pace"))}, [0.5])
    stations = station_list(legs).join(
        clean.groupBy(*STATION).agg(F.lit(True).alias("_any_clean")), STATION, "left"
    )
    return (
        _with_quantiles(stations, found, STATION)
        .join(whole, "edition", "left")
        .select(
            *STATION,
            "place",
            "position",
            F.when(
                F.col("_any_clean"), F.coalesce(pick("miles", digits=1), F.lit(0.0))
            ).alias("leg_mi"),
            pick("mph", floor=MIN_GROUP, digits=3).alias("mph"),
            pick("pace", floor=MIN_GROUP, digits=3).alias("pace"),
            F.coalesce("mph_n", F.lit(0)).alias("n"),
            pick("year", floor=MIN_GROUP, digits=3).alias("edition_mph"),
        )
    )


def attrition(legs: DataFrame) -> DataFrame:
    """How many entities that did not finish got exactly this far."""
    ended = (
        per_entity(legs)
        .where(~F.col("is_finisher"))
        .groupBy("edition", F.col("furthest").alias("checkpoint"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        station_list(legs)
        .join(ended, STATION, "left")
        .select(*STATION, "place", "position", F.coalesce("n", F.lit(0)).alias("n"))
    )


def flow_heatmap(legs: DataFrame, hours: int = HOURS) -> DataFrame:
    """Arrivals per checkpoint and elapsed hour, every hour present; later arrivals are left out."""
    counted = legs.groupBy(*STATION, F.floor("arrive_hrs").cast("int").alias("hour")).agg(
        F.count(F.lit(1)).alias("n")
    )
    grid = legs.select(*STATION).distinct().select(
        *STATION, F.explode(F.sequence(F.lit(0), F.lit(hours - 1))).alias("hour")
    )
    return grid.join(counted, [*STATION, "hour"], "left").select(
        *STATION, "hour", F.coalesce("n", F.lit(0)).alias("n")
    )


def heat_cap(heatmap: DataFrame, share: float = 0.95) -> DataFrame:
    """Per edition the quantile over non-empty cells that caps the colour scale."""
    found = grouped_quantiles(heatmap.where("n > 0"), ["edition"], {"cap": "n"}, [share])
    return found.select("edition", pick("cap", digits=3).alias("cap"), F.col("cap_n").alias("n_cells"))


def with_speed(ratios: DataFrame) -> DataFrame:
    """Speed relative to the entity's overall speed; inverted per row, before any aggregation."""
    return ratios.withColumn("speed", inverse(F.col("leg_ratio")))


def scatter_sample(
    ratios: DataFrame, cap: int = MAX_SCATTER, order: Sequence[str | Column] | None = None
) -> DataFrame:
    """Points thinned to about ``cap``, the same share of every finish block (rounded up).

    The default order is a hash of the key, so the choice does not depend on partitioning. Each block
    gets a cut-off in that order, see :func:`waypoint.operators.quantiles.smallest`.
    """
    points = with_speed(ratios).where(F.col("station_id").isNotNull() & F.col("speed").isNotNull())
    order = order or [portable_hash("edition", "entity", "checkpoint") % 2**52, "edition", "entity", "checkpoint"]
    share = min(1.0, cap / max(points.count(), 1))
    return smallest(points, ["finish_block"], order, share).select(
        "edition",
        "entity",
        "checkpoint",
        rounded("position", 2).alias("position"),
        rounded("speed", 3).alias("speed"),
        "station_id",
        "finish_block",
    )


def station_speed_means(ratios: DataFrame) -> DataFrame:
    return (
        with_speed(ratios)
        .where(F.col("station_id").isNotNull())
        .groupBy("station_id")
        .agg(rounded(F.avg("speed"), 3).alias("mean_speed"), F.count(F.lit(1)).alias("n"))
    )


def _in_blocks(ratios: DataFrame, blocks: tuple[int, int]) -> DataFrame:
    return ratios.where(F.col("station_id").isNotNull() & F.col("finish_block").between(*blocks))


def cohort_trend(ratios: DataFrame, blocks: tuple[int, int] = BLOCKS) -> DataFrame:
    """Mean speed per finish block and station; small cells are left out."""
    return (
        with_speed(_in_blocks(ratios, blocks))
        .groupBy("finish_block", "station_id", "station_mi")
        .agg(rounded(F.avg("speed"), 3).alias("mean_speed"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= MIN_GROUP)
    )


def arrival_histogram(rows: DataFrame, crosswalk: DataFrame, bins: int = HALF_HOURS) -> DataFrame:
    """Recorded arrivals of everyone per station and half hour; outliers go to the edge bins."""
    known = crosswalk.where(F.col("station_id").isNotNull()).select(*STATION, "station_id")
    half_hour = F.floor(F.col("arrive_hrs") * 2).cast("int")
    return (
        join_checked(rows.where(F.col("arrive_hrs").isNotNull()), known, STATION, "inner")
        .groupBy("station_id", F.greatest(F.least(half_hour, F.lit(bins - 1)), F.lit(0)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def cohort_arrival_windows(ratios: DataFrame, blocks: tuple[int, int] = BLOCKS) -> DataFrame:
    """Quartiles of the arrival per station and finish block; small cells are left out."""
    keys = ["station_id", "finish_block"]
    rows = _in_blocks(ratios, blocks)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_GROUP)
    found = grouped_quantiles(rows, keys, {"a": "elapsed_hrs"}, [0.25, 0.5, 0.75])
    return sizes.join(found, keys, "left").select(
        *keys, *[pick("a", i, digits=2).alias(f"p{p}") for i, p in enumerate((25, 50, 75))], "n"
    )


def cohort_of(hours: Column, cohorts: Sequence[tuple[str, float, float]] = COHORTS) -> Column:
    """Label of the half-open bucket that contains the value, null outside all of them."""
    label = null_column("string")
    for name, low, high in reversed(cohorts):
        label = F.when((hours >= low) & (hours < high), F.lit(name)).otherwise(label)
    return label


def cohort_medians(
    ratios: DataFrame, cohorts: Sequence[tuple[str, float, float]] = COHORTS
) -> DataFrame:
    """Median speed per finish-time cohort and station; small cells are left out."""
    keys = ["cohort", "station_id", "station_mi"]
    rows = (
        with_speed(ratios)
        .withColumn("cohort", cohort_of(F.col("finish_hrs"), cohorts))
        .where(F.col("cohort").isNotNull() & F.col("station_id").isNotNull())
    )
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_GROUP)
    found = grouped_quantiles(rows, keys, {"speed": "speed"}, [0.5])
    return sizes.join(found, keys, "left").select(
        *keys, pick("speed", digits=3).alias("median_speed"), "n"
    )


def axis_bounds(ratios: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """One row: two outer quantiles of the speed over all points (linear interpolation)."""
    found = grouped_quantiles(with_speed(ratios), [], {"speed": "speed"}, [low, high])
    return found.select(
        pick("speed", 0, digits=3).alias("low"), pick("speed", 1, digits=3).alias("high")
    )


def section(
    table: DataFrame,
    name: str,
    label: Sequence[str],
    order: str | None = None,
    edition: str | None = "edition",
) -> DataFrame:
    """Rows of a report table tagged for the payload: edition, section, order, and the row as JSON.

    ``label`` names the columns that tell the rows of the section apart; joined, they are the field
    ``id`` of each row. Rows come in ``order``, then by ``id``. ``edition=None`` is for tables that
    hold for all editions.
    """
    own = F.concat_ws("|", *[F.col(c).cast("string") for c in label]).alias("id")
    body = F.to_json(F.struct(own, *[c for c in table.columns if c not in (edition, *label)]))
    return table.select(
        (F.col(edition) if edition else F.lit(None)).cast("long").alias("edition"),
        F.lit(name).alias("section"),
        (F.col(order) if order else F.lit(0)).cast("double").alias("_at"),
        own,
        body.alias("_body"),
    )


def payload_lines(sections: Sequence[DataFrame], part_rows: int = 500) -> DataFrame:
    """The payload as lines of JSON: edition, section, part and the rows of that part.

    All sections meet in one exchange by edition, section and part instead of a join per section. A
    section is cut into as many parts as its number of rows asks for; parts are dealt by a hash of the
    ids, so none outgrows a task, and each is in order.
    """
    rows = sections[0]
    for other in sections[1:]:
        rows = rows.unionByName(other)
    keys = ["edition", "section"]
    rows = written(rows, "payload-rows")
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / part_rows).alias("parts"))
    dealt = match_null_safe(rows, sizes, keys).withColumn("part", portable_hash("id") % F.col("parts"))
    ordered = F.sort_array(F.collect_list(F.struct("_at", "id", "_body")))
    bodies = F.transform(ordered, lambda r: r["_body"])
    head = F.to_json(F.struct(*keys, "part"))
    lines = dealt.groupBy(*keys, "part").agg(bodies.alias("bodies"))
    text = F.concat(F.left(head, F.length(head) - 1), F.lit(',"rows":['), F.array_join("bodies", ","), F.lit("]}"))
    return lines.select(*keys, "part", F.replace(text, F.lit("</"), F.lit("<\\/")).alias("json"))


def read_payload(lines: DataFrame, column: str = "value") -> DataFrame:
    """Payload lines taken apart: edition, section, id, field and its value as text; nulls are absent."""
    schema = "edition BIGINT, section STRING, part BIGINT, rows ARRAY<MAP<STRING, STRING>>"
    parsed = lines.select(F.from_json(F.replace(column, F.lit("<\\/"), F.lit("</")), schema).alias("j"))
    rows = parsed.select("j.edition", "j.section", F.explode("j.rows").alias("row"))
    fields = rows.select("edition", "section", F.col("row")["id"].alias("id"), F.explode("row").alias("field", "value"))
    return fields.where("field <> 'id'")


def payload_json(payload: DataFrame, keys: Sequence[str] = ("edition",)) -> DataFrame:
    """The rows as compact JSON text, safe to embed in a page (``</`` escaped)."""
    body = F.to_json(F.struct(*payload.columns))
    return payload.select(*keys, F.replace(body, F.lit("</"), F.lit("<\\/")).alias("json"))
