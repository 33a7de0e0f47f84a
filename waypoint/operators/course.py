"""Routes, waypoints on routes, and matching of changing station layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waypoint.functions.geo import box_distance_floor_mi, haversine_mi
from waypoint.functions.numbers import ratio
from waypoint.operators.ordered import (
    ROW,
    SLICE,
    nearest_on_axis,
    ordered_slices,
    ordinal_rank,
    slice_offsets,
    with_previous,
)
from waypoint.operators.joins import match_null_safe

OFFICIAL_MI = 103.1  # fixed value: official length the measured route is scaled to
LENGTH_BOUNDS_MI = (95.0, 110.0)  # fixed values: plausible measured length
MAX_MATCH_MI = 4.0  # fixed value

# The pyramid of cells: the world is one cell, each cell has 32 x 32 below it, in 8 x 8 patches of 4 x 4.
_LEVELS, _DIGIT, _PATCH = 4, 5, 2
_TIE_DIGITS = 9


def route_miles(vertices: DataFrame) -> DataFrame:
    """Adds ``path_mi``: the length of the route from its first vertex, unrounded.

    ``vertices``: ``route``, ``seq`` (unique in the route), ``lat``, ``lon``. A route may span any
    number of slices; the step across a slice border uses the last vertex of the slice before.
    """
    columns = vertices.columns
    slices = with_previous(ordered_slices(vertices, ["route"], ["seq"]), ["route"], ["lat", "lon"])
    stepped = slices.withColumn(
        "_step",
        F.coalesce(
            haversine_mi(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon")),
            F.lit(0.0),
        ),
    )
    offsets = slice_offsets(stepped, ["route"], F.sum("_step")).drop("_in_slice", "_in_group")
    in_slice = Window.partitionBy("route", SLICE).orderBy(ROW)
    summed = stepped.withColumn("_running", F.sum("_step").over(in_slice))
    return match_null_safe(summed, offsets, ["route", SLICE]).select(
        *columns, (F.col("_running") + F.col("_before")).alias("path_mi")
    )


def parse_route(vertices: DataFrame) -> DataFrame:
    """Vertices with cumulative miles to three digits."""
    return route_miles(vertices).withColumn("cum_mi", F.round("path_mi", 3)).drop("path_mi")


def display_name(raw: str | Column, fixups: dict[str, str] | None = None) -> Column:
    """Text behind the first `` - `` of a waypoint name, after applying known corrections."""
    text = F.col(raw) if isinstance(raw, str) else raw
    if fixups:
        known = F.create_map(*[F.lit(x) for pair in fixups.items() for x in pair])
        text = F.coalesce(F.try_element_at(known, text), text)
    tail = F.try_element_at(F.split(text, " - ", 2), F.lit(2))
    return F.when(tail.isNotNull() & (tail != ""), tail).otherwise(text)


def cell_code(lat: Column, lon: Column) -> Column:
    """Z-order code of the finest cell of a point: ten bits per level, so a shift gives the cell above."""
    fine = 2 ** (_LEVELS * _DIGIT)
    row = F.least(F.greatest(F.floor((lat + 90) / 180 * fine), F.lit(0)), F.lit(fine - 1))
    column = F.least(F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * fine), F.lit(fine - 1))
    code = F.lit(0).cast("long")
    for level in range(_LEVELS):
        down = _DIGIT * (_LEVELS - 1 - level)
        digits = [F.shiftright(x, down).bitwiseAND(F.lit(2**_DIGIT - 1)) for x in (row, column)]
        code = (code * 2**_DIGIT + digits[0]) * 2**_DIGIT + digits[1]
    return code


def _patch(cell: Column) -> Column:
    """Number of the patch of a cell among those of the cell above."""
    row, column = F.shiftright(cell, _DIGIT).bitwiseAND(F.lit(2**_DIGIT - 1)), cell.bitwiseAND(F.lit(2**_DIGIT - 1))
    return F.shiftright(row, _PATCH) * 2 ** (_DIGIT - _PATCH) + F.shiftright(column, _PATCH)


def _with_bounds(met: DataFrame) -> DataFrame:
    here = (F.col("_wlat"), F.col("_wlon"))
    reach = haversine_mi(*here, F.col("_one.lat"), F.col("_one.lon"))
    floor = box_distance_floor_mi(
        *here, *[F.col(f"_{a}_{b}") for a in ("lat", "lon") for b in ("lo", "hi")]
    )
    return met.withColumns({"_reach": reach, "_floor": floor})


def _near(met: DataFrame) -> DataFrame:
    """The boxes met that may hold something nearer than the least reach of the waypoint."""
    bound = Window.partitionBy("route", "_wlat", "_wlon")
    slack = 2 * 10.0**-_TIE_DIGITS
    return met.withColumn("_bound", F.min("_reach").over(bound)).where(F.col("_floor") <= F.col("_bound") + slack)


def _below(targets: DataFrame, points: DataFrame, level: int) -> DataFrame:
    """Targets with occupied cells of ``level`` below the cell they are at, their reach and floor.

    Patches of cells are met first, and only cells of patches that may hold something nearer.
    """
    cell = F.shiftright("_code", 2 * _DIGIT * (_LEVELS - level))
    boxes = points.groupBy("route", cell.alias("_cell")).agg(
        F.min("lat").alias("_lat_lo"),
        F.max("lat").alias("_lat_hi"),
        F.min("lon").alias("_lon_lo"),
        F.max("lon").alias("_lon_hi"),
        F.min_by(F.struct("lat", "lon"), "seq").alias("_one"),
    )
    above = boxes.withColumns({"_at": F.shiftright("_cell", 2 * _DIGIT), "_patch": _patch(F.col("_cell"))})
    patches = above.groupBy("route", "_at", "_patch").agg(
        *[F.min(c).alias(c) for c in ("_lat_lo", "_lon_lo")],
        *[F.max(c).alias(c) for c in ("_lat_hi", "_lon_hi")],
        F.min_by("_one", "_cell").alias("_one"),
    )
    met = _near(_with_bounds(targets.join(patches, ["route", "_at"])))
    kept = met.select("route", "_wlat", "_wlon", "_at", "_patch")
    return _with_bounds(kept.join(above, ["route", "_at", "_patch"]))


def nearest_vertex(waypoints: DataFrame, vertices: DataFrame) -> DataFrame:
    """For every waypoint the nearest vertex of its route; on equal distance the lowest ``seq``.

    Branch and bound down a pyramid of cells, from one for the world to some 40 yards. On each level a
    waypoint meets the occupied cells below the cells it kept, in patches first: at most 64 of these, and 16 cells in each it keeps; every join is
    by route and cell. The distance to one vertex of each cell is an upper bound, and only cells whose
    box may hold something nearer are kept. Only vertices of the surviving finest cells are compared
    one by one, after dropping repeated coordinates.
    """
    points = vertices.groupBy("route", "lat", "lon").agg(F.min("seq").alias("seq"))
    points = points.withColumn("_code", cell_code(F.col("lat"), F.col("lon")))
    targets = (
        waypoints.select("route", F.col("lat").alias("_wlat"), F.col("lon").alias("_wlon"))
        .distinct()
        .withColumn("_at", F.lit(0).cast("long"))
    )
    here = (F.col("_wlat"), F.col("_wlon"))
    for level in range(1, _LEVELS + 1):
        near = _near(_below(targets, points, level))
        targets = near.select("route", "_wlat", "_wlon", F.col("_cell").alias("_at"))
    distance = F.round(haversine_mi(*here, F.col("lat"), F.col("lon")), _TIE_DIGITS)
    best = (
        targets.join(points.withColumnRenamed("_code", "_at"), ["route", "_at"])
        .groupBy("route", "_wlat", "_wlon")
        .agg(F.min(F.struct(distance.alias("mi"), "seq")).alias("_best"))
        .select(
            "route",
            F.col("_wlat").alias("lat"),
            F.col("_wlon").alias("lon"),
            F.col("_best.seq").alias("route_seq"),
            F.col("_best.mi").alias("off_route_mi"),
        )
    )
    return waypoints.join(best, ["route", "lat", "lon"], "left")


def snap_waypoints(
    waypoints: DataFrame,
    vertices: DataFrame,
    official_mi: float = OFFICIAL_MI,
    fixups: dict[str, str] | None = None,
    nearest: DataFrame | None = None,
) -> DataFrame:
    """Station table: nearest vertex, its measured mile and the mile on the official scale.

    ``nearest`` is the result of :func:`nearest_vertex` for the same tables, where it is known already.
    """
    miles = route_miles(vertices).select("route", F.col("seq").alias("route_seq"), "path_mi")
    total = miles.groupBy("route").agg(F.max("path_mi").alias("_total"))
    return (
        (nearest_vertex(waypoints, vertices) if nearest is None else nearest)
        .join(miles, ["route", "route_seq"], "left")
        .join(total, "route", "left")
        .select(
            "route",
            "station_id",
            display_name("gpx_name", fixups).alias("name"),
            "gpx_name",
            "lat",
            "lon",
            "route_seq",
            F.round("path_mi", 2).alias("cum_mi"),
            F.round(F.col("path_mi") * ratio(F.lit(official_mi), F.col("_total")), 2).alias(
                "scaled_mi"
            ),
        )
    )


def route_quality(route: DataFrame, stations: DataFrame) -> DataFrame:
    """Per route: its length, whether it is plausible, and steps that do not move forward."""
    low, high = LENGTH_BOUNDS_MI
    lengths = route.groupBy("route").agg(
        F.max("cum_mi").alias("total_mi"), F.count(F.lit(1)).alias("n_vertices")
    )
    # A route has as many rows here as its layout has stations.
    order = Window.partitionBy("route").orderBy("station_id")
    steps = (
        stations.withColumn("_step", F.col("cum_mi") - F.lag("cum_mi").over(order))
        .groupBy("route")
        .agg(
            F.count(F.lit(1)).alias("n_stations"),
            F.count_if(F.col("_step") <= 0).alias("n_not_increasing"),
        )
    )
    return lengths.join(steps, "route", "left").select(
        "route",
        "total_mi",
        "n_vertices",
        F.col("total_mi").between(low, high).alias("length_plausible"),
        F.coalesce("n_stations", F.lit(0)).alias("n_stations"),
        F.coalesce("n_not_increasing", F.lit(0)).alias("n_not_increasing"),
    )


def station_crosswalk(
    reference: DataFrame,
    station_table: DataFrame,
    rows: DataFrame | None = None,
    max_mi: float = MAX_MATCH_MI,
) -> DataFrame:
    """For every (edition, checkpoint) the nearest reference station by distance from the start.

    Never by checkpoint number, which changes between editions. Keys are the station table and those
    only found in ``rows`` with a position. Several may share a station; beyond ``max_mi`` and
    without a position the outputs are null. ``station_id`` 0 is the start and not matched.
    """
    columns = ["edition", "checkpoint", "place", "position"]
    keys = station_table.where(F.col("edition").isNotNull()).select(*columns)
    if rows is not None:
        extra = (
            rows.where(F.col("position").isNotNull())
            .groupBy("edition", "checkpoint")
            .agg(F.min(F.struct("position", "place")).alias("_any"))
            .select("edition", "checkpoint", "_any.place", "_any.position")
        )
        keys = keys.unionByName(extra.join(keys, ["edition", "checkpoint"], "left_anti"))
    candidates = reference.where(F.col("station_id") > 0).select(
        "station_id", F.col("name").alias("station_name"), F.col("scaled_mi").alias("station_mi")
    )
    hits = nearest_on_axis(
        keys, candidates, key_at="position", candidate_at="station_mi", candidate_id="station_id"
    )
    delta = F.round(F.abs(F.col("position") - F.col("station_mi")), 2)
    close = F.col("delta_mi") <= max_mi
    names = candidates.select("station_id", "station_name")
    return (
        keys.join(hits, "position", "left")
        .withColumn("delta_mi", delta)
        .join(names, "station_id", "left")
        .select(
            *columns,
            *[
                F.when(close, F.col(c)).alias(c)
                for c in ("station_id", "station_name", "station_mi", "delta_mi")
            ],
        )
    )


def route_downsample(
    route: DataFrame, stations: DataFrame, cap: int = 1200, decimals: int = 5
) -> DataFrame:
    """Every k-th vertex, k such that at most ``cap`` remain, and every station's vertex.

    ``kept_index`` numbers the kept vertices of a route from 0.
    """
    total = route.groupBy("route").agg(F.count(F.lit(1)).alias("_n"))
    marked = stations.select("route", F.col("route_seq").alias("seq")).distinct()
    step = F.greatest(F.lit(1), F.ceil(F.col("_n") / cap)).cast("long")
    kept = (
        ordinal_rank(route, ["route"], ["seq"], "_place")
        .join(total, "route")
        .join(marked.withColumn("is_station", F.lit(True)), ["route", "seq"], "left")
        .where(((F.col("_place") - 1) % step == 0) | F.col("is_station"))
    )
    # What is left of a route is bounded by the cap and its stations.
    order = Window.partitionBy("route").orderBy("_place")
    return kept.select(
        "route",
        "seq",
        (F.row_number().over(order) - 1).cast("long").alias("kept_index"),
        F.round("lat", decimals).alias("lat"),
        F.round("lon", decimals).alias("lon"),
        F.coalesce("is_station", F.lit(False)).alias("is_station"),
    )


def station_indexes(kept: DataFrame, stations: DataFrame) -> DataFrame:
    """Index of every station's vertex among the kept ones."""
    at = kept.where("is_station").select("route", F.col("seq").alias("route_seq"), "kept_index")
    return stations.join(at, ["route", "route_seq"]).select("route", "station_id", "kept_index")
