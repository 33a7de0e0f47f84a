"""Course files, snapping against brute force, crosswalk and downsampling."""

import math
import random

import pytest
from pyspark.sql import functions as F

from waypoint.functions.geo import EARTH_RADIUS_MI
from waypoint.operators import course
from waypoint.sources import gpx

TEXT = """<?xml version="1.0"?>
<gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1">
  <rte><name>r</name>
    <rtept lat="41.0" lon="-77.0"><ele>231.6</ele></rtept>
    <rtept lat="41.1" lon="-77.0"></rtept>
    <rtept lat="41.2" lon="-77.0"><ele>12</ele></rtept>
  </rte>
  <wpt lat="41.05" lon="-77.0"><name>AS4 - First - Stop</name></wpt>
  <wpt lat="41.19" lon="-77.01"></wpt>
  <wpt lat="41.0" lon="-77.0"><name>AS10</name></wpt>
</gpx>"""


def haversine(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2
    h += math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_RADIUS_MI * math.asin(math.sqrt(h))


@pytest.fixture
def parsed(spark, tmp_path):
    for name in ("one.gpx", "two.gpx"):
        (tmp_path / name).write_text(TEXT)
    return gpx.parse_gpx(gpx.read_gpx(spark, str(tmp_path)))


def test_gpx_route_and_waypoints(parsed):
    points = gpx.route_points(parsed).where("route = 'one.gpx'").orderBy("seq").collect()
    assert [(p.seq, p.lat, p.ele_m) for p in points] == [(0, 41.0, 231.6), (1, 41.1, None), (2, 41.2, 12.0)]
    marks = gpx.waypoints(parsed).where("route = 'two.gpx'").orderBy("station_id").collect()
    assert [m.gpx_name for m in marks] == ["AS4 - First - Stop", "wpt_1", "AS10"]


def test_snap_ties_names_and_scale(parsed):
    vertices = gpx.route_points(parsed)
    got = course.snap_waypoints(gpx.waypoints(parsed), vertices, 20.0, {"AS10": "AS10 - Last"})
    got = got.where("route = 'one.gpx'").orderBy("station_id").collect()
    # The first waypoint lies halfway between two vertices: the lower one wins.
    assert [s.route_seq for s in got] == [0, 2, 0]
    assert [s.name for s in got] == ["First - Stop", "wpt_1", "Last"]
    total = haversine((41.0, -77.0), (41.2, -77.0))
    assert got[1].cum_mi == pytest.approx(round(total, 2)) and got[1].scaled_mi == 20.0


def test_route_quality(parsed):
    route = course.parse_route(gpx.route_points(parsed))
    stations = course.snap_waypoints(gpx.waypoints(parsed), gpx.route_points(parsed))
    got = course.route_quality(route, stations).where("route = 'one.gpx'").first()
    assert not got.length_plausible and got.n_stations == 3 and got.n_not_increasing == 1
    assert got.total_mi == round(haversine((41.0, -77.0), (41.2, -77.0)), 3) and got.n_vertices == 3


def test_nearest_vertex_across_the_date_line(rows):
    waypoints = rows([("r", 1, 0.0, -179.95)], "route string, station_id int, lat double, lon double")
    points = [("r", 1, 0.0, 179.876), ("r", 2, 0.0, 179.999), ("r", 3, 0.0, -179.85)]
    vertices = rows(points, "route string, seq int, lat double, lon double")
    assert course.nearest_vertex(waypoints, vertices).first().route_seq == 2


def test_nearest_vertex_matches_brute_force(rows):
    rng = random.Random(11)
    spread = [(1, i, 41 + rng.random() * 0.6, -77 + rng.random() * 0.6) for i in range(600)]
    dense = [(1, 600 + i, 41.3 + rng.random() * 1e-4, -76.7 + rng.random() * 1e-4) for i in range(600)]
    copies = [(1, 1200 + i, 41.25, -76.75) for i in range(600)]
    far = [(2, 0, -10.0, 170.0), (2, 1, 60.0, -30.0)]
    vertices = spread + dense + copies + far
    marks = [(1, i, 40.9 + rng.random() * 0.8, -77.1 + rng.random() * 0.8) for i in range(60)]
    marks += [(1, 60, 41.30005, -76.69995), (1, 61, 41.25, -76.75), (1, 62, 10.0, 20.0), (2, 63, 0.0, 0.0)]
    got = course.nearest_vertex(
        rows(marks, "route int, station_id int, lat double, lon double"),
        rows(vertices, "route int, seq long, lat double, lon double").repartition(6),
    ).collect()
    assert len(got) == len(marks)
    for m in got:
        here = [v for v in vertices if v[0] == m.route]
        want = min(here, key=lambda v: (round(haversine((m.lat, m.lon), v[2:]), 9), v[1]))
        assert m.route_seq == want[1], m


def test_route_miles_across_slices(rows):
    rng = random.Random(1)
    points = [(1, i, 41 + rng.random(), -77 + rng.random()) for i in range(3000)]
    got = course.route_miles(rows(points, "route int, seq long, lat double, lon double").repartition(5))
    miles, total = {r.seq: r.path_mi for r in got.collect()}, 0.0
    for i, p in enumerate(points):
        total += haversine(points[i - 1][2:], p[2:]) if i else 0.0
        assert miles[i] == pytest.approx(total)


def test_crosswalk(rows):
    stations = rows(
        [
            (2021, "AS_01", "Near", 24.0),
            (2021, "AS_02", "Edge", 34.0),
            (2021, "AS_03", "Past", 34.01),
            (2022, "AS_02", "Near", 24.0),  # renumbered
            (None, None, None, None),
            (2022, "AS_05", "Nowhere", None),
        ],
        "edition long, checkpoint string, place string, position double",
    )
    seen = rows(
        [(2016, "AS_18", "End", 30.0), (2016, "AS_18", "End", 30.0), (2021, "AS_01", "Other", 1.0), (2016, "AS_19", "?", None)],
        "edition long, checkpoint string, place string, position double",
    )
    reference = rows([(0, "Start", 23.9), (1, "A", 26.0), (2, "B", 30.0)], "station_id long, name string, scaled_mi double")
    got = {(r.edition, r.checkpoint): r for r in course.station_crosswalk(reference, stations, seen).collect()}
    assert len(got) == 6
    assert got[2021, "AS_01"].station_id == got[2022, "AS_02"].station_id == 1
    assert got[2021, "AS_02"].station_id == 2 and got[2021, "AS_02"].delta_mi == 4.0
    past = got[2021, "AS_03"]
    assert (past.station_id, past.station_name, past.station_mi, past.delta_mi) == (None,) * 4
    assert got[2016, "AS_18"].station_name == "B"
    assert got[2022, "AS_05"].station_id is None


def test_downsample(rows):
    route = rows([(1, i, 41.0 + i / 1e6, -77.0) for i in range(23)] + [(2, 0, 1.0, 1.0)], "route int, seq long, lat double, lon double")
    stations = rows([(1, 7, 3), (1, 8, 10)], "route int, station_id long, route_seq long")
    got = course.route_downsample(route, stations, cap=5).orderBy("route", "kept_index").collect()
    assert [(r.route, r.seq, r.kept_index) for r in got] == [
        (1, 0, 0), (1, 3, 1), (1, 5, 2), (1, 10, 3), (1, 15, 4), (1, 20, 5), (2, 0, 0),
    ]
    assert [r.is_station for r in got] == [False, True, False, True, False, False, False]
    kept = course.route_downsample(route, stations, cap=5)
    index = course.station_indexes(kept, stations).orderBy("station_id").collect()
    assert [(r.station_id, r.kept_index) for r in index] == [(7, 1), (8, 3)]
    everything = course.route_downsample(route.where("route = 1"), stations, cap=1200)
    assert everything.agg(F.count("*")).first()[0] == 23


def test_nearest_vertex_on_a_route_around_the_world(rows, monkeypatch):
    rng = random.Random(12)
    places = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(1500)]
    places += [(rng.uniform(-3, 3), side * (180 - rng.random() / 4)) for side in (-1, 1) for _ in range(300)]
    places += [(pole * (90 - rng.random() / 3), rng.uniform(-180, 180)) for pole in (-1, 1) for _ in range(200)]
    vertices = [(1, k, lat, lon) for k, (lat, lon) in enumerate(places)]
    asked = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(25)]
    asked += [(0.4, 180.0), (0.4, -180.0), (-1.0, 179.999), (1.0, -179.999), (90.0, 0.0), (-90.0, 77.0), (89.9, -140.0), (0.0, 0.0)]
    pairs = []
    own = course._below
    monkeypatch.setattr(course, "_below", lambda t, p, level: (met := own(t, p, level), pairs.append(met))[0])
    got = course.nearest_vertex(
        rows([(1, k, lat, lon) for k, (lat, lon) in enumerate(asked)], "route long, station_id long, lat double, lon double"),
        rows(vertices, "route long, seq long, lat double, lon double"),
    )
    found = {r.station_id: (r.route_seq, r.off_route_mi) for r in got.collect()}
    for k, here in enumerate(asked):
        mi, seq = min((round(haversine(here, (lat, lon)), 9), seq) for _, seq, lat, lon in vertices)
        assert found[k][0] == seq and abs(found[k][1] - mi) < 1e-6
    # each level joins by route and cell, and meets far fewer pairs than all with all
    met = sum(p.count() for p in pairs)
    assert len(pairs) == 4 and met < 0.45 * len(asked) * len(vertices)
    assert all(p.groupBy("_wlat", "_wlon", "_at").count().where("count > 1024").count() == 0 for p in pairs)


def test_cells_nest(rows):
    df = rows([(-90.0, -180.0), (90.0, 180.0), (0.0, 0.0), (41.5, -76.9), (41.5, 283.1)], "lat double, lon double")
    codes = [r.c for r in df.select(course.cell_code(F.col("lat"), F.col("lon")).alias("c")).collect()]
    assert codes[0] == 0 and codes[3] == codes[4] and all(0 <= c < 2**40 for c in codes)
