"""Literal edge rows of the clock and summary rules."""

import pytest
from pyspark.sql import functions as F

from waypoint.functions import clock as fc
from waypoint.functions.numbers import bare_number, gender_code, trailing_number
from waypoint.naming import RACE_WIDE, bind
from waypoint.operators import clock, ordered, reshape, runners

EDITIONS = [(2021, "2021-08-14", "05:00")]


@pytest.fixture
def rebuilt(rows):
    def run(readings):
        """``readings``: (entity, cp, arrive, depart)."""
        sheet = rows(
            [(2021, str(e), f"AS_{c:02d}", c, a, d) for e, c, a, d in readings],
            "edition long, entity string, checkpoint string, cp int, arrive_text string, depart_text string",
        )
        editions = rows(EDITIONS, "edition long, start_date string, start_clock string")
        stations = reshape.lay_out_stations(editions, 17, 6.0)
        placed = clock.attach_edition_station(clock.sanitize_times(sheet), editions, stations)
        out = clock.rebuild_departures(clock.rebuild_clock(placed))
        return {(r.entity, r.cp): r for r in out.collect()}

    return run


def test_wide_to_long_keeps_departure_only_rows(rows):
    wide = rows(
        [(2025, "7", None, None, "06:10", "x", "9"), (2025, "8", None, None, None, None, None)],
        "year long, bib_number string, MaxTime double, as01_arr_tod string, as01_dep_tod string,"
        " as02_arr_tod string, as01_arr_rank2 string",
    )
    long = reshape.wide_to_long(bind(wide, RACE_WIDE)).collect()
    assert [(r.entity, r.checkpoint, r.cp, r.arrive_text, r.depart_text) for r in long] == [
        ("7", "AS_01", 1, None, "06:10"),
        ("7", "AS_02", 2, "x", None),
    ]
    assert "recorded_rank" in long[0].asDict() and "as01_arr_rank2" not in long[0].asDict()


def test_sanitize(rows):
    sheet = rows(
        [
            (2021, "1", "AS_01", 1, "DNF", "07:00"),
            (2021, "1", "AS_02", 2, "8::27", None),
            (2021, "1", "AS_03", 3, '12"17', "09:30"),
            (2021, "1*", "AS_04", 4, "99:99", None),
            (2021, "556", "AS_06", 6, "15:32", "15:40"),
        ],
        "edition int, entity string, checkpoint string, cp int, arrive_text string, depart_text string",
    )
    wrong = rows([(2021, "556", "AS_06"), (2021, "n/a", "AS_01")], "edition int, entity string, checkpoint string")
    got = clock.sanitize_times(sheet, wrong).orderBy("cp").collect()
    assert [(r.entity, r.cp, r.arrive_text, r.depart_text) for r in got] == [
        (1, 1, None, "07:00"),
        (1, 3, None, "09:30"),
        (1, 4, "99:99", None),
    ]


def test_midnight_is_crossed_once(rebuilt):
    got = rebuilt([(286, 1, "06:10", None), (286, 9, "21:41", None), (286, 12, "23:59", None), (286, 13, "01:19", None)])
    assert got[286, 13].arrive_hrs == pytest.approx(20.31666667)
    assert str(got[286, 13].arrive_at) == "2021-08-15 01:19:00"
    assert got[286, 12].arrive_elapsed == "18:59:00"
    assert got[286, 1].depart_at is None


def test_elapsed_time_ignores_the_session_zone(spark, rebuilt, monkeypatch):
    monkeypatch.setitem(globals(), "EDITIONS", [(2021, "2021-11-06", "05:00")])
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # clocks change that night
    try:
        got = rebuilt([(1, 1, "23:00", "23:10"), (1, 2, "03:00", "03:30")])
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got[1, 2].arrive_hrs == 22.0 and got[1, 2].depart_hrs == 22.5
    assert str(got[1, 2].arrive_at) == "2021-11-07 03:00:00"


def test_second_step_back_is_a_half_day_slip(rebuilt):
    got = rebuilt([(1, 1, "22:45", None), (1, 2, "00:15", None), (1, 3, "11:45", None), (1, 4, "01:03", None)])
    assert str(got[1, 4].arrive_at) == "2021-08-15 13:03:00"


def test_slip_beyond_the_limit_stands(rebuilt):
    got = rebuilt([(1, 1, "22:45", None), (1, 2, "00:15", None), (1, 3, "14:45", None), (1, 4, "08:00", None)])
    assert str(got[1, 4].arrive_at) == "2021-08-15 08:00:00"


@pytest.mark.parametrize("second, crossed", [("19:40", False), ("19:00", False), ("18:59", True)])
def test_tolerance_is_an_hour(rebuilt, second, crossed):
    got = rebuilt([(1, 1, "20:00", None), (1, 2, second, None)])
    assert got[1, 2].arrive_at.day == (15 if crossed else 14)


@pytest.mark.parametrize(
    "arrive, depart, expected",
    [
        ("12:00", "11:00", "2021-08-14 11:00:00"),  # an hour back stands
        ("12:00", "10:00", None),  # two hours back cannot be trusted
        ("12:00", "06:00", None),  # six hours is still garbage
        ("13:00", "06:00", "2021-08-14 18:00:00"),  # half-day slip
        ("23:30", "00:30", "2021-08-15 00:30:00"),  # past midnight
        (None, "09:00", "2021-08-14 09:00:00"),
    ],
)
def test_departures(rebuilt, arrive, depart, expected):
    at = rebuilt([(1, 1, arrive, depart)])[1, 1].depart_at
    assert (str(at) if at else None) == expected


def test_long_step_back_after_midnight_is_a_slip(rebuilt):
    got = rebuilt([(1, 1, "22:00", None), (1, 2, "01:00", None), (1, 3, "23:30", "00:30")])
    assert str(got[1, 3].depart_at) == "2021-08-15 12:30:00"


def test_departure_later_than_arrival_is_kept(rebuilt):
    assert str(rebuilt([(1, 1, "06:00", "20:00")])[1, 1].depart_at) == "2021-08-14 20:00:00"


def test_starred_entity_is_one_with_the_plain_one(rebuilt):
    got = rebuilt([("545*", 1, "06:00", None), ("545", 2, "07:00", None)])
    assert {k[0] for k in got} == {545}


def test_of_two_records_of_a_checkpoint_one_counts(rebuilt):
    got = rebuilt([("545*", 1, "06:10", None), ("545", 1, "08:00", None), ("545", 2, "07:30", None)])
    assert str(got[545, 1].arrive_at) == "2021-08-14 08:00:00"
    assert str(got[545, 2].arrive_at) == "2021-08-14 07:30:00"
    alone = rebuilt([("545*", 1, "06:10", None), ("545", 2, "07:30", None)])
    assert str(alone[545, 1].arrive_at) == "2021-08-14 06:10:00"


def test_entities_that_are_no_numbers(rows):
    sheet = rows([(2021, "A1", "AS_01", 1, "06:00", None), (2021, "B2*", "AS_01", 1, "07:00", None)], "edition long, entity string, checkpoint string, cp int, arrive_text string, depart_text string")
    with pytest.raises(Exception, match="entity is not a number: A1"):
        clock.sanitize_times(sheet.where("entity = 'A1'")).collect()
    text = clock.sanitize_times(sheet, numeric_entities=False)
    assert sorted(r.entity for r in text.collect()) == ["A1", "B2"]
    results = rows([(2021, "B2*", "Bee", 1)], "edition long, entity string, name string, official_rank long")
    named = runners.attach_results(text, results, numeric_entities=False)
    assert {r.entity: r.name for r in named.collect()} == {"A1": None, "B2": "Bee"}


SPLITS = "edition long, entity long, cp int, checkpoint string, position double, arrive_hrs double, depart_hrs double, official_rank long, finish_hrs double"


def test_runner_summary(rows):
    df = rows(
        [
            (2021, 1, 3, "AS_03", 18.0, 4.0, 4.1, 31, 30.0),  # ranked, no finish row
            (2021, 2, 2, "AS_02", 12.0, None, 9.0, None, None),
            (2021, 3, 2, "AS_02", 12.0, 9.0, None, None, None),  # ties with 2
            (2021, 4, 1, "AS_01", None, 1.0, None, None, None),  # position unknown
        ],
        SPLITS,
    )
    got = {r.entity: r for r in runners.runner_summary(runners.with_summary(df)).collect()}
    assert (got[1].finish_rank, got[1].furthest, got[1].max_hrs, got[1].overall_rank) == ("31", "FINISH", 30.0, 1)
    assert (got[2].finish_rank, got[2].furthest, got[2].max_hrs, got[2].overall_rank) == ("DNF", "AS_02", 9.0, 2)
    assert got[3].overall_rank == 3 and got[4].overall_rank == 4
    assert {r.edition_size for r in got.values()} == {4}
    older = {r.entity: r.max_hrs for r in runners.with_summary(df, use_departures=False).collect()}
    assert older[2] is None


def test_station_rank_null_arrivals(rows):
    df = rows(
        [(1, 1, "AS_01", 5.0), (1, 2, "AS_01", None), (1, 3, "AS_01", 4.0), (1, 4, "AS_01", 5.0)],
        "edition long, entity long, checkpoint string, arrive_hrs double",
    )
    last = {r.entity: r.station_rank for r in runners.station_rank(df, "arrive_hrs").collect()}
    assert last == {3: 1, 1: 2, 4: 3, 2: 4}
    first = {r.entity: r.station_rank for r in runners.station_rank(df, "arrive_hrs", True).collect()}
    assert first == {2: 1, 3: 2, 1: 3, 4: 4}


def test_combine_editions_widens_and_fills(rows):
    a = rows([(2016, 1, 3.5)], "edition int, entity int, arrive_hrs double")
    b = rows([("2021", 2, 4, 5.0)], "edition string, entity int, arrive_hrs int, depart_hrs double")
    got = reshape.combine_editions(a, b).orderBy("edition").collect()
    assert [(r.edition, r.arrive_hrs, r.depart_hrs) for r in got] == [(2016, 3.5, None), (2021, 4.0, 5.0)]


def test_expressions(rows):
    df = rows([("26:03:09", 19.0, "8/13/16 05:07", "AS_07"), ("x", 18.9999, "bad", "FINISH")], "e string, h double, t string, c string")
    got = df.select(
        fc.minutes_of_text("e").alias("m"),
        fc.clock_label(F.col("h")).alias("label"),
        fc.lenient_timestamp(F.col("t")).cast("string").alias("ts"),
        trailing_number("c").alias("n"),
        fc.elapsed_text(F.lit(-60)).alias("neg"),
        fc.elapsed_text(F.lit(360000)).alias("long"),
        gender_code(F.lit("female")).alias("g"),
        bare_number(F.lit("54*")).alias("bib"),
    ).collect()
    assert got[0].m == pytest.approx(1563.15) and got[1].m is None
    assert got[0].label == "00:00 +1" and got[1].label == "24:00"
    assert got[0].ts == "2016-08-13 05:07:00" and got[1].ts is None
    assert (got[0].n, got[1].n) == (7, None)
    assert (got[0].neg, got[0].long, got[0].g, got[0].bib) == ("-1:59:00", "100:00:00", 1.0, 54)


def test_ranks_write_keys_and_order_columns_only(rows, monkeypatch):
    seen = []
    own = ordered.written
    monkeypatch.setattr(ordered, "written", lambda df, name: seen.append(df.columns) or own(df, name))
    df = rows([(1, k, "AS_01", 5.0 - k, "wide", "wider") for k in range(5)], "edition long, entity long, checkpoint string, arrive_hrs double, a string, b string")
    ranked = runners.station_rank(df, "arrive_hrs")
    assert seen == [["edition", "entity", "checkpoint", "_at", ordered.ROW]]
    assert ranked.columns == [*df.columns, "station_rank"]
    assert {r.entity: r.station_rank for r in ranked.collect()} == {k: 5 - k for k in range(5)}


def test_history_ranks(rows):
    df = rows(
        [
            (1996, 1, 1, "AS_01", 6.0, 3.0, None, 5, 30.0),
            (1996, 1, 2, "AS_02", 12.0, 7.0, None, 5, 30.0),
            (1996, 2, 1, "AS_01", 6.0, None, None, None, None),
            (1996, 2, 2, "AS_02", 12.0, 6.5, None, None, None),
        ],
        SPLITS,
    )
    got = runners.with_history_ranks(runners.with_summary(df, use_departures=False)).collect()
    assert {(r.entity, r.cp): (r.overall_rank, r.edition_size, r.station_rank) for r in got} == {
        (1, 1): (2, 2, 2), (1, 2): (2, 2, 2), (2, 1): (1, 2, 1), (2, 2): (1, 2, 1),
    }


def test_a_repeated_result_fails_with_its_key(rows):
    df = rows([(2021, 1, "AS_01"), (2021, 2, "AS_01")], "edition long, entity long, checkpoint string")
    shape = "edition long, entity string, official_rank long, finish_hrs double"
    once = rows([(2021, "1*", 4, 20.0), (None, "7", 1, 1.0), (None, "7", 1, 1.0)], shape)
    got = runners.attach_results(df, once).collect()
    assert {r.entity: r.official_rank for r in got} == {1: 4, 2: None}
    twice = once.unionByName(rows([(2021, "1", 5, 21.0)], shape))
    with pytest.raises(Exception, match="repeated result: 2021 1"):
        runners.attach_results(df, twice).collect()
    with pytest.raises(Exception, match="repeated result: 2021 1"):
        runners.with_summary(runners.attach_results(df.selectExpr("*", "1 AS cp", "1.0D AS position", "1.0D AS arrive_hrs", "2.0D AS depart_hrs"), twice)).collect()
