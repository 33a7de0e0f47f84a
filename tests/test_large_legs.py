"""The chain to the legs and the reports on them: exchanges, sorts and lookups that large tables pay for."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from waypoint.functions.clock import seconds_of_day
from waypoint.operators import clock, intervals, quantiles, report, runners
from waypoint.plans import passages

STATIONS = "edition long, checkpoint string, place string, cp int, position double"


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def unbroadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_are_laid_out_once(spark, rows, tmp_path, unbroadcast):
    lines = [(1, 1, 30, 4), (1, 1, 10, 9), (1, 2, 50, 6), (2, 1, 70, 8), (None, 1, 5, 5), (3, None, 5, 5)]
    orders = [(k, datetime.datetime(1995, 5, 1)) for k in (1, 2, 2, None)]
    rows(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows(orders, "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    df = passages.raw_passages(spark, str(tmp_path))
    assert plan(df)[1].count("Exchange hashpartitioning") == 2  # one for the lines, one for the orders
    got = sorted((r.entity, r.cp, r.recorded_rank) for r in df.collect())
    assert got == [("1", 1, "10"), ("1", 2, "0"), ("2", 1, "20"), ("2", 1, "20")]


def test_windows_sort_by_the_entity_first(rows):
    data = [(1, e, cp, 1.0 * cp, float(cp), cp + 0.5, 1, 9.0) for e in (1, 2) for cp in (1, 2)]
    df = rows(data, "edition long, entity long, cp int, position double, arrive_hrs double, depart_hrs double, is_finisher int, finish_hrs double")
    legs = intervals.interval_features(df)
    text = plan(legs)[1]
    assert text.count("Sort [entity") == 1 and "Sort [edition" not in text
    assert sum(line.lstrip(" :+-").startswith("Window [") for line in text.splitlines()) == 1
    assert {(r.entity, r.cp): r.leg_min for r in legs.collect()}[2, 2] == 30.0


def test_results_lie_as_the_passages_do(rows, unbroadcast):
    passed = rows([(1, e, cp) for e in (1, 2) for cp in (1, 2)], "edition long, entity long, cp int")
    seen = passed.withColumn("n", F.count(F.lit(1)).over(clock.of_entity()))
    found = rows([(1, 1, 7, 20.0)], "edition long, entity long, official_rank long, finish_hrs double")
    joined = runners.with_summary(
        runners.attach_results(seen, found).withColumns({c: F.lit(1.0) for c in ("arrive_hrs", "depart_hrs", "position")})
    )
    assert plan(joined)[1].count("Exchange hashpartitioning") == 2
    assert {(r.entity, r.finish_rank) for r in joined.collect()} == {(1, "7"), (2, "DNF")}


def test_station_list_hashes_before_it_sorts(rows):
    data = [(1, "A", "p", 1, 5.0), (1, "A", "q", 2, 4.0), (1, "B", None, None, None), (None, "A", "z", 3, 1.0)] * 3
    df = report.station_list(rows(data, STATIONS))
    lowest = [line for line in plan(df)[1].splitlines() if "Aggregate(" in line][-1]
    assert "HashAggregate" in lowest and "place" in lowest
    got = {(r.edition, r.checkpoint): (r.place, r.cp, r.position) for r in df.collect()}
    assert got == {(1, "A"): ("q", 2, 5.0), (1, "B"): (None, None, None), (None, "A"): ("z", 3, 1.0)}


def test_values_look_up_bins_by_number(rows, monkeypatch):
    draw = random.Random(3)
    data = [(g, draw.choice([None, 10 + draw.random() / 50, draw.gauss(0, 9), 7.0])) for g in (1, None) for _ in range(900)]
    seen, own = [], quantiles._values_inside
    monkeypatch.setattr(quantiles, "_values_inside", lambda *a: (seen.append(own(*a)), seen[-1])[1])
    levels = [0.1, 0.25, 0.5, 0.75, 0.9]
    df = rows(data, "g long, v double")
    got = quantiles.grouped_quantiles(df, ["g"], {"v": "v"}, levels, max_inside=5)
    want = df.groupBy("g").agg(F.percentile("v", levels).alias("q"), F.count("v").alias("n"))
    assert {r.g: (r.v_q, r.v_n) for r in got.collect()} == {r.g: (r.q, r.n) for r in want.collect()}
    assert len(seen) > 1 and not any("filter(" in plan(df)[1] for df in seen)


def test_start_is_read_per_edition(rows):
    years = rows(
        [(1, "2021-08-10", "05:00"), (2, "2021-8-10", "05:00"), (3, None, "05:00")],
        "edition long, start_date string, start_clock string",
    )
    stations = rows([(1, "A", "p", 5.0, 5.0, False)], "edition long, checkpoint string, place string, position double, position_step double, is_finish boolean")
    df = clock.attach_edition_station(rows([(1, "A"), (3, "A"), (4, "A")], "edition long, checkpoint string"), years, stations)
    assert df.columns[-1] == "start_at" and "_start" not in df.columns
    assert {r.edition: r.start_at for r in df.collect()} == {1: datetime.datetime(2021, 8, 10, 5), 3: None, 4: None}
    with pytest.raises(Exception, match="2021-8-10"):
        clock.attach_edition_station(rows([(2, "A")], "edition long, checkpoint string"), years, stations).collect()


def test_seconds_of_day_without_parts(rows):
    texts = {"05:30": 19800, "5:3": 18180, "05:30:10": None, "0530": None, ":30": None, "05:": None, "30\n": None, " 5: 30": 19800, "25:70": 94200, "": None, None: None}
    got = rows([(t,) for t in texts], "t string").select("t", seconds_of_day("t").alias("s")).collect()
    assert {r.t: r.s for r in got} == texts
