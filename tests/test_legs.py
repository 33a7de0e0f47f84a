"""Imputation, legs, reports, pacing and checks on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from waypoint.operators import explore, finishers, impute, intervals, model, pacing, quality, report

IMPUTE = "edition long, entity long, cp int, position double, arrive_hrs double, depart_hrs double, stop_min double, is_finish boolean"


@pytest.fixture
def imputed(rows):
    def run(data, minutes=30.0, **options):
        df = rows([(2021, *d) for d in data], IMPUTE)
        out = impute.impute_times(df, lambda x: x.withColumn(impute.PREDICTED, F.lit(minutes)), **options)
        return {(r.entity, r.cp): r for r in out.collect()}

    return run


def test_imputation(imputed):
    got = imputed(
        [
            (1, 1, 10.0, None, 2.0, None, False),  # departure only
            (1, 2, 20.0, None, 2.25, None, False),  # clamped to the previous time
            (2, 1, 102.9, 30.0, None, None, True),
            (2, 2, 103.1, 31.0, None, None, True),
            (3, 1, 10.0, 5.0, None, None, False),
            (3, 2, 20.0, None, 4.0, None, False),  # previous later than departure: it wins
            (4, 1, 10.0, 3.0, 2.9, -6.0, False),
        ]
    )
    assert got[1, 1].arrive_hrs == 1.5 and got[1, 1].arrive_imputed and got[1, 1].stop_min == 30.0
    assert got[1, 2].arrive_hrs == 2.0
    assert got[2, 1].depart_hrs == 30.5 and got[2, 1].depart_imputed
    assert got[2, 2].depart_hrs is None and not got[2, 2].stop_imputed
    assert got[3, 2].arrive_hrs == 5.0
    assert got[4, 1].stop_min == -6.0 and not got[4, 1].stop_imputed


def test_imputation_options(imputed):
    row = [(2, 1, 102.9, 30.0, None, None, True)]
    assert imputed(row, flag_ends_course=True)[2, 1].depart_hrs is None
    assert imputed(row, minutes=500.0)[2, 1].depart_hrs == 32.0
    assert imputed(row, minutes=-5.0)[2, 1].depart_hrs == 30.0


LEGS = "edition long, entity long, cp int, checkpoint string, place string, position double, arrive_hrs double, depart_hrs double, is_finisher int, finish_rank string, finish_hrs double"


def test_interval_features(rows):
    df = rows(
        [
            (2021, 1, 2, "AS_02", "b", 10.0, 2.0, 2.5, 1, "9", 20.62),
            (2021, 1, 3, "AS_03", "c", 16.0, 2.5, None, 1, "9", 20.62),  # no time passed
            (2021, 1, 4, "AS_04", "d", 20.0, 4.5, 4.6, 1, "9", 20.62),
            (2021, 2, 1, "AS_01", "a", 5.0, None, None, 0, "DNF", None),
            (2021, 2, 2, "AS_02", "b", 10.0, 3.0, 4.0, 0, "DNF", None),
        ],
        LEGS,
    )
    got = {(r.entity, r.cp): r for r in intervals.interval_features(df).collect()}
    first = got[1, 2]
    assert first.spans_missing and first.leg_mi == 10.0 and first.leg_min == 120.0 and first.leg_pace == 12.0
    assert first.overall_pace == pytest.approx(12.0) and first.leg_ratio == pytest.approx(1.0)
    assert got[1, 3].leg_pace is None and got[1, 3].leg_ratio is None
    assert got[1, 4].leg_min == 120.0 and got[1, 4].leg_mi == 4.0
    # A null previous time counts as the start, also in the middle.
    assert got[2, 2].leg_min == 180.0 and got[2, 2].overall_pace == pytest.approx(24.0)
    assert not got[2, 2].is_finisher


def test_interval_ratio_blocks(rows):
    data = [(1, i, "AS_01", "a", 5.0, 1.0, h, rank) for i, (h, rank) in enumerate([(27.49, "1"), (27.5, "2"), (28.49, "3"), (None, "DNF")])]
    legs = rows(data, "edition long, entity long, checkpoint string, place string, position double, arrive_hrs double, finish_hrs double, finish_rank string")
    legs = legs.withColumns({c: F.lit(1.0) for c in ("leg_pace", "overall_pace", "leg_ratio")})
    xwalk = rows([(1, "AS_01", 3, 5.1)], "edition long, checkpoint string, station_id long, station_mi double")
    got = {r.entity: r for r in intervals.interval_ratio(legs, xwalk).collect()}
    assert [got[i].finish_block for i in range(3)] == [27, 28, 28] and len(got) == 3
    assert got[0].station_id == 3


REPORT = "edition long, entity long, cp int, checkpoint string, place string, position double, arrive_hrs double, stop_min double, stop_imputed boolean, is_finisher boolean, spans_missing boolean, leg_mi double, leg_pace double, overall_pace double, furthest string"


@pytest.fixture
def legs(rows):
    def leg(cp, i, n, observed):
        return (
            2021, cp * 100 + i, cp, f"AS_0{cp}", "p", 5.0 * cp, 35.99 if i == 0 else 36.0 if i == 1 else 10.0 + i,
            float(i), i >= observed, True, False, 5.0, 12.0, 15.0, "FINISH",
        )

    sizes = {1: (4, 4), 2: (5, 5), 3: (100, 29), 4: (100, 30)}
    data = [leg(cp, i, n, k) for cp, (n, k) in sizes.items() for i in range(n)]
    data.append((2021, 999, 1, "AS_01", "p", 5.0, None, None, False, False, True, 5.0, None, None, "AS_01"))
    return rows(data, REPORT)


def test_small_groups_and_coverage(legs):
    windows = {r.checkpoint: r for r in report.arrival_windows(legs).collect()}
    assert windows["AS_01"].q50 is None and windows["AS_01"].clock50 is None and windows["AS_01"].n == 4
    assert windows["AS_02"].q50 == 14.0 and windows["AS_02"].clock50 == "19:00" and windows["AS_02"].n == 5
    stops = {r.checkpoint: r for r in report.stop_medians(legs).collect()}
    assert stops["AS_03"].median_finisher is None and stops["AS_03"].n_finisher == 29
    assert stops["AS_04"].median_finisher == 14.5 and stops["AS_04"].median_other is None


def test_kpis_attrition_heat_and_payload(legs):
    kpis = report.edition_kpis(legs).first()
    assert (kpis.starters, kpis.finishers) == (210, 209)
    assert kpis.finish_rate == 0.995 and kpis.median_finish_hrs == 25.78
    ends = {r.checkpoint: r.n for r in report.attrition(legs).collect()}
    assert ends == {"AS_01": 1, "AS_02": 0, "AS_03": 0, "AS_04": 0}
    heat = report.flow_heatmap(legs)
    assert heat.count() == 4 * 36
    hours = {r.hour: r.n for r in heat.where("checkpoint = 'AS_02'").collect()}
    assert hours[35] == 1 and sum(hours.values()) == 4  # 36.0 is left out
    lines = report.payload_lines(
        [
            report.section(report.edition_kpis(legs), "kpis", ["edition"]),
            report.section(report.arrival_windows(legs), "arrivals", ["checkpoint"], "position"),
            report.section(heat, "heat", ["checkpoint", "hour"], "hour"),
            report.section(report.leg_speeds(legs), "legs", ["checkpoint"], "position"),
        ]
    ).collect()
    found = {r.section: json.loads(r.json) for r in lines}
    assert found["kpis"]["rows"][0]["starters"] == 210 and found["kpis"]["edition"] == lines[0].edition
    assert [r["id"] for r in found["arrivals"]["rows"]] == ["AS_01", "AS_02", "AS_03", "AS_04"]
    assert len([r for r in found["heat"]["rows"] if r["id"].startswith("AS_01|")]) == 36
    assert sum(r["n"] for r in found["heat"]["rows"] if r["id"].startswith("AS_02|")) == 4
    assert [r["mph"] for r in found["legs"]["rows"] if "mph" in r] == [5.0, 5.0, 5.0]


RATIO = "edition long, entity long, checkpoint string, position double, leg_ratio double, finish_hrs double, finish_block long, station_id long, station_mi double, elapsed_hrs double"


def test_scatter_sample_keeps_small_blocks(rows):
    data = [(1, i, "AS_01", 5.0, 1.0, 28.0, 28, 1, 5.0, 4.0) for i in range(100)]
    data += [(1, 200, "AS_01", 5.0, 1.0, 20.0, 20, 1, 5.0, 4.0), (1, 201, "AS_01", 5.0, -1.0, 20.0, 20, 1, 5.0, 4.0)]
    sample = report.scatter_sample(rows(data, RATIO), cap=10)
    assert {r.finish_block: r["count"] for r in sample.groupBy("finish_block").count().collect()} == {28: 10, 20: 1}
    again = report.scatter_sample(rows(data, RATIO).repartition(7), cap=10)
    assert sample.exceptAll(again).count() == 0
    assert report.scatter_sample(rows(data, RATIO), cap=4000).count() == 101


def test_histogram_edges(rows):
    arrivals = rows([(1, "AS_01", h) for h in (35.99, 36.0, 80.0, -1.0, None, 0.5)], "edition long, checkpoint string, arrive_hrs double")
    xwalk = rows([(1, "AS_01", 4)], "edition long, checkpoint string, station_id long")
    got = {r.bin: r.n for r in report.arrival_histogram(arrivals, xwalk).collect()}
    assert got == {71: 3, 0: 1, 1: 1}


def test_cohort_buckets(rows):
    df = rows([(h,) for h in (25.99, 26.0, 33.9, 34.0, 99.0)], "h double")
    got = [r.c for r in df.select(report.cohort_of(F.col("h")).alias("c")).collect()]
    assert got == ["under 26 h", "26-30 h", "30-34 h", "34 h and over", None]


@pytest.fixture
def eta(rows):
    stations = rows([(1, 10.0), (2, 20.0), (3, 30.0), (4, 40.0)], "station_id long, scaled_mi double")
    windows = rows(
        [(2, 24, 4.0, 5.0, 6.0), (2, 28, 6.0, 7.0, 8.0), (4, 26, 19.0, 20.0, 22.0)],
        "station_id long, finish_block long, p25 double, p50 double, p75 double",
    )
    return pacing.eta_table(stations, windows)


def test_eta_gaps_and_nearest_block(eta):
    got = {(r.block, r.station_id): r for r in eta.collect()}
    # Block 26 is as far from 24 as from 28: the lower one. Station 1 scaled, station 3 interpolated.
    assert [got[26, s].f50 for s in (1, 2, 3, 4)] == [0.125, 0.25, 0.625, 1.0]
    assert got[28, 2].f50 == 0.35 and got[28, 3].f50 == 0.675
    assert got[26, 2].f25 == 0.2 and got[26, 4].f75 == 1.1 and got[26, 4].f25 == 0.95
    assert all(got[b, 4].f50 == 1.0 for b in range(20, 37))


def test_eta_without_any_data(rows):
    stations = rows([(1, 0.0), (2, 20.0)], "station_id long, scaled_mi double")
    none = rows([], "station_id long, finish_block long, p25 double, p50 double, p75 double")
    got = {r.station_id: r.f50 for r in pacing.eta_table(stations, none).where("block = 20").collect()}
    assert got == {1: 0.0, 2: 1.0}


def test_reproject(rows, eta):
    plans = rows([(1, 26.0), (2, 26.0), (3, 26.0), (4, 40.0)], "plan_id long, goal_hrs double")
    actuals = rows([(2, 2, 7.8), (3, 3, 16.25), (3, 1, 9.0)], "plan_id long, station_id long, actual_hrs double")
    got = {(r.plan_id, r.station_id): r for r in pacing.reproject_plan(plans, eta, actuals).collect()}
    assert got[1, 2].revised_hrs == got[1, 2].predicted_hrs == 6.5 and got[1, 4].projected_finish_hrs == 26.0
    assert got[2, 2].revised_hrs == 7.8
    assert got[2, 4].revised_hrs == pytest.approx(31.2) and got[2, 1].minutes_to_goal == pytest.approx(312.0)
    # The furthest actual is the anchor; earlier actuals stand.
    assert got[3, 1].revised_hrs == 9.0 and got[3, 4].projected_finish_hrs == pytest.approx(26.0)
    assert got[4, 1].block == 36 and got[4, 4].predicted_clock == "21:00 +1"


def test_model_beats_the_median(spark, rows):
    data = []
    for i in range(1500):
        finisher = i % 2
        age = None if i % 7 == 0 else 20.0 + i % 40
        data.append((2021 + i // 2 % 2, i, i % 5, 10.0 * (i % 5), 5.0 + i % 9, 12.0, age, None, finisher, i / 1500, 3.0 + 20 * finisher + i % 3))
    features = rows(data, "edition long, entity long, cp int, position double, elapsed_hrs double, overall_pace double, age double, gender_code double, is_finisher int, overall_rank_pct double, stop_min double")
    training = model.Training(iterations=5, depth=3, step=0.5, holdout_edition=2022)
    trained = model.train_stop_model(features, training)
    r = trained.report.first()
    assert (r.n_fit, r.n_val, r.holdout_edition) == (750, 750, 2022)
    assert r.mae_model < r.mae_naive
    assert {m.name for m in model.metrics_long(trained.report).collect()} == {"n_fit", "n_val", "mae_model", "mae_naive", "median_stop_min"}
    assert model.residuals_by_station(trained.validated).count() == 5
    errors = model.prediction_rows(trained.validated).collect()
    assert len(errors) == 750 and all(abs(e.model - e.actual - e.error_model) < 1e-9 for e in errors)
    checks = model.node_checks(trained.trial).collect()
    assert len(checks) == 6 and all(c.n_rows == 750 and c.children_add_up and c.leaves_hold_values and c.depth <= 3 for c in checks)
    assert model.predict_stops(trained.refit())(features).where("predicted_stop_min IS NULL").count() == 0


def test_random_holdout_is_stable(rows):
    df = rows([(2021, i, 1) for i in range(5000)], "edition long, entity long, cp int")
    held = model.is_held_out(model.Training(holdout_edition=None))
    a, b = df.where(held), df.repartition(9).where(held)
    assert a.exceptAll(b).count() == 0 and 800 < a.count() < 1200


def test_explore_and_flags(rows):
    df = rows(
        [(2021, 1, "AS_01", "Ann Lee", "3", True, None), (2021, 1, "AS_02", "Ann Lee", "3", None, None), (2022, 1, "AS_01", "Bob", "DNF", False, True)],
        "edition long, entity long, checkpoint string, name string, finish_rank string, pace_flag boolean, exceeds_cutoff boolean",
    )
    assert explore.explore(df, [2021, 2022], "dnf").count() == 1
    assert explore.explore(df, [2021], None, " ANN.*e$ ", ["name", "gone"]).columns == ["name"]
    c = explore.explore_counts(df, [2021, 2022], "finish").first()
    assert (c.n_rows, c.n_entities, c.n_entities_total) == (2, 1, 2)
    d = quality.diagnose_timing(df).first()
    assert (d.n_entities, d.n_checkpoints, d.n_flagged, d.pace_flag, d.exceeds_cutoff) == (2, 3, 2, 1, 1)
    with pytest.raises(ValueError, match="position"):
        quality.plotted(df, "arrive_hrs", [2021])


def test_finisher_bands_and_shares(rows):
    df = rows([(9,), (10,), (19,), (20,), (100,), (150,), (None,)], "age int")
    assert [r.b for r in df.select(finishers.band(F.col("age")).alias("b")).collect()] == [0, 1, 1, 2, 10, 10, None]
    runs = rows([(1, "F"), (1, "M"), (1, "M"), (2, "M")], "edition long, sex string")
    got = {(r.edition, r.sex): r for r in finishers.share_table(runs, "sex").collect()}
    assert got[1, "M"].share == 0.5 and got[1, "F"].share_of_edition == 0.333333 and got[2, "M"].centre == 2.0
    wide = {r.edition: r for r in finishers.share_spread(runs, "sex", ["F", "M"]).collect()}
    assert wide[1].share_F == 0.333333 and wide[2].n_F is None


def test_payload_sections_in_parts(rows):
    points = rows([(2021, k, f"AS_0{k % 3}", 1.5 * k if k % 7 else None, "a </b> \"q\"") for k in range(950)] + [(None, 5000, "AS_01", 2.0, "x")], "edition long, entity long, checkpoint string, speed double, note string")
    means = rows([(3, 0.9), (1, 0.8)], "station_id long, mean double")
    lines = report.payload_lines(
        [report.section(points, "points", ["entity", "checkpoint"], "speed"), report.section(means, "means", ["station_id"], "station_id", None)],
        part_rows=100,
    )
    parts = lines.collect()
    sizes = {s: [len(json.loads(r.json.replace("<\\/", "</"))["rows"]) for r in parts if r.section == s and r.edition == e] for s, e in (("points", 2021), ("means", None))}
    assert sum(sizes["points"]) == 950 and len(sizes["points"]) == 10 and max(sizes["points"]) < 200 and sizes["means"] == [2]
    assert all("</" not in r.json for r in parts)
    for r in parts:
        own = [x.get("speed", -1) for x in json.loads(r.json)["rows"]] if r.section == "points" else []
        assert own == sorted(own)
    back = report.read_payload(lines, "json").collect()
    speeds = {(r.edition, r.id): float(r.value) for r in back if r.field == "speed"}
    assert speeds == {(e, f"{k}|{c}"): v for e, k, c, v, _ in points.collect() if v is not None}
    assert {r.value for r in back if r.field == "note" and r.edition} == {"a </b> \"q\""}
    assert {(r.id, r.value) for r in back if r.section == "means"} == {("1", "0.8"), ("3", "0.9")}


def test_checks_of_crosswalk_arrivals_and_ratios(rows):
    walk = rows([(1, "AS_01", "Ford", 5.0, 1, 0.2), (2, "AS_02", "Ford", 9.0, 2, 0.3), (1, "AS_02", "Hill", 9.0, None, None)], "edition long, checkpoint string, place string, position double, station_id long, delta_mi double")
    seen = rows([(1, "AS_01"), (1, "AS_02"), (3, "AS_01")], "edition long, checkpoint string")
    got = {r.check_name: r.violations for r in quality.check_crosswalk(seen, walk, 0.25).collect()}
    assert got == {"key_not_listed": 1, "key_without_station": 1, "match_too_far": 1, "place_at_two_stations": 1}
    eta = rows([(20, 1, 5.0, 0.2, 0.3, 0.4), (20, 2, 9.0, 0.3, 0.2, 0.1), (21, 1, 5.0, 0.9, 1.0, 1.1)], "block long, station_id long, mile double, f25 double, f50 double, f75 double")
    got = {r.check_name: r.violations for r in quality.check_eta(eta).collect()}
    assert got == {"block_not_ending_at_one": 1, "step_back": 1, "bounds_crossed": 1}
    legs = rows([(1, 1, r, 15.0) for r in (0.9, 0.95, 4.0)] + [(1, 2, 0.5, 15.0)], "edition long, entity long, leg_ratio double, overall_pace double")
    got = {r.check_name: (r.value, r.in_range) for r in quality.check_ratios(legs, legs).collect()}
    assert got == {"median_ratio_of_entities": (0.725, False), "median_ratio": (0.925, True), "median_pace": (15.0, True), "share_in_band": (0.75, False)}
