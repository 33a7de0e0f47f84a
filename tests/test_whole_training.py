"""Models learn from every labelled row, however many there are."""

import dataclasses
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waypoint.operators import boosting, model, quantiles
from waypoint.plans import queries as plans

FEATURES = ["a", "b"]


def made(n, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        a, b = rng.choice([None, 1.0, 2.0, 3.0, float("nan")]), float(rng.randrange(12))
        out.append((k, a, b, (5 if a is None else 2 * a if a == a else 1) + b * b / 9 + rng.random()))
    return out


def at_root(fitted):
    return {r.n for r in fitted.nodes.where("node = 1").select("n").collect()}


def test_no_row_is_left_out_beyond_a_million(spark):
    n = 1_050_000
    a, b = (F.col("id") % 7).alias("a"), (F.col("id") % 1013).cast("double").alias("b")
    rows = spark.range(n).select(F.lit(1996).alias("edition"), F.col("id").alias("entity"), F.lit(1).alias("cp"), a, b)
    training = model.Training(features=FEATURES, target="y", iterations=2, depth=2)
    fitted = model.fit(rows.withColumn("y", F.col("a") * 3 + F.col("b") / 100), training)
    assert at_root(fitted) == {n}
    leaves = fitted.nodes.where("tree = 2 and feature is null").agg(F.sum("n")).first()[0]
    assert leaves == n


def test_order_statistics_are_values_at_their_ranks(spark, rows, monkeypatch):
    monkeypatch.setattr(quantiles, "MAX_INSIDE", 20)
    rng = random.Random(3)
    x = [rng.gauss(0, 1) for _ in range(600)] + [0.25] * 300
    y = [float(rng.randrange(5)) if k % 3 else None for k in range(900)]
    levels = [k / 255 for k in range(1, 255)]
    got = quantiles.order_statistics(rows([*zip(x, y, [None] * 900, strict=True)], "x double, y double, z double").repartition(3), ["x", "y", "z"], levels)
    for name, values in (("x", x), ("y", [v for v in y if v is not None])):
        values = sorted(values)
        assert sorted(got[name]) == sorted({values[max(math.ceil(p * len(values)), 1) - 1] for p in levels})
    assert got["z"] == []


def test_bins_are_the_same_beyond_what_summaries_hold(rows, monkeypatch):
    df = rows([*made(700, 4)], "id long, a double, b double, y double").withColumn("none", F.lit(None).cast("double"))
    names = ["a", "b", "y", "none"]
    summaries = boosting.bins(df, names, 700)
    monkeypatch.setattr(boosting, "SUMMARY_ROWS", 10)
    for want, got in zip(summaries, boosting.bins(df, names, 700), strict=True):
        assert np.array_equal(want, got)
    assert [len(e) for e in summaries][:2] == [3, 12] and len(summaries[2]) > 200 and not len(summaries[3])


def test_trees_over_many_tasks_do_not_depend_on_blocks_tasks_or_lost_parts(rows, monkeypatch):
    df = rows(made(500, 5), "id long, a double, b double, y double")
    found = []
    for block_rows, task_blocks, driver_tasks, kept_trees in ((60, 1, 64, 20), (60, 1, 1, 2), (130, 4, 64, 3)):
        monkeypatch.setattr(boosting, "TASK_BLOCKS", task_blocks)
        monkeypatch.setattr(boosting, "DRIVER_TASKS", driver_tasks)
        monkeypatch.setattr(boosting, "KEPT_TREES", kept_trees)
        p = boosting.Boosting(iterations=7, depth=4, block_rows=block_rows, in_task_rows=0)
        found.append(sorted(map(tuple, boosting.fit(df.repartition(3), FEATURES, "y", ["id"], p).nodes.collect()), key=str))
    # the mean is summed by blocks, everything else exactly
    assert [[r[:6] + r[8:] for r in f] for f in found[1:]] == [[r[:6] + r[8:] for r in found[0]]] * 2
    assert found[0] == found[1] and len(found[0]) > 40


@pytest.fixture
def learned(spark, monkeypatch):
    """Features of a made table, and the models that a query fits on it."""
    rng = random.Random(7)
    schema = "edition long, entity long, checkpoint string, cp int, position double, elapsed_hrs double, arrive_hrs double, depart_hrs double, stop_min double, overall_pace double, age double, gender_code double, is_finisher int, overall_rank_pct double"
    table = []
    for k in range(240):
        for cp in range(1, 4):
            at, stop = 3.0 * cp + k % 9 / 10, 3.0 + k % 5 + cp
            table.append((1996 + k % 3, k, f"AS_0{cp}", cp, 14.5 * cp, at, at, None if rng.random() < 0.2 else at + stop / 60, None, 12.0 + k % 9, 20.0 + k % 40, float(k % 2), k % 2, k / 240))
    features = spark.createDataFrame(table, schema).withColumn("stop_min", (F.col("depart_hrs") - F.col("arrive_hrs")) * 60)
    monkeypatch.setattr(plans, "_stored_features", lambda *_: features)
    for name in ("TRIAL", "ARRIVAL_TRIAL"):
        monkeypatch.setattr(plans, name, dataclasses.replace(getattr(plans, name), iterations=3, depth=3))
    fits = []

    def fit(rows, features, target, key, params, plain=boosting.fit):
        fitted = plain(rows, features, target, key, params)
        fits.append((params, rows.where(F.col(target).isNotNull()).count(), fitted))
        return fitted

    monkeypatch.setattr(boosting, "fit", fit)
    return fits


def whole(fits):
    assert len(fits) == 1
    params, n, fitted = fits[0]
    return params.max_rows is None and at_root(fitted) == {n} and n > 300


def test_model_nodes_are_of_every_stop(spark, learned):
    got = plans.all_queries()["model_nodes"](spark, "").collect()
    assert whole(learned) and len(got) == 4
    assert {r.n_rows for r in got} == {learned[0][1]} and all(r.children_add_up for r in got)


def test_arrival_model_that_meets_the_baseline_saw_every_arrival(spark, learned):
    got = plans.all_queries()["arrival_model_beats_baseline"](spark, "").collect()
    assert whole(learned) and [r.n_fit for r in got] == [learned[0][1]]


def test_arrival_report_counts_the_rows_its_model_learned_from(spark, learned):
    got = plans.all_queries()["arrival_model_report"](spark, "").collect()
    assert whole(learned) and [r.n_fit for r in got] == [learned[0][1]]


def test_times_are_filled_by_a_model_of_every_stop(spark, learned):
    got = plans.all_queries()["impute_with_model"](spark, "").collect()
    assert whole(learned) and len(got) == 720
    assert any(r.depart_imputed for r in got) and all(r.depart_within and r.stop_within for r in got if r.depart_imputed)


def test_residuals_are_of_a_model_of_every_stop_outside_the_holdout(spark, learned):
    got = plans.all_queries()["model_residuals"](spark, "").collect()
    assert whole(learned) and {r.cp for r in got} == {1, 2, 3} and all(r.has_model_error for r in got)


def test_stop_report_counts_the_rows_its_model_learned_from(spark, learned):
    got = plans.all_queries()["stop_model_report"](spark, "").collect()
    assert whole(learned) and [r.n_fit for r in got] == [learned[0][1]] and got[0].mae_model is not None
