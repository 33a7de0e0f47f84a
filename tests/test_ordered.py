"""Distributed ranks, sums and quantiles against built-ins and brute force, with hot groups."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from waypoint.operators.joins import join_checked
from waypoint.operators.ordered import SLICE, nearest_on_axis, ordered_slices, ordinal_rank, running_sum, with_previous
from waypoint.operators.quantiles import _bin, grouped_quantiles, smallest


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows in one group, a third with the same value, some nulls."""
    rng = random.Random(3)
    data = []
    for i in range(6000):
        g = "hot" if i % 3 else rng.choice("abc")
        v = 7.0 if i % 3 == 1 else None if i % 50 == 0 else rng.random() * 100 - 20
        data.append((g, i, v))
    return spark.createDataFrame(data, "g string, id long, v double").repartition(7)


def test_rank_equals_row_number(skewed):
    ranked = ordinal_rank(skewed, ["g"], [F.col("v").desc_nulls_last(), "id"], "r", size="n")
    w = Window.partitionBy("g").orderBy(F.col("v").desc_nulls_last(), "id")
    expected = skewed.select("id", F.row_number().over(w).alias("e"), F.count("*").over(Window.partitionBy("g")).alias("m"))
    both = ranked.join(expected, "id")
    assert both.count() == 6000
    assert both.where("r <> e OR n <> m").count() == 0


def test_hot_group_spans_slices(skewed):
    per_group = ordered_slices(skewed, ["g"], ["v", "id"]).groupBy("g").agg(F.countDistinct(SLICE).alias("s"))
    assert {r.g: r.s for r in per_group.collect()}["hot"] > 1


def test_rank_with_null_group(rows):
    df = rows([(None, 2), (None, 1), ("a", 5)], "g string, v int")
    got = ordinal_rank(df, ["g"], ["v"], "r").collect()
    assert sorted((r.g or "", r.v, r.r) for r in got) == [("", 1, 1), ("", 2, 2), ("a", 5, 1)]


def test_running_sum_and_previous(skewed):
    df = skewed.withColumn("v", F.coalesce("v", F.lit(1.0)))
    w = Window.partitionBy("g").orderBy("id")
    want = df.select("id", F.sum("v").over(w).alias("e"), F.lag("v").over(w).alias("p"))
    got = running_sum(df, ["g"], ["id"], F.col("v"), "s").select("id", "s")
    assert got.join(want, "id").where("abs(s - e) > 1e-6").count() == 0
    before = with_previous(ordered_slices(df, ["g"], ["id"]), ["g"], ["v"]).select("id", "prev_v")
    assert before.join(want, "id").where("NOT (prev_v <=> p)").count() == 0


@pytest.mark.parametrize("inside", [50_000, 40, 0], ids=["two passes", "finer bins", "down to one value"])
def test_quantiles(skewed, inside):
    qs = [0.0, 0.1, 0.5, 0.95, 1.0]
    metrics = {"v": "v", "odd": F.when(F.col("id") % 2 == 1, F.col("v")), "none": F.lit(None)}
    got = grouped_quantiles(skewed, ["g"], metrics, qs, max_inside=inside)
    levels = F.array(*[F.lit(q) for q in qs])
    want = skewed.groupBy("g").agg(
        F.percentile("v", levels).alias("e"),
        F.percentile(F.when(F.col("id") % 2 == 1, F.col("v")), levels).alias("o"),
        F.count("v").alias("n"),
    )
    for r in got.join(want, "g").collect():
        assert r.v_q == r.e and r.odd_q == r.o and r.v_n == r.n  # bit for bit, however fine the bins
        assert r.none_q is None and r.none_n == 0


@pytest.mark.parametrize("inside", [50_000, 40, 0], ids=["two passes", "finer bins", "down to one value"])
def test_quantiles_of_random_doubles_agree_in_every_bit(rows, inside):
    rng = random.Random(11)
    df = rows([(rng.randrange(30), rng.gauss(0, 1e3)) for _ in range(3000)], "g int, v double")
    qs = [0.25, 1 / 3, 0.5, 0.9]
    got = grouped_quantiles(df, ["g"], {"v": "v"}, qs, max_inside=inside)
    want = df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(q) for q in qs])).alias("e"))
    assert all(r.v_q == r.e for r in got.join(want, "g").collect())


@pytest.mark.parametrize("inside", [50_000, 40, 0], ids=["two passes", "finer bins", "down to one value"])
def test_quantiles_of_everything_and_of_nothing(rows, inside):
    df = rows([(1.0,), (2.0,), (4.0,), (None,)], "v double")
    r = grouped_quantiles(df, [], {"v": "v"}, [0.5], max_inside=inside).first()
    assert r.v_q == [2.0] and r.v_n == 3
    r = grouped_quantiles(df.where("v > 9"), [], {"v": "v"}, [0.5], max_inside=inside).first()
    assert r.v_q is None and r.v_n == 0


@pytest.mark.parametrize("inside", [50_000, 0])
def test_quantiles_of_extreme_values(rows, inside):
    tiny, huge = 5e-324, 1.7976931348623157e308
    powers = [2.0**k for k in range(-60, 60)] + [2.0**k * (1 - 2**-53) for k in range(-60, 60)]
    values = [0.0, -0.0, tiny, -tiny, huge, -huge, float("inf"), float("-inf"), *powers, *[-x for x in powers]]
    df = rows([(k % 3 if k % 4 else None, v) for k, v in enumerate(values)], "g int, v double")
    qs = [k / 17 for k in range(18)]
    got = grouped_quantiles(df, ["g"], {"v": "v"}, qs, max_inside=inside).collect()
    want = df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(q) for q in qs])).alias("e")).collect()
    assert {r.g: [str(x + 0.0) for x in r.v_q] for r in got} == {r.g: [str(x + 0.0) for x in r.e] for r in want}


def test_bins_rise_with_values(spark):
    values = sorted([s * m * 2.0**k for s in (-1, 1) for k in (-1074, -1022, -3, 0, 1, 52, 1022) for m in (1, 1 + 2**-52, 1.5, 2 - 2**-52)])
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    bins = [r.b for r in df.select("k", _bin(F.col("v")).alias("b")).orderBy("k").collect()]
    assert bins == sorted(bins)


@pytest.mark.parametrize("inside", [50_000, 0])
@pytest.mark.parametrize("share", [0.0, 0.01, 0.35, 1.0])
def test_smallest_share_equals_ranks(skewed, inside, share):
    order = [F.col("v"), F.col("id")]
    known = skewed.where("v is not null")
    got = smallest(skewed, ["g"], order, share, max_inside=inside)
    w = Window.partitionBy("g").orderBy(*order)
    ranked = known.select("*", F.row_number().over(w).alias("r"), F.count("*").over(Window.partitionBy("g")).alias("n"))
    want = ranked.where(F.col("r") <= F.ceil(F.col("n") * share)).select("g", "id", "v")
    assert got.columns == skewed.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_smallest_share_sorts_nothing_but_ties(skewed):
    out = smallest(skewed.where("v <> 7"), ["g"], ["v", "id"], 0.1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [" not in plan and plan.count("Window [") == 1


def test_nearest_on_axis_matches_brute_force(rows):
    rng = random.Random(5)
    keys = [(round(rng.random() * 50, 1),) for _ in range(800)] + [(None,)]
    stations = [(i, round(rng.random() * 50, 1)) for i in range(40)] + [(40, 10.0), (41, 10.0)]
    got = nearest_on_axis(
        rows(keys, "at double").repartition(5), rows(stations, "id long, mi double"),
        key_at="at", candidate_at="mi", candidate_id="id",
    )
    got = {r["at"]: r["id"] for r in got.collect()}
    for (at,) in set(keys) - {(None,)}:
        assert got[at] == min(stations, key=lambda s: (abs(at - s[1]), s[0]))[0]
    assert len(got) == len(set(keys)) - 1


def test_checked_join_is_broadcast_by_its_bytes(spark, rows):
    left = rows([(k % 4,) for k in range(100)], "k int")
    right = rows([(1, "a"), (2, "b")], "k int, v string").distinct()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit, found in (("10m", True), ("-1", False)):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            joined = join_checked(left, right, ["k"])
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan) == found
            assert sorted((r.k, r.v or "") for r in joined.distinct().collect()) == [(0, ""), (1, "a"), (2, "b"), (3, "")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
