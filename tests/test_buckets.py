"""Tables in buckets: no exchange above them, and nothing left of a run."""

import os
import re

import pytest

from waypoint.operators.clock import ENTITY
from waypoint.plans import passages, runs
from waypoint.session import scratch_scope, shared_folder
from waypoint.sources.buckets import Buckets

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def left(spark):
    files = {os.path.join(at, f) for at, _, fs in os.walk(shared_folder(spark).removeprefix("file:")) for f in fs}
    return files, {t.name for t in spark.catalog.listTables()}


def test_windows_aggregates_and_joins_by_the_keys_need_no_exchange(spark, rows):
    data = [(1, k % 50, k) for k in range(600)] + [(2, 7, k) for k in range(5)] + [(None, None, 3)]
    df = rows(data, "edition long, entity long, v long")
    before = left(spark)
    with Buckets(spark) as store:
        a = store.keep(df, ENTITY, ["v"])
        b = store.keep(df.groupBy(*ENTITY).count(), ENTITY)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            joined = a.join(b, ENTITY).groupBy(*ENTITY).agg({"v": "sum", "count": "max"})
            assert "Exchange" not in plan_of(joined)
            got = {tuple(r) for r in joined.collect()}
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert {(e, k, s, n) for e, k, s, n in got} == {(1, k, sum(range(k, 600, 50)), 12) for k in range(50)} | {(2, 7, 10, 5)}
        assert sorted(map(str, a.collect())) == sorted(map(str, df.collect()))
        assert left(spark)[1] - before[1] and store.keep(df.limit(0), ENTITY).count() == 0
    assert left(spark) == before


def test_the_chain_to_the_legs_reads_buckets_as_they_lie(spark):
    before = left(spark)
    with scratch_scope(spark), Buckets(spark) as store:
        splits = passages.bucketed_splits(spark, SMALL, store)
        legs = passages.bucketed_legs(spark, SMALL, store)
        for df in (splits, legs):
            plan = plan_of(df)
            assert "Bucketed: true" in plan
            # the one exchange of the legs is that of the medians, a few rows per checkpoint already combined
            assert set(re.findall(r"Exchange (?:hash|range)partitioning\((\w+)", plan)) <= ({"cp"} if df is legs else set())
        assert legs.count() == passages.legs(spark, SMALL).count()
    assert left(spark) == before


def test_nothing_is_left_of_a_report_run_but_its_result(spark, tmp_path):
    before = left(spark)
    names = runs.write_reports(spark, SMALL, str(tmp_path / "out"))
    assert left(spark) == before
    assert all(spark.read.parquet(str(tmp_path / "out" / n)).count() > 0 for n in names)


def test_a_failure_leaves_nothing_either(spark, rows):
    before = left(spark)
    with pytest.raises(ZeroDivisionError), scratch_scope(spark), Buckets(spark) as store:
        store.keep(rows([(1, 2)], "edition long, entity long"), ENTITY)
        raise ZeroDivisionError
    assert left(spark) == before
