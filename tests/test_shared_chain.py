"""What several parts of a query need is computed once."""

import datetime

import pytest

from waypoint.operators import course, runners
from waypoint.plans import passages, queries


@pytest.fixture
def tables(spark, rows, tmp_path):
    keys, stamp = range(1, 61), datetime.datetime
    made = {
        "orders": (
            [(k, 1 + k % 12, "F" if k % 4 else "O", 150000.0 + 9000 * (k % 30), stamp(1995 + k % 3, 5, 1)) for k in keys],
            "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp",
        ),
        "lineitem": (
            [(k, 5 * (k + c), 3 * k + c, c) for k in keys for c in range(1, 8)],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int",
        ),
        "customer": ([(k, 500.0 * k) for k in range(1, 13)], "c_custkey long, c_acctbal double"),
        "nation": ([(k, f"N{k}") for k in range(25)], "n_nationkey int, n_name string"),
    }
    for name, (data, schema) in made.items():
        rows(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["reproject_plan", "check_ratios", "report_payload"])
def test_passages_are_rebuilt_once(spark, tables, monkeypatch, name):
    own, calls = passages.rebuilt, []
    monkeypatch.setattr(passages, "rebuilt", lambda *a: (calls.append(a), own(*a))[1])
    assert queries.all_queries()[name](spark, tables).count() > 0
    assert len(calls) == 1


def test_legs_read_features_as_they_lie(spark, tables, monkeypatch):
    own, plans = passages.legs, []

    def legs(*a):
        df = own(*a)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(passages, "legs", legs)
    before = len(spark.catalog.listTables())
    assert passages.stored_legs(spark, tables).count() > 0 and len(spark.catalog.listTables()) == before
    assert "Window" in plans[0] and "Exchange hashpartitioning" not in plans[0]


def test_rank_of_entities_sorts_a_written_table(rows, monkeypatch):
    seen, own = [], runners.ordinal_rank
    monkeypatch.setattr(runners, "ordinal_rank", lambda df, *a, **k: (seen.append(df), own(df, *a, **k))[1])
    data = [(1, e, "DNF", "AS_01", float(e % 3), float(e % 2)) for e in range(9)]
    got = runners.runner_summary(rows(data, "edition long, entity long, finish_rank string, furthest string, max_hrs double, max_position double"))
    order = sorted(data, key=lambda r: (-r[5], r[4], r[1]))
    assert {r.entity: r.overall_rank for r in got.collect()} == {r[1]: i for i, r in enumerate(order, 1)}
    assert "Aggregate" not in seen[0]._jdf.queryExecution().toString()  # or the sort aggregates twice


def test_far_cells_are_dropped_by_patches(rows):
    points = rows([(1, 45.0 * 11.25 / 45 * (i / 32), 11.25 * (j / 32), 100 * i + j) for i in range(32) for j in range(32)], "route long, lat double, lon double, seq long")
    coded = points.withColumn("_code", course.cell_code(points.lat + 1e-6, points.lon + 1e-6))
    at = coded.selectExpr("shiftright(_code, 30) AS _at").first()[0]
    target = rows([(1, 2.0, 3.0, at)], "route long, _wlat double, _wlon double, _at long")
    met = course._below(target, coded, 2)
    cells = coded.selectExpr("shiftright(_code, 20)").distinct().count()
    best = coded.orderBy((points.lat - 2) ** 2 + (points.lon - 3) ** 2).selectExpr("shiftright(_code, 20)").first()[0]
    kept = {r["_cell"] for r in met.collect()}
    assert cells > 400 and best in kept and len(kept) < cells / 4
