"""The registered queries on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries

SMALL = "/root/testdata/sf0.001"


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_flagship(spark):
    got = entry(spark)
    assert got.columns == ["edition", "checkpoint", "place", "mph", "n"]
    assert got.count() > 0


@pytest.mark.parametrize("name", ["wide_to_long", "rebuild_departures", "impute_times", "route_downsample"])
def test_queries_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_model_queries_train_as_the_operator_does_by_default():
    from waypoint.operators.model import Training
    from waypoint.plans import queries as plans

    for training in (plans.TRIAL, plans.ARRIVAL_TRIAL):
        assert (training.iterations, training.depth, training.step) == (300, 6, 0.05)
        assert (training.iterations, training.depth, training.step) == (Training().iterations, Training().depth, Training().step)
