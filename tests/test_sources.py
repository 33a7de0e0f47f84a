"""Files with byte order marks, CRLF, sparse columns and blank trailing records."""

import pytest

from waypoint import schemas
from waypoint.naming import RACE_SHEET, RACE_STATIONS, bind, unbind
from waypoint.sources import tables


def test_typed_csv_with_bom_and_crlf(spark, tmp_path):
    path = tmp_path / "stations.csv"
    path.write_bytes(
        b"\xef\xbb\xbfyear,as_name,dist_from_start,as_dist,year_as_index,race_name,as_index,flag_finish\r\n"
        b"2014,Ridge Rd,5.8,5.8,2014AS_01,R,AS_01,FALSE\r\n2014,End,102.9,4,2014AS_17,R,AS_17,TRUE\r\n,,,,,,,\r\n"
    )
    raw = tables.read_csv(spark, str(path), schemas.STATIONS)
    rows = tables.drop_blank_records(bind(raw, RACE_STATIONS), "edition").orderBy("position").collect()
    assert raw.count() == 3
    assert [(r.edition, r.position, r.is_finish) for r in rows] == [(2014, 5.8, False), (2014, 102.9, True)]


def test_header_is_checked(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("race_name,year\nR,2014\n")
    with pytest.raises(Exception, match="header"):
        tables.read_csv(spark, str(path), schemas.EDITIONS).collect()


def test_text_csv_with_overrides(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("year,bib_number,as01_arr_tod,MaxTime\n2021,545*,06:10,\n2022,7,DNF,x\n")
    got = tables.read_csv_text(spark, str(path), {"year": "long", "MaxTime": "double", "gone": "int"})
    assert got.dtypes == [("year", "bigint"), ("bib_number", "string"), ("as01_arr_tod", "string"), ("MaxTime", "double")]
    assert [tuple(r) for r in got.collect()] == [(2021, "545*", "06:10", None), (2022, "7", "DNF", None)]


def test_partitioned_parquet_keeps_types(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    df = rows([(2021, 1, None), (2022, 2, 3.5)], "edition long, entity long, depart_hrs double")
    tables.write_table(df, path)
    back = tables.read_parquet(spark, path, ["entity", "depart_hrs"], "*.parquet")
    assert sorted((r.edition, r.entity, r.depart_hrs) for r in back.collect()) == [(2021, 1, None), (2022, 2, 3.5)]
    assert dict(back.dtypes)["depart_hrs"] == "double"
    with pytest.raises(ValueError, match="nothing"):
        tables.read_parquet(spark, path, ["nothing"])


def test_names_are_bound_both_ways(rows):
    df = rows([(2021, 5.0)], "year long, as_check_in__elapsed__min double")
    bound = bind(df, RACE_SHEET)
    assert bound.columns == ["edition", "arrive_hrs"] and unbind(bound, RACE_SHEET).columns == df.columns


def test_wide_schema():
    names = schemas.wide_sheet().names
    assert "as17_arr_tod" in names and "as17_dep_tod" not in names and len(names) == 58
