"""Course geometry files (GPX).

A file is one row of text, so files are parsed in parallel; points keep their place in the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINT = "_lat: DOUBLE, _lon: DOUBLE"
GPX_SCHEMA = (
    f"rte ARRAY<STRUCT<rtept: ARRAY<STRUCT<{_POINT}, ele: DOUBLE>>>>, "
    f"wpt ARRAY<STRUCT<{_POINT}, name: STRING>>"
)


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """``route`` (file name) and ``text`` of every file."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("route"), F.col("value").alias("text"))


def parse_gpx(files: DataFrame) -> DataFrame:
    """Adds the parsed geometry."""
    return files.select("route", F.from_xml("text", GPX_SCHEMA).alias("gpx"))


def route_points(parsed: DataFrame) -> DataFrame:
    """Route vertices in file order, ``seq`` from 0; a missing elevation is null."""
    points = F.flatten(F.transform("gpx.rte", lambda r: F.coalesce(r["rtept"], F.array())))
    return parsed.select("route", F.posexplode(points).alias("seq", "p")).select(
        "route",
        F.col("seq").cast("long").alias("seq"),
        F.col("p._lat").alias("lat"),
        F.col("p._lon").alias("lon"),
        F.col("p.ele").alias("ele_m"),
    )


def waypoints(parsed: DataFrame) -> DataFrame:
    """Waypoints in file order, ``station_id`` from 0; an unnamed one is called ``wpt_<i>``."""
    return parsed.select("route", F.posexplode("gpx.wpt").alias("i", "w")).select(
        "route",
        F.col("i").cast("long").alias("station_id"),
        F.coalesce("w.name", F.concat(F.lit("wpt_"), F.col("i").cast("string"))).alias("gpx_name"),
        F.col("w._lat").alias("lat"),
        F.col("w._lon").alias("lon"),
    )
