"""A whole report run: tables in, report tables out, nothing left between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waypoint.operators import report
from waypoint.operators.clock import BY_ENTITY
from waypoint.plans import passages as p
from waypoint.session import scratch_scope
from waypoint.sources.buckets import Buckets


def leg_sections(legs: DataFrame) -> dict[str, DataFrame]:
    """The report tables that rest on the legs."""
    return {
        "edition_kpis": report.edition_kpis(legs, p.COURSE),
        "arrival_windows": report.arrival_windows(legs),
        "stop_medians": report.stop_medians(legs),
        "leg_speeds": report.leg_speeds(legs),
        "attrition": report.attrition(legs),
        "flow_heatmap": report.flow_heatmap(legs),
    }


def write_reports(spark: SparkSession, sf: str, out: str) -> list[str]:
    """Write the sections below ``out``, one Parquet folder each, and give their names.

    Passages, features and legs are written in buckets of the entity and read by all sections; at the
    end, or when a section fails, these and whatever the operators wrote for themselves is deleted.
    """
    with scratch_scope(spark), Buckets(spark) as store:
        legs = store.keep(p.bucketed_legs(spark, sf, store).select(*p.LEG_COLUMNS), BY_ENTITY, ["cp"])
        sections = leg_sections(legs)
        for name, df in sections.items():
            df.write.mode("overwrite").parquet(f"{out}/{name}")
        return list(sections)
