"""Reading and writing tables of files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waypoint.operators.reshape import require_columns


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """CSV with a header; a byte order mark and CRLF line ends are accepted.

    Columns are matched by position, so the header is checked against the schema.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", sep)
        .option("enforceSchema", False)
        .csv(path)
    )


def read_csv_text(
    spark: SparkSession,
    path: str,
    overrides: Mapping[str, str | T.DataType] | None = None,
    sep: str = ",",
) -> DataFrame:
    """CSV read as text, columns named by the header, the named ones cast (null if they do not fit).

    Only the header line is looked at beforehand.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).option("sep", sep).csv(path)
    casts = {c: F.col(f"`{c}`").try_cast(t) for c, t in (overrides or {}).items() if c in raw.columns}
    return raw.withColumns(casts) if casts else raw


def read_parquet(
    spark: SparkSession, path: str, columns: Sequence[str] = (), pattern: str | None = None
) -> DataFrame:
    """Parquet folder, optionally only the files matching ``pattern``; required columns checked."""
    reader = spark.read
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return require_columns(reader.parquet(path), list(columns))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("edition",)) -> None:
    """Partitioned Parquet. Types survive, unlike in text hand-offs.

    The rebalance lets adaptive execution cut a large partition into several files and keeps small
    ones from being scattered over one file per task.
    """
    names = list(partition_by)
    writer = (df.hint("rebalance", *names) if names else df).write.mode("overwrite")
    (writer.partitionBy(*names) if names else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Metrics and other small records, one JSON object per line."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_payload(payload: DataFrame, path: str) -> None:
    """JSON texts of ``payload_json``, one line per row."""
    payload.select("json").write.mode("overwrite").text(path)


def drop_blank_records(df: DataFrame, key: str) -> DataFrame:
    """Some exports end with a record of nulls."""
    return df.where(F.col(key).isNotNull())
