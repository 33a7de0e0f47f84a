"""Intermediate tables in buckets: windows and joins by their keys read them without an exchange."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from waypoint.session import delete, scratch_path


class Buckets:
    """Bucketed tables that live as long as the handle.

    ``keep`` writes a table hashed by its keys into as many buckets as the session has shuffle partitions
    (or ``buckets``), one file each, sorted, and gives it back as a scan that Spark knows to be partitioned
    so: every window, aggregate or join by these keys that follows needs no exchange, and writing what
    such a chain yields into buckets of the same keys needs none either. Two tables kept by one handle
    are co-located. Choose keys whose groups are bounded, such as (edition, entity); a key that holds a share
    of the rows would make one bucket as large.

    ``close``, or leaving the ``with`` block, drops the tables and deletes their files; results must have
    been written by then. Files lie in the shared folder, so a lost executor costs its tasks only.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None) -> None:
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._tables: list[tuple[str, str]] = []

    def keep(self, df: DataFrame, keys: Sequence[str], sort: Sequence[str] | None = ()) -> DataFrame:
        """``sort=None`` leaves the rows of a bucket in the order they come in, which costs no comparison."""
        name, path = f"waypoint_{uuid.uuid4().hex}", scratch_path(self.spark, "buckets")
        self._tables.append((name, path))
        rows = df.repartition(self.buckets, *keys)  # left out by Spark where the rows lie so already
        writer = rows.write.format("parquet").bucketBy(self.buckets, *keys)
        if sort is not None:
            writer = writer.sortBy(*keys, *sort)
        writer.option("path", path).saveAsTable(name)
        return self.spark.table(name)

    def close(self) -> None:
        while self._tables:
            name, path = self._tables.pop()
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, path)

    def __enter__(self) -> Buckets:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
