"""Where intermediate results may be written.

Operators that need a materialised intermediate (a globally ordered table whose slices are
counted and then read again) write it through ``DataFrame.checkpoint``: it lands in the shared
folder of the cluster, so it survives the loss of an executor.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; only a local session gets one of its own."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="waypoint-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return sc.getCheckpointDir()


_open_scopes: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table, next to the checkpoints; deleted with the scope around, if there is one."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _open_scopes:
        _open_scopes[-1].append(path)
    return path


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end, also after a failure, every table that operators wrote inside for themselves.

    Results must have been written by then, to a path of their own. Scopes nest; without one, what is
    written stays, as a DataFrame that is handed back may still be read.
    """
    _open_scopes.append([])
    try:
        yield
    finally:
        for path in _open_scopes.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, wherever it lies; one that is not there is no error."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: for small tables whose size plans should know."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context: they import it wherever they run."""
    sc = spark.sparkContext
    if any(name.startswith("waypoint-code") for name in sc._python_includes):
        return
    folder = tempfile.mkdtemp(prefix="waypoint-code-")
    atexit.register(shutil.rmtree, folder, True)
    top = Path(__file__).resolve().parent
    path = f"{folder}/waypoint-code-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(path)
