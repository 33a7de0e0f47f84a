"""What the corpus operators share: tables, written intermediates, words and components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import zipfile
from collections.abc import Callable, Hashable, Iterator
from itertools import repeat
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypoint.session import scratch_path

#: Bytes at which `[^\x20\x09-\x0D]+` separates words; ``bytes.split`` splits at the same six.
WHITE = " \t\n\x0b\x0c\r"

_written: list[list[str]] = []


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context: they import it wherever they run."""
    sc = spark.sparkContext
    if not any(name.startswith("waypoint-code") for name in sc._python_includes):
        top = Path(__file__).resolve().parents[1]
        with tempfile.NamedTemporaryFile(prefix="waypoint-code", suffix=".zip", delete=False) as out, zipfile.ZipFile(out, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        sc.addPyFile(out.name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, scratch: bool = True) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends at files that outlive executors."""
    path = scratch_path(df.sparkSession, name)
    if scratch:
        track(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what ``stored`` and ``track`` wrote inside; results must be written by then."""
    _written.append([])
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _written.pop():
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def track(path: str) -> str:
    """Let the scope around delete a folder that an operator writes by itself."""
    for scope in _written[-1:]:
        scope.append(path)
    return path


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder of the shared store, for code inside tasks."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


#: What a worker holds from task to task, one thing at a time.
_held: dict[Hashable, Any] = {}
_asked = False


def holding(key: Hashable, load: Callable[[], Any]) -> Any:
    """What ``load`` gives, kept by the worker while its tasks (see ``lean``) ask for the same key."""
    global _asked
    _asked = True
    if key not in _held:
        _held.clear()
        _held[key] = load()
        give_back()
    return _held[key]


def give_back() -> None:
    """Hand freed memory back to the system: Arrow's pool and the C library keep it otherwise while a worker lives."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that leaves little behind in its worker, which lives on beside those of other steps.

    At its end freed memory is handed back, and what ``holding`` keeps goes unless the task asked for it.
    """

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        _begun()
        try:
            yield from run(batches)
        finally:
            _ended()

    return whole


# by name, as a nested function is sent to the workers with copies of the globals it uses
def _begun() -> None:
    global _asked
    _asked = False


def _ended() -> None:
    if not _asked:
        _held.clear()
    give_back()


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(seed)), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of an unsigned 64-bit value over all others."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def connected(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list of longs: (node, root), root the least node.

    Alternates large-star and small-star until the edges form stars. Minima are combined before the
    shuffle and met by a join that adaptive execution can split, so a hub needs no task of its own.
    Nodes without an edge do not appear. Every round is written to the shared folder.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v")
    e = stored(e.distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31))).first()
        if mark == seen:
            break
        seen = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
